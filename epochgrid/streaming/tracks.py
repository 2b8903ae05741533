"""The same operators on streams: files that arrive, and pictures that arrive in decode order."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunks import REORDER
from ..sources.ingest import epoch_table
from ..spec import IngestError, IngestSpec


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.{wav,mp4}", per_trigger: int = 16) -> DataFrame:
    """New files of a folder; per_trigger bounds what one batch holds."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def epoch_stream(files: DataFrame, spec: IngestSpec | None = None) -> DataFrame:
    """Epoch rows of each file as it arrives."""
    return epoch_table(files, spec)


def windowed(events: DataFrame, clip: str, time: str, width: str, late: str, *aggregates) -> DataFrame:
    """Tumbling epochs of event time. State for a window is dropped once ``late`` has passed it."""
    return events.withWatermark(time, late).groupBy(clip, F.window(time, width)).agg(*aggregates)


def presented(pictures: DataFrame, clip: str = "clip_id", depth: int = REORDER) -> DataFrame:
    """clip, pts, dec_idx in presentation order: a buffer of ``depth`` pictures for each clip is the state.

    Pictures have positions from 0 on in decode order. Those that come before their turn, in this trigger or an earlier one,
    wait in the state until the ones before are there; one that comes twice is an error. One that belongs before a picture
    already emitted is an error, not dropped. A row with a null pts ends its clip once all before it have come: the buffer
    is emptied and the clip's state removed.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, early, last, due = ([], {}, -(1 << 62), 0)
        if state.exists:
            flat, waiting, last, due = state.get
            held = list(zip(flat[::2], flat[1::2], strict=True))
            early = {at: None if pts == _END else pts for at, pts in zip(waiting[::2], waiting[1::2], strict=True)}
        for b in batches:
            for at, pts in zip(b["dec_idx"].tolist(), b["pts"].tolist(), strict=True):
                if at < due or at in early:
                    raise IngestError(f"clip {key[0]}: position {at} came twice")
                early[at] = None if pd.isna(pts) else int(pts)
        out, ended = [], False

        def emit():
            nonlocal last
            first = heapq.heappop(held)
            if first[0] < last:
                raise IngestError(f"clip {key[0]}: a picture at {first[0]} ms comes after one at {last} ms")
            last = first[0]
            out.append(first)

        heapq.heapify(held)
        while due in early and not ended:
            pts = early.pop(due)
            if pts is None:
                ended = True
                while held:
                    emit()
            else:
                heapq.heappush(held, (pts, due))
                if len(held) > depth:
                    emit()
            due += 1
        if ended and early:
            raise IngestError(f"clip {key[0]}: pictures come after its end")
        if ended:
            state.remove()
        else:
            # A waiting end has no time: -2 ** 63 stands for it.
            state.update(([x for p in held for x in p], [x for at, pts in early.items() for x in (at, _END if pts is None else pts)], last, due))
        if out:
            yield pd.DataFrame({clip: [key[0]] * len(out), "pts": [p for p, _ in out], "dec_idx": [d for _, d in out]})

    kind = pictures.schema[clip].dataType.simpleString()
    return pictures.select(clip, "pts", "dec_idx").groupBy(clip).applyInPandasWithState(step, f"{clip} {kind}, pts long, dec_idx long", "held array<long>, early array<long>, last long, due long", "append", GroupStateTimeout.NoTimeout)


_END = -(1 << 63)
