"""Media files to epoch tables with Spark: as DataFrames, or as one artifact for each file."""

from __future__ import annotations

import json
import os
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import IngestError, IngestSpec, UsageError
from . import artifact, convert

EPOCH_SCHEMA = "path string, timestamp_ms long, audio_valid_frames long, video_timestamp_ms long, video_tensor array<float>, audio_mel_tensor array<float>"


def epoch_table(files: DataFrame, spec: IngestSpec | None = None, quarantine: bool = False) -> DataFrame:
    """Epoch rows of many files. files: path and content, as Spark's binaryFile source gives them (also as a stream).

    One file is one row and one task's work (chunked.chunked_epoch_table deals a video's chunks to several); batches of at
    most batch_epochs rows leave it, so that memory does not grow with the rows of a file, but with its bytes and its mono
    signal. Without video the two columns are null.

    A file that can't be converted fails the job. With quarantine it doesn't: there is a column error, and the file's last
    row has nothing but its path and what went wrong; rows before it are those that were made until then.
    """
    spec = spec or IngestSpec()
    schema = EPOCH_SCHEMA + ", error string" if quarantine else EPOCH_SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]

    def out(batch):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.string())], names=names) if quarantine else batch

    def failed(path, error):
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays([pa.array([path]), *empty, pa.array([str(error)])], names=names)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                try:
                    _, rows = convert.epochs(path, data.as_py(), spec)
                    for row in rows:
                        held.append(row)
                        if len(held) == spec.batch_epochs:
                            yield out(_batch(path, held))
                            held = []
                except (IngestError, ValueError) as e:
                    if not quarantine:
                        raise
                    if held:
                        yield out(_batch(path, held))
                    yield failed(path, e)
                    continue
                if held:
                    yield out(_batch(path, held))

    return files.select("path", "content").mapInArrow(run, schema)


def _batch(path: str, rows: list[dict]) -> pa.RecordBatch:
    n = len(rows)
    longs = lambda key: pa.array([r.get(key) for r in rows], pa.int64())

    def lists(key):
        if key not in rows[0]:
            return pa.nulls(n, pa.list_(pa.float32()))
        flat = np.concatenate([r[key] for r in rows])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(flat) // n), pa.int32()), pa.array(flat, pa.float32()))

    return pa.RecordBatch.from_arrays([pa.array([path] * n), longs("timestamp_ms"), longs("audio_valid_frames"), longs("video_timestamp_ms"), lists("video_tensor"), lists("audio_mel_tensor")], names=["path", "timestamp_ms", "audio_valid_frames", "video_timestamp_ms", "video_tensor", "audio_mel_tensor"])


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths))


def ingest(source: str, output: str, **options) -> dict:
    """Converts one file on this machine to a new artifact: output, epochs, seconds, and with profile=True the profile."""
    spec = IngestSpec(**{k: v for k, v in options.items() if v is not None})
    source, output = os.fspath(source), os.fspath(output)
    if not os.path.isfile(source):
        raise IngestError(f"no file at {source}")
    if os.path.exists(output):
        raise IngestError(f"{output} exists, and is never replaced")
    began = time.perf_counter()
    with open(source, "rb") as f:
        data = f.read()
    read_s = time.perf_counter() - began
    about, rows = convert.epochs(source, data, spec)
    n = artifact.write(output, artifact.schema(spec, about["has_audio"], about["has_video"], about["matrix"]), rows, spec.batch_epochs)
    out = {"output": output, "epochs": n, "seconds": time.perf_counter() - began}
    if spec.profile:
        out["profile"] = {"wall_seconds": out["seconds"], "execution": spec.execution, "stages_seconds": {"read": read_s, "convert_and_write": out["seconds"] - read_s}}
    return out


def ingest_many(spark: SparkSession, sources: list[str], out_dir: str, skip_existing: bool = False, **options) -> DataFrame:
    """One artifact for each file, in a folder that all executors share: path, output, epochs, seconds, error.

    A file that fails leaves no output and a row that says why; the others go on. A task that is run again finds the output
    of its first run complete and says so, since outputs appear whole, by renaming.
    """
    IngestSpec(**options)
    stems = Counter(os.path.splitext(os.path.basename(s))[0] for s in sources)
    twice = sorted(s for s, n in stems.items() if n > 1)
    if twice:
        raise UsageError(f"inputs share a name: {', '.join(twice)}")
    os.makedirs(out_dir, exist_ok=True)
    rows = [(s, os.path.join(out_dir, os.path.splitext(os.path.basename(s))[0] + ".arrow")) for s in sources]
    files = spark.createDataFrame(rows, "path string, output string").repartition(max(1, len(rows)))
    names = ["path", "output", "epochs", "seconds", "error"]

    def run(batches):
        from pyspark import TaskContext

        for batch in batches:
            for path, output in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                error, n, began = None, None, time.perf_counter()
                part = f"{output}.{TaskContext.get().taskAttemptId()}.part"
                try:
                    if os.path.exists(output):
                        if not skip_existing:
                            raise IngestError(f"{output} exists, and is never replaced")
                        with artifact.load(output) as d:
                            n = len(d)
                    else:
                        n = ingest(path, part, **options)["epochs"]
                        os.link(part, output)
                        os.unlink(part)
                except (IngestError, OSError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([output]), pa.array([n], pa.int64()), pa.array([time.perf_counter() - began]), pa.array([error], pa.string())], names=names)

    return files.mapInArrow(run, "path string, output string, epochs long, seconds double, error string")


def sample_table(files: DataFrame) -> DataFrame:
    """The sample tables of MP4 files, for planning without decoding."""
    from . import mp4

    schema = "path string, track int, kind string, codec string, dec_idx long, dts long, cts long, duration long, is_sync boolean, offset long, size long, timescale long"

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                for k, track in enumerate(mp4.parse(data)[1]):
                    s = mp4.samples(track, len(data))
                    n = len(s)
                    longs = lambda key: pa.array([getattr(x, key) for x in s], pa.int64())  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([k] * n, pa.int32()), pa.array([track.kind] * n, pa.string()), pa.array([track.codec] * n, pa.string()), longs("dec_idx"), longs("dts"), longs("cts"), longs("duration"), pa.array([x.is_sync for x in s], pa.bool_()), longs("offset"), longs("size"), pa.array([track.timescale] * n, pa.int64())], names=[p.split()[0] for p in schema.split(", ")])

    return files.where(F.lower("path").endswith(".mp4")).select("path", "content").mapInArrow(run, schema)


def profile_line(result: dict) -> str:
    return json.dumps(result.get("profile", {}))
