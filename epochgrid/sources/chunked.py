"""Video files decoded by several tasks each: units are planned as a DataFrame, and every chunk is decoded by itself.

1. One pass over the files gives a row for each access unit: time, place in the file, and what its headers say.
2. Pictures are chosen for epochs, units that nobody needs are left out, and clips are cut at clean sync pictures, all by
   the operators that the queries use. H.265 is cut only at random access pictures without leading pictures.
3. A chunk is a row: the bytes from its first to its last unit, its units, and the audio of its epochs. Chunks are dealt to
   tasks one by one, so a long file is decoded by as many tasks as it has chunks. Tensors are not shuffled.

Rows are the same as ``ingest.epoch_table`` gives. A file that is not an MP4 with video, or that fails, is an error of the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, nal
from ..operators.chunks import assign_to_chunks, plan_chunks
from ..operators.selection import chosen_pictures
from ..operators.skip import decodable
from ..spec import IngestError, IngestSpec
from . import codecs, convert, mp4
from .ingest import EPOCH_SCHEMA

_UNIT = "path string, dec_idx long, pts long, is_sync boolean, disposable boolean, presented boolean, offset long, size long, total long, window_ms long"
_TRACK = "path string, codec string, config binary, width int, height int, bt709 boolean, full boolean, has_audio boolean"
_SOUND = "path string, epoch long, mel array<float>, valid long"


def _opened(path: str, data: bytes) -> tuple[int, mp4.Track | None, mp4.Track]:
    if not path.lower().endswith(".mp4"):
        raise IngestError(f"{path}: only .mp4 files have chunks of video")
    scale, tracks = mp4.parse(data)
    audio, video = mp4.check(tracks)
    if video is None:
        raise IngestError(f"{path}: no video track")
    return scale, audio, video


def _per_file(files: DataFrame, schema: str, work) -> DataFrame:
    """work(path, data) yields tuples of lists or arrays, a batch each, for the columns behind path."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for columns in work(path, data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(columns[0]), pa.string()), *columns], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def unit_table(files: DataFrame, spec: IngestSpec) -> DataFrame:
    """A row for each access unit of the files' video tracks."""

    def work(path, data):
        scale, audio, video = _opened(path, data)
        pictures = convert.mp4_pictures(data, video, scale)
        total = convert.epoch_count(convert.audio_span(audio, scale) if audio else None, pictures, spec)
        raw = [data[u.offset : u.offset + u.size] for u, _ in pictures.units]
        if video.codec == "avc1":
            prefix = (video.config[4] & 3) + 1 if len(video.config) > 4 else 0
            sync = [u.is_sync and nal.avc_idr(r, prefix) for (u, _), r in zip(pictures.units, raw, strict=True)]
            free = [nal.avc_disposable(r, prefix) for r in raw]
        else:
            prefix = convert.parameter_sets(video)[0]
            kinds = [nal.hevc_classify(r, prefix) for r in raw]
            top = max((h[2] for r in raw for h in nal.hevc_headers(r, prefix)), default=0)
            sync = [irap and not (i + 1 < len(kinds) and kinds[i + 1][1]) for i, (irap, _) in enumerate(kinds)]
            free = [nal.hevc_disposable(r, prefix, top) for r in raw]
        times = [t for _, t in pictures.units]
        shown = [0 <= t < pictures.duration_ms for t in times]
        if not any(shown):
            raise IngestError(f"{path}: no picture is presented")
        n, units = len(times), [u for u, _ in pictures.units]
        longs = lambda x: pa.array(x, pa.int64())
        yield longs(range(n)), longs(times), pa.array(sync, pa.bool_()), pa.array(free, pa.bool_()), pa.array(shown, pa.bool_()), longs([u.offset for u in units]), longs([u.size for u in units]), longs([total] * n), longs([spec.window_ms] * n)

    return _per_file(files, _UNIT, work)


def track_table(files: DataFrame, decoders: dict | None = None) -> DataFrame:
    """A row for each file: how its video is decoded and converted, after all checks of its parameter sets."""

    def work(path, data):
        codecs.register_all(decoders)
        _, audio, video = _opened(path, data)
        codecs.decoder(video.codec)
        bt709, full = convert.colours(video)
        yield pa.array([video.codec]), pa.array([video.config], pa.binary()), pa.array([video.width], pa.int32()), pa.array([video.height], pa.int32()), pa.array([bt709]), pa.array([full]), pa.array([audio is not None])

    return _per_file(files, _TRACK, work)


def sound_table(files: DataFrame, spec: IngestSpec, decoders: dict | None = None) -> DataFrame:
    """Audio tensors of each epoch; no row for a file without audio."""

    def work(path, data):
        codecs.register_all(decoders)
        scale, audio, video = _opened(path, data)
        if audio is None:
            return
        sound = convert.mp4_sound(data, audio, scale, spec)
        total = convert.epoch_count(sound, convert.mp4_pictures(data, video, scale), spec)
        for e in range(0, total, convert.TOGETHER):
            n = min(convert.TOGETHER, total - e)
            mels, valid = kernels.epoch_mels(sound.mono, 0, sound.length, sound.rate, e, n, spec.frames, sound.delay, sound.total, sound.available)
            yield pa.array(range(e, e + n), pa.int64()), pa.array(list(mels), pa.list_(pa.float32())), pa.array(valid, pa.int64())

    return _per_file(files, _SOUND, work)


def plan(files: DataFrame, spec: IngestSpec) -> DataFrame:
    """path, chunk_id, lo and hi (bytes), units and chosen pictures of each chunk that presents any."""
    units = unit_table(files, spec)
    chosen = chosen_pictures(units.where("presented"), "path").groupBy("path", "pts", "beg", "fin").agg(F.lit(1).alias("one"))
    chosen = chosen.select("path", "pts", "beg", "fin")
    chunks = plan_chunks(units.select("path", "dec_idx", "pts", "is_sync"), spec.chunk_target_ms, "path")
    used = decodable(units, chosen, "path") if spec.skip_nonref else units
    owned = assign_to_chunks(used.select("path", "dec_idx", "pts", "offset", "size"), chunks, "path")
    # Of pictures with equal times, the first in decode order is as good as any: the decoder gives them by time.
    met = owned.join(chosen, ["path", "pts"], "left")
    unit = F.struct("dec_idx", "pts", "offset", "size", "beg", "fin")
    out = met.groupBy("path", "chunk_id").agg(F.array_sort(F.collect_list(unit)).alias("units"), F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("size")).alias("hi"))
    return out.where(F.exists("units", lambda u: u["fin"].isNotNull()))


def chunked_epoch_table(files: DataFrame, spec: IngestSpec | None = None, decoders: dict | None = None) -> DataFrame:
    """Epoch rows of MP4 files with video, a task's work for each chunk. files: path and content; paths must be distinct.

    decoders: by code, those that the tasks register; without it, what their processes have registered themselves.
    """
    spec = spec or IngestSpec()
    chunks = plan(files, spec)
    # Epochs of a chunk by key, so that audio comes to the video and not the other way.
    picture = F.explode(F.filter("units", lambda u: u["fin"].isNotNull())).alias("u")
    span = chunks.select("path", "chunk_id", picture).select("path", "chunk_id", F.explode(F.sequence("u.beg", F.col("u.fin") - 1)).alias("epoch")).distinct()
    sound = span.join(sound_table(files, spec, decoders), ["path", "epoch"]).groupBy("path", "chunk_id").agg(F.collect_list(F.struct("epoch", "mel", "valid")).alias("sound"))
    held = files.select("path", "content")
    met = chunks.join(track_table(files, decoders), "path").join(sound, ["path", "chunk_id"], "left").join(held, "path")
    met = met.withColumn("content", F.substring("content", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")))
    names = ["path", "chunk_id", "lo", "content", "units", "codec", "config", "width", "height", "bt709", "full", "has_audio", "sound"]
    # A number, since chunks are small in bytes and not in work: they must not be put together by size.
    tasks = spec.video_workers or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select(*names).repartition(tasks, "path", "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_all(decoders)
        for batch in batches:
            for row in batch.to_pylist():
                held = []
                for one in _decoded(row, spec):
                    held.append(one)
                    if len(held) == spec.batch_epochs:
                        yield _rows(row["path"], held)
                        held = []
                if held:
                    yield _rows(row["path"], held)

    return dealt.mapInArrow(run, EPOCH_SCHEMA)


def _decoded(row: dict, spec: IngestSpec) -> Iterator[tuple]:
    """(timestamp, valid hops, picture's time, picture, mel) of a chunk's epochs."""
    track = mp4.Track(kind="video", codec=row["codec"], config=row["config"], width=row["width"], height=row["height"])
    at = row["lo"]
    units = [(mp4.Sample(u["dec_idx"], 0, 0, 0, False, u["offset"] - at, u["size"]), u["pts"]) for u in row["units"]]
    chosen = iter(sorted({(u["pts"], u["beg"], u["fin"]) for u in row["units"] if u["fin"] is not None}))
    sound = {s["epoch"]: s for s in row["sound"] or ()}
    silence = np.full(spec.frames * kernels.MELS, kernels.SILENCE, np.float32)
    for pts, tensor, beg, fin in convert.pictures_of(track, units, row["content"], chosen, spec, row["bt709"], row["full"]):
        for epoch in range(beg, fin):
            s = sound.get(epoch)
            if s is None and row["has_audio"]:
                raise IngestError(f"{row['path']}: epoch {epoch} has no audio")
            yield epoch * spec.window_ms, s["valid"] if s else 0, pts, tensor, s["mel"] if s else silence


def _rows(path: str, rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    longs = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(flat) // n), pa.int32()), pa.array(flat, pa.float32())) for flat in (np.concatenate([np.asarray(r[k], np.float32) for r in rows]) for k in (3, 4))]
    return pa.RecordBatch.from_arrays([pa.array([path] * n), *longs, *lists], names=["path", "timestamp_ms", "audio_valid_frames", "video_timestamp_ms", "video_tensor", "audio_mel_tensor"])


def chunk_counts(files: DataFrame, spec: IngestSpec | None = None) -> DataFrame:
    """path, chunks and units that are decoded, without decoding anything."""
    spec = spec or IngestSpec()
    w = Window.partitionBy("path")
    return plan(files, spec).select("path", "chunk_id", F.size("units").alias("n")).withColumn("chunks", F.count("*").over(w)).groupBy("path", "chunks").agg(F.sum("n").alias("decoded"))
