"""Where a track can be cut so that its chunks decode apart.

The greedy cuts are a fold over the clean candidates of a clip only, whose state is one number; candidates come from two
windows that share a sort. A clip's candidates are at most its samples, which ``MAX_SAMPLES`` bounds.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 32 MiB of planning memory at 192 bytes a sample.
PLAN_BYTES, SAMPLE_BYTES = 32 << 20, 192
MAX_SAMPLES = PLAN_BYTES // SAMPLE_BYTES
#: Pictures that the reorder buffer holds.
REORDER = 34


def clean_cuts(samples: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Adds prefix_max, suffix_min and clean: a sync picture before which all pictures present earlier."""
    w = Window.partitionBy(clip).orderBy("dec_idx")
    out = samples.withColumns({"prefix_max": F.max("pts").over(w.rowsBetween(Window.unboundedPreceding, -1)), "suffix_min": F.min("pts").over(w.rowsBetween(0, Window.unboundedFollowing))})
    return out.withColumn("clean", F.col("is_sync") & F.coalesce(F.col("prefix_max") < F.col("suffix_min"), F.lit(True)))


def _greedy(candidates: Column, start: Column, target: int) -> Column:
    """Candidates (at, value) that are cut: each lies at least target after the cut before it."""
    state = F.struct(start.cast("long").alias("last"), F.array().cast("array<bigint>").alias("cuts"))

    def step(s: Column, c: Column) -> Column:
        cut = c["value"] - s["last"] >= target
        return F.struct(F.when(cut, c["value"]).otherwise(s["last"]).alias("last"), F.when(cut, F.concat(s["cuts"], F.array(c["at"]))).otherwise(s["cuts"]).alias("cuts"))

    return F.aggregate(candidates, state, step, lambda s: s["cuts"])


def _ranges(folded: DataFrame, clip: str) -> DataFrame:
    """Half-open ranges of decode positions from the cuts and the number of samples."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts"), F.array(F.col("n")))
    out = folded.select(clip, edges.alias("e")).select(clip, "e", F.posexplode(F.slice("e", F.lit(1), F.size("e") - 1)).alias("chunk_id", "dec_lo"))
    return out.select(clip, F.col("chunk_id").cast("long"), "dec_lo", F.get("e", F.col("chunk_id") + 1).alias("dec_hi"))


def _counted(samples: DataFrame, clip: str) -> DataFrame:
    return samples.withColumn("_samples", F.count("*").over(Window.partitionBy(clip)))


def plan_chunks(samples: DataFrame, target_ms: int, clip: str = "clip_id") -> DataFrame:
    """clip, chunk_id, dec_lo, dec_hi. dec_idx must count from 0 in each clip.

    A cut is made at a clean candidate whose suffix minimum lies target_ms or more after that of the chunk's start. A clip
    of more than MAX_SAMPLES pictures is one chunk, so that what is gathered for a clip is bounded.
    """
    marked = _counted(clean_cuts(samples, clip), clip)
    candidate = F.when(F.col("clean") & (F.col("dec_idx") > 0) & (F.col("_samples") <= MAX_SAMPLES), F.struct(F.col("dec_idx").cast("long").alias("at"), F.col("suffix_min").cast("long").alias("value")))
    per_clip = marked.groupBy(clip).agg(F.array_sort(F.collect_list(candidate)).alias("c"), F.count("*").alias("n"), F.min("pts").alias("first"))
    return _ranges(per_clip.select(clip, "n", _greedy(F.col("c"), F.col("first"), target_ms).alias("cuts")), clip)


def plan_irap_chunks(samples: DataFrame, target_ms: int, clip: str = "clip_id") -> DataFrame:
    """The same with random access pictures that are not leading ones, by their own distance in time.

    A clip of more than MAX_SAMPLES pictures is an error: this plan is needed for decoding too, so there is no other way.
    """
    samples = _counted(samples, clip)
    within = F.when(F.col("_samples") <= MAX_SAMPLES, True).otherwise(F.raise_error(F.format_string("a clip has %s pictures, and at most " + str(MAX_SAMPLES) + " can be planned", "_samples")).cast("boolean"))
    candidate = F.when(within & F.col("is_irap") & ~F.col("is_rasl") & (F.col("dec_idx") > 0), F.struct(F.col("dec_idx").cast("long").alias("at"), F.col("pts").cast("long").alias("value")))
    first = F.min(F.when(F.col("dec_idx") == 0, F.col("pts")))
    per_clip = samples.groupBy(clip).agg(F.array_sort(F.collect_list(candidate)).alias("c"), F.count("*").alias("n"), first.alias("first"))
    return _ranges(per_clip.select(clip, "n", _greedy(F.col("c"), F.col("first"), target_ms).alias("cuts")), clip)


def plan_overlapping_chunks(samples: DataFrame, target_ms: int, clip: str = "clip_id") -> DataFrame:
    """clip, chunk_id, head, tail_lo, tail_hi, pts_lo, pts_hi: chunks that overlap in decoding but not in presentation.

    A chunk decodes its random access picture and then, behind its own leading run, all up to and including the next
    chunk's random access picture and leading run, which presents before that picture. It owns the times from its own
    picture to the next chunk's.
    """
    after = Window.partitionBy(clip).orderBy("dec_idx").rowsBetween(1, Window.unboundedFollowing)
    behind = samples.withColumn("behind", F.min(F.when(~F.col("is_rasl"), F.col("dec_idx"))).over(after)).select(clip, F.col("dec_idx").alias("head"), F.col("pts").alias("pts_lo"), "behind")
    starts = plan_irap_chunks(samples, target_ms, clip).select(clip, "chunk_id", F.col("dec_lo").alias("head"), "dec_hi")
    n = Window.partitionBy(clip)
    met = starts.withColumn("n", F.max("dec_hi").over(n)).join(behind, [clip, "head"])
    w = Window.partitionBy(clip).orderBy("chunk_id")
    tail_lo = F.coalesce("behind", "n")
    met = met.withColumns({"tail_lo": tail_lo, "pts_hi": F.lead("pts_lo").over(w), "tail_hi": F.lead(tail_lo).over(w)})
    return met.select(clip, "chunk_id", "head", "tail_lo", F.greatest("tail_lo", F.coalesce("tail_hi", "n")).alias("tail_hi"), "pts_lo", "pts_hi")


def unowned(samples: DataFrame, plan: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Pictures that the chunk which owns their time does not decode; none if the plan holds. One window, no range join."""
    chunk = plan.select(clip, F.col("pts_lo").alias("pts"), F.lit(0).alias("kind"), F.struct("chunk_id", "head", "tail_lo", "tail_hi").alias("c"))
    both = samples.select(clip, "pts", F.lit(1).alias("kind"), "dec_idx").unionByName(chunk, allowMissingColumns=True)
    w = Window.partitionBy(clip).orderBy("pts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("c", F.last("c", ignorenulls=True).over(w)).where("kind = 1")
    decoded = (F.col("dec_idx") == F.col("c.head")) | ((F.col("dec_idx") >= F.col("c.tail_lo")) & (F.col("dec_idx") < F.col("c.tail_hi")))
    return met.where(~F.coalesce(decoded, F.lit(False))).select(clip, "dec_idx", "pts")


def leading_runs(samples: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Adds run_of: for a leading picture in the unbroken run after a random access picture, that picture's position."""
    w = Window.partitionBy(clip).orderBy("dec_idx").rowsBetween(Window.unboundedPreceding, 0)
    last_irap = F.max(F.when(F.col("is_irap"), F.col("dec_idx"))).over(w)
    last_other = F.max(F.when(~F.col("is_irap") & ~F.col("is_rasl"), F.col("dec_idx"))).over(w)
    return samples.withColumn("run_of", F.when(F.col("is_rasl") & last_irap.isNotNull() & (F.coalesce(last_other, F.lit(-1)) < last_irap), last_irap))


def assign_to_chunks(samples: DataFrame, chunks: DataFrame, clip: str = "clip_id") -> DataFrame:
    """samples with the chunk_id that owns them: one window over samples and chunk starts, instead of a range join."""
    starts = chunks.select(clip, F.col("dec_lo").cast("long").alias("dec_idx"), "chunk_id", F.lit(0).alias("kind"))
    names = [c for c in samples.columns if c not in (clip, "dec_idx")]
    both = samples.select(clip, F.col("dec_idx").cast("long").alias("dec_idx"), F.struct(*names).alias("s"), F.lit(1).alias("kind")).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(clip).orderBy("dec_idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owned = both.withColumn("chunk_id", F.last("chunk_id", ignorenulls=True).over(w)).where("kind = 1")
    return owned.select(clip, "dec_idx", "chunk_id", "s.*")


def reorder_violations(samples: DataFrame, clip: str = "clip_id", depth: int = REORDER) -> DataFrame:
    """clip and n_late: pictures before which ``depth`` or more pictures were decoded that present later.

    Only the ``depth`` largest times seen so far matter, so the fold's state is a heap of that size; a picture that presents
    before all of these is late. Rows of a clip are streamed in decode order, whatever their number. A picture without a
    time is never late.
    """
    pictures = samples.select(clip, F.col("dec_idx").cast("long").alias("at"), F.col("pts").cast("long").alias("pts"))
    schema = pictures.select(clip).schema.add("n_late", "long")

    def fold(batches):
        key, late, top = None, -1, []  # -1: no row yet
        for batch in batches:
            keys, counts = [], []
            for k, pts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if late < 0 or k != key:
                    if late >= 0:
                        keys.append(key)
                        counts.append(late)
                    key, late, top = k, 0, []
                if pts is None:
                    continue
                if len(top) < depth:
                    heapq.heappush(top, pts)
                elif top[0] > pts:
                    late += 1
                else:
                    heapq.heapreplace(top, pts)
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(counts, pa.int64())], names=schema.names)
        if late >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([late], pa.int64())], names=schema.names)

    return pictures.repartition(clip).sortWithinPartitions(clip, "at", "pts").mapInArrow(fold, schema)


def chunk_window(workers: Column, buffer_bytes: Column, chunk_bytes: Column, chunks: Column) -> tuple[Column, Column]:
    """Chunks in flight, and workers."""
    in_flight = F.greatest(F.lit(1), F.least(workers + 1, F.floor(buffer_bytes / F.greatest(chunk_bytes, F.lit(1))))).cast("long")
    return in_flight, F.least(workers, in_flight, chunks).cast("long")
