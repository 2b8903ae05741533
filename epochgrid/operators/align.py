"""The epoch table: grid, video and audio side by side, with constants where a track is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SILENCE = -10.0


def grid(clips: DataFrame, clip: str = "clip_id") -> DataFrame:
    """clips: clip, total, window_ms."""
    return clips.where("total > 0").select(clip, "window_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("epoch")).withColumn("timestamp_ms", F.col("epoch") * F.col("window_ms"))


def merge(epochs: DataFrame, video: DataFrame, audio: DataFrame, fills: dict[str, object], clip: str = "clip_id") -> DataFrame:
    """One row per epoch: two left joins on (clip, epoch) that share the grid's partitioning."""
    out = epochs.join(video, [clip, "epoch"], "left").join(audio, [clip, "epoch"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def order_check(epochs: DataFrame, clip: str = "clip_id") -> DataFrame:
    """clip, rows, gaps: epochs that don't follow the one before."""
    w = Window.partitionBy(clip).orderBy("epoch")
    marked = epochs.select(clip, "epoch", F.lag("epoch", 1, -1).over(w).alias("before"))
    return marked.groupBy(clip).agg(F.count("*").alias("rows"), F.count_if(F.col("epoch") != F.col("before") + 1).alias("gaps"))


def batches(rows: DataFrame, order: list[str], size: int, clip: str = "clip_id") -> DataFrame:
    """Adds epoch (from 0), batch_id and batch_row within each clip."""
    w = Window.partitionBy(clip).orderBy(*order)
    out = rows.withColumn("epoch", F.row_number().over(w).cast("long") - 1)
    return out.withColumns({"batch_id": F.floor(F.col("epoch") / size).cast("long"), "batch_row": F.pmod(F.col("epoch"), F.lit(size)).cast("long")})


def locate(clips: DataFrame, indices: list[int], size: int) -> DataFrame:
    """Resolves indices (negative ones from the end) to epoch, batch and row of each clip; null outside. clips: rows."""
    out = clips.withColumn("index", F.explode(F.array(*[F.lit(i).cast("long") for i in indices])))
    epoch = F.when(F.col("index") < 0, F.col("index") + F.col("rows")).otherwise(F.col("index"))
    out = out.withColumn("epoch", F.when((epoch >= 0) & (epoch < F.col("rows")), epoch))
    return out.withColumns({"batch_id": F.floor(F.col("epoch") / size).cast("long"), "batch_row": F.pmod("epoch", F.lit(size)).cast("long")})
