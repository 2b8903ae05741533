"""Which picture serves which epoch: a nearest as-of join without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeline import div


def pictures(samples: DataFrame, clip: str = "clip_id", order: str = "dec_idx") -> DataFrame:
    """Adds beg and fin, the half-open epochs that each picture serves. samples: clip, pts, total and a tie-breaker.

    A picture serves the epochs whose start is at or before the middle between it and the next picture, from where the
    one before ends; the first also serves what lies before it, and the last repeats to the end. One shuffle by clip;
    both windows share its sort.
    """
    w = Window.partitionBy(clip).orderBy("pts", order)
    following = F.lead("pts").over(w)
    middle = F.col("pts") + div(following - F.col("pts"), 2)
    window = F.col("window_ms")
    fin = F.when(following.isNull(), F.col("total")).otherwise(F.least(div(F.greatest(middle, F.lit(-1)), window) + 1, F.col("total")))
    out = samples.withColumn("fin", fin)
    return out.withColumn("beg", F.lag("fin", 1, 0).over(w)).withColumn("beg", F.least("beg", "total"))


def select_epochs(samples: DataFrame, clip: str = "clip_id", order: str = "dec_idx") -> DataFrame:
    """A row for each epoch: its start and its picture. The picture's row is multiplied last, after all that is done once."""
    chosen = pictures(samples, clip, order).where("fin > beg")
    return chosen.select("*", F.explode(F.sequence("beg", F.col("fin") - 1)).alias("epoch")).withColumn("timestamp_ms", F.col("epoch") * F.col("window_ms"))


def chosen_pictures(samples: DataFrame, clip: str = "clip_id", order: str = "dec_idx") -> DataFrame:
    return pictures(samples, clip, order).where("fin > beg")


def duplicates(samples: DataFrame, clip: str, pts: str) -> DataFrame:
    """Clips with the number of pictures whose time another picture has too."""
    return samples.groupBy(clip, pts).agg(F.count("*").alias("n")).groupBy(clip).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_duplicates"), F.max("n").alias("most"))
