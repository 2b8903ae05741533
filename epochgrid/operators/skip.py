"""Semi-join reduction before decoding: units that nothing refers to and no epoch needs are not decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def skippable(samples: DataFrame, selected: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Disposable units whose time is not selected."""
    return samples.where("disposable").join(selected.select(clip, "pts").distinct(), [clip, "pts"], "left_anti")


def decodable(samples: DataFrame, selected: DataFrame, clip: str = "clip_id") -> DataFrame:
    """What is left: one anti join on the decode position."""
    return samples.join(skippable(samples, selected, clip).select(clip, "dec_idx"), [clip, "dec_idx"], "left_anti")


def drop_leading(samples: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Leading pictures right after the first random access picture can never be decoded, and go."""
    w = Window.partitionBy(clip).orderBy("dec_idx").rowsBetween(Window.unboundedPreceding, 0)
    others = F.max(F.when((F.col("dec_idx") > 0) & ~F.col("is_rasl"), 1).otherwise(0)).over(w)
    return samples.withColumn("_others", others).where("NOT (is_rasl AND dec_idx > 0 AND _others = 0)").drop("_others")


def reconcile(expected: DataFrame, decoded: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Pairs the i-th decoded with the i-th expected picture of a clip; either side is null where the other has more."""
    number = lambda df, name: df.select(clip, F.col("pts").alias(name), F.row_number().over(Window.partitionBy(clip).orderBy("pts", "dec_idx")).alias("i"))
    return number(expected, "expected_pts").join(number(decoded, "decoded_pts"), [clip, "i"], "full")
