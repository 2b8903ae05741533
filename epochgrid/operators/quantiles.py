"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketches that narrow a group down: their error is about 1 / ACCURACY of the group's rows.
ACCURACY = 1000


def _met(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of groups; null keys are equal."""
    other = groups.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(by)], *[c for c in groups.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(by)]
    return rows.join(other, same).drop(*[f"_key{i}" for i in range(len(by))])


def quantiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float], *also: Column) -> DataFrame:
    """For each group: the aggregates ``also``, and the interpolated quantiles of value under their names.

    ``percentile`` holds all distinct values of a group in one task. Here a sketch of fixed size gives bounds around each
    quantile, the rows outside of them are counted, and only what lies within is ranked, distinct values with their counts.
    The result does not depend on the sketch: bounds that miss a rank are opened on that side. A group that holds most rows
    is sketched, counted and combined by all tasks.

    Nulls have no rank; a group without values has null quantiles. NaN is larger than all numbers.
    """
    slack = 2 / ACCURACY
    ps = list(points.values())
    ends = [e for p in ps for e in (max(0.0, p - slack), min(1.0, p + slack))]
    base = rows.withColumn("_value", F.col(value).cast("double"))
    groups = base.groupBy(*by).agg(*also, F.count("_value").alias("_n"), F.percentile_approx("_value", ends, ACCURACY).alias("_ends"))
    carried = [c for c in groups.columns if c != "_ends"]
    values = base.select(*by, "_value")

    v, n = F.col("_value"), F.col("_n")
    low, high = [[F.col("_ends")[2 * i + side] for i in range(len(ps))] for side in (0, 1)]
    sides = [c for i in range(len(ps)) for c in (F.count_if(v < low[i]).alias(f"_below{i}"), F.count_if(v > high[i]).alias(f"_above{i}"))]
    counted = _met(values, groups, by).groupBy(*carried, "_ends").agg(*sides)

    def bounds(i: int) -> Column:
        rank = (n - 1) * F.lit(ps[i])
        opened_low = F.floor(rank) < F.col(f"_below{i}")
        opened_high = F.ceil(rank) >= n - F.col(f"_above{i}")
        return F.struct(
            F.lit(i).alias("point"),
            rank.alias("rank"),
            F.when(~opened_low, low[i]).alias("low"),
            F.when(~opened_high, high[i]).alias("high"),
            F.when(opened_low, F.lit(0)).otherwise(F.col(f"_below{i}")).cast("long").alias("before"),
        )

    narrow = counted.select(*carried, F.array(*[bounds(i) for i in range(len(ps))]).alias("_bounds"))
    # Rows of a group without values stay, so that the group does.
    inside = F.filter("_bounds", lambda b: (n == 0) | (v.isNotNull() & (b["low"].isNull() | (v >= b["low"])) & (b["high"].isNull() | (v <= b["high"]))))
    near = _met(values, narrow, by).select(*carried, "_value", F.explode(inside).alias("_b"))
    near = near.select(*carried, "_value", F.col("_b.point").alias("_point"), F.col("_b.rank").alias("_rank"), F.col("_b.before").alias("_before"))
    kinds = near.groupBy(*near.columns).agg(F.count("*").alias("_m"))
    ranked = kinds.withColumn("_to", F.col("_before") + F.sum("_m").over(Window.partitionBy(*by, "_point").orderBy("_value")))
    at = lambda rank: F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_m")), v))
    pair = ranked.groupBy(*carried, "_point", "_rank").agg(at(F.floor("_rank")).alias("_lower"), at(F.ceil("_rank")).alias("_upper"))
    share = F.col("_rank") - F.floor("_rank")
    between = F.when((share == 0) | (F.col("_lower") == F.col("_upper")), F.col("_lower")).otherwise(F.col("_lower") + (F.col("_upper") - F.col("_lower")) * share)
    return pair.groupBy(*carried).agg(*[F.max(F.when(F.col("_point") == i, between)).alias(name) for i, name in enumerate(points)]).drop("_n")
