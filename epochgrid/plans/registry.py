"""Queries by name, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeline import ceil_div, seconds_to_ms, ticks_to_seconds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000
E6 = 1_000_000


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scaled(value: Column, by: int = E6) -> Column:
    """Floats leave a query as whole multiples of 1 / by, so that equal results are equal rows."""
    return F.round(value * float(by)).cast("long")


#: The events of a user as a track: time in ms since the user's first event, and a decode order that permutes each group
#: of four pictures like I P B B.
TRACK_SQL = """
stamped AS (
  SELECT user_id AS clip_id, event_id, event_type, value, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS ticks,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn
  FROM events
), track AS (
  SELECT *, CAST(round(ticks / 1e6 * 1e3) AS BIGINT) AS pts, event_type = 'signup' AS is_sync, event_type = 'view' AS disposable,
    row_number() OVER (PARTITION BY clip_id ORDER BY rn - rn % 4 + CASE rn % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END) - 1 AS dec_idx
  FROM stamped
)"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle and one sort by clip: the decode order follows from the place in time.

    Four pictures that are complete are permuted; the fewer ones that a clip may end with keep their order.
    """
    events = read(spark, sf_dir, "events")
    clip = Window.partitionBy("clip_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    out = events.select(F.col("user_id").alias("clip_id"), "event_id", "event_type", "value", micros.alias("us"))
    out = out.withColumns({"ticks": F.col("us") - F.min("us").over(clip), "_n": F.count("*").over(clip), "rn": F.row_number().over(clip.orderBy("us", "event_id")).cast("long") - 1})
    nth = F.col("rn") % 4
    first = F.col("rn") - nth
    place = F.when(first + 4 > F.col("_n"), nth).when(nth == 0, 0).when(nth == 3, 1).otherwise(nth + 1)
    return out.withColumns({
        "pts": seconds_to_ms(ticks_to_seconds(F.col("ticks"), 1e6)),
        "is_sync": F.col("event_type") == "signup",
        "disposable": F.col("event_type") == "view",
        "dec_idx": first + place,
    }).drop("us", "_n")


def gridded(samples: DataFrame, window_ms: int = HOUR, extra: int = 0) -> DataFrame:
    """Adds total and window_ms: the clip's epochs up to its last picture, and ``extra`` ms more."""
    last = F.max("pts").over(Window.partitionBy("clip_id"))
    return samples.withColumns({"total": ceil_div(last + 1 + extra, window_ms), "window_ms": F.lit(window_ms).cast("long")})
