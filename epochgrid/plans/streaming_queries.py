"""A stream that runs to its end, held against the batch result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming.tracks import windowed
from .registry import E6, query, read, scaled


@query(f"""
SELECT user_id AS clip_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n, CAST(sum(round(value * {E6})) AS BIGINT) AS value_e6 FROM events GROUP BY ALL""")
def stream_daily(spark, sf_dir):
    """Events as a stream of files, summed up in daily windows under a watermark. The result is written by the stream's own
    sink and read again; the watermark lies behind all events, so that none is late."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='stream-')}"
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    table = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(table.schema)
    # A file stream reads folders; a table may be one file.
    single = all(f.endswith("/events.parquet") for f in table.inputFiles())
    events = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else stream.parquet(f"{sf_dir}/events.parquet")
    events = events.select(F.col("user_id").alias("clip_id"), F.col("ts").cast("timestamp").alias("time"), scaled(F.col("value")).alias("v"))
    sums = windowed(events, "clip_id", "time", "1 day", "400 days", F.count("*").alias("n"), F.sum("v").alias("value_e6"))
    rows = sums.select("clip_id", F.floor(F.unix_micros("window.start") / 86_400_000_000).cast("long").alias("day"), "n", "value_e6")

    def store(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = rows.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(f"{out}/rows")
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch").select("clip_id", "day", "n", "value_e6")  # one row: the last batch's number


