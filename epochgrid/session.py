"""A session with the settings that wide tensor rows need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of tensors are some 600 kB wide: batches hold few of them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "32",
    "spark.sql.parquet.columnarReaderBatchSize": "32",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(app: str = "epochgrid", **settings: str) -> SparkSession:
    """For tensor tables. Other tables do better with Spark's own batch sizes."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
