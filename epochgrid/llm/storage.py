"""Tables that are written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the one set on its context.

    Where neither is set, a folder of this machine is used in local mode only; on a cluster that is an error, since
    executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _LOCAL not in _FOLDERS:
        _FOLDERS[_LOCAL] = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return _FOLDERS[_LOCAL]


_LOCAL = "local"
#: The folder of this process, made on first use in local mode.
_FOLDERS: dict[str, str] = {}


#: Bytes of input that make a task of their own.
TASK_BYTES = 64 << 20


def gathered(df: DataFrame, source: DataFrame) -> DataFrame:
    """df in as many tasks as source needs: one for each TASK_BYTES, at least two for each core.

    Small inputs may lie in many tiny partitions; each would become a task, a file and its permissions. Partitions are
    only ever put together, so a large input keeps all of its own. Python stages go behind this, not before: a task
    that runs several of them, one for each partition, frees their buffers at its end only.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(1 << 30, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))


def kept(df: DataFrame, name: str, source: DataFrame | None = None) -> DataFrame:
    """The same rows, read from Parquet: cuts the lineage, and gives fixed rows to all later readers. source: see gathered."""
    if source is not None:
        df = gathered(df, source)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
