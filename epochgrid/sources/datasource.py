"""Artifacts as a Spark data source: ``spark.read.format("epochs").load(path)`` and ``df.write.format("epochs")``.

Reading: one partition for each record batch, so that a long clip is read by many tasks; filters on timestamp_ms drop
whole batches before any tensor is read. Register with ``spark.dataSource.register(EpochSource)`` in a session
with ``spark.sql.python.filterPushdown.enabled`` (epochgrid.session sets it).
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, LongType, StructType

from ..spec import IngestError


#: Files that the driver opens at a time while it plans a scan.
LISTERS = 16


def _files(path: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(path, "*.arrow"))) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise IngestError(f"no artifact at {path}")
    return found


def plain(kind: pa.Schema) -> pa.Schema:
    """Spark knows lists, but none of a fixed size."""
    return pa.schema([pa.field(f.name, pa.list_(pa.float32()) if pa.types.is_fixed_size_list(f.type) else f.type, f.nullable) for f in kind])


class BatchPartition(InputPartition):
    def __init__(self, path: str, index: int) -> None:
        self.path, self.index = path, index


class EpochReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.fieldNames()
        self.low, self.high, self.filtered = -(1 << 62), 1 << 62, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("timestamp_ms",):
                self.filtered = True
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f  # Spark filters the rows of the batches that are left

    def _batches(self, path: str) -> list[InputPartition]:
        """Batches of a file that may hold rows within the filters; without a filter the footer tells."""
        with pa.memory_map(path) as source:
            reader = pa.ipc.open_file(source)
            found = range(reader.num_record_batches)
            if self.filtered:
                times = ((i, reader.get_batch(i).column("timestamp_ms")) for i in found)
                found = [i for i, t in times if len(t) and t[-1].as_py() >= self.low and t[0].as_py() <= self.high]
            return [BatchPartition(path, i) for i in found]

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(LISTERS) as pool:
            out = [p for found in pool.map(self._batches, _files(self.path)) for p in found]
        return out or [BatchPartition("", 0)]

    def read(self, partition: BatchPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with pa.memory_map(partition.path) as source:
            batch = pa.ipc.open_file(source).get_batch(partition.index)
            columns = [batch.column(n) for n in self.names]
            yield pa.RecordBatch.from_arrays([c.cast(pa.list_(pa.float32())) if pa.types.is_fixed_size_list(c.type) else c for c in columns], names=self.names)


class Written(WriterCommitMessage):
    def __init__(self, part: str | None, rows: int) -> None:
        self.part, self.rows = part, rows


class EpochWriter(DataSourceArrowWriter):
    """One file for each task, under a hidden name until the job commits; tensors of one size each."""

    def __init__(self, path: str, overwrite: bool) -> None:
        if os.path.exists(path) and os.listdir(path) and not overwrite:
            raise IngestError(f"{path} exists, and is never replaced")
        self.path, self.job, self.overwrite = path, uuid.uuid4().hex, overwrite
        os.makedirs(path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        part = os.path.join(self.path, f".{self.job}-{uuid.uuid4().hex}.part")
        out, rows, kind = None, 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    size = lambda c: len(c[0]) if len(c) else 0
                    kind = pa.schema([pa.field(n, pa.list_(pa.float32(), size(batch.column(i))) if pa.types.is_list(batch.column(i).type) else batch.column(i).type) for i, n in enumerate(batch.schema.names)])
                    out = pa.ipc.new_file(part, kind)
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kind, strict=True)], schema=kind))
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(part if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """All files are verified before one is published, and old ones go when all new ones are there."""
        old = glob.glob(os.path.join(self.path, "*.arrow"))
        written = [m for m in messages if m is not None and m.part]
        for m in written:
            with pa.memory_map(m.part) as source:
                found = pa.ipc.open_file(source)
                if sum(found.get_batch(k).num_rows for k in range(found.num_record_batches)) != m.rows:
                    raise IngestError("the written file is not complete")
        for i, m in enumerate(written):
            os.rename(m.part, os.path.join(self.path, f"part-{i:05d}-{self.job}.arrow"))
        if self.overwrite:
            for path in old:
                os.unlink(path)
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        for part in glob.glob(os.path.join(self.path, f".{self.job}-*.part")):
            os.unlink(part)


class EpochSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> StructType:
        with pa.memory_map(_files(self.options["path"])[0]) as source:
            return from_arrow_schema(plain(pa.ipc.open_file(source).schema))

    def reader(self, schema: StructType) -> EpochReader:
        return EpochReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> EpochWriter:
        for f in schema.fields:
            if not isinstance(f.dataType, LongType) and not (isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, FloatType)):
                raise IngestError(f"column {f.name} is neither a long nor a float tensor")
        return EpochWriter(self.options["path"], overwrite)
