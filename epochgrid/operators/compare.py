"""Two artifacts side by side, and digests of their columns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Joins both on their keys: the left value as reference, and the distance; rows that only one side has are left out."""
    other = right.select(*keys, F.col(value).alias("_other"))
    met = left.join(other, keys)
    return met.withColumn("distance", F.abs(F.col(value) - F.col("_other"))).withColumnRenamed(value, "reference").drop("_other")


def metrics(met: DataFrame, by: list[str], mask: Column) -> DataFrame:
    """n, most and mae of the distances, and n and mae of those that the mask lets through."""
    return met.groupBy(*by).agg(F.count("*").alias("n"), F.max("distance").alias("most"), F.avg("distance").alias("mae"), F.count_if(mask).alias("n_masked"), F.avg(F.when(mask, F.col("distance"))).alias("mae_masked"))


def ordered_digests(rows: DataFrame, clip: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """clip, rows, and for each name the SHA-256 of that column's values as text, in order, with commas between.

    Rows of a clip are streamed in their order, whatever their number: the state is one digest for each column. Nulls are
    left out; a column of nulls has the digest of the empty text. ``order`` should leave no ties.
    """
    texts = rows.select(clip, *order, *[F.col(c).cast("string").alias(f"_{name}") for name, c in columns.items()])
    schema = rows.select(clip).schema.add("rows", "long")
    for name in columns:
        schema = schema.add(name, "string")
    kept = [clip, *[f"_{name}" for name in columns]]

    def digest(batches):
        key, n, state, begun = None, 0, [], []

        def row():
            return (key, n, *[s.hexdigest() for s in state])

        for batch in batches:
            out, at = [], 0
            runs = pc.run_end_encode(batch.column(0))
            values = [batch.column(i + 1).to_pylist() for i in range(len(columns))]
            for k, to in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if not state or k != key:
                    if state:
                        out.append(row())
                    key, n, state, begun = k, 0, [hashlib.sha256() for _ in columns], [False for _ in columns]
                for i, s in enumerate(state):
                    found = [x for x in values[i][at:to] if x is not None]
                    if found:
                        s.update(("," * begun[i] + ",".join(found)).encode())
                        begun[i] = True
                n, at = n + to - at, to
            kind = batch.schema.field(0).type
            yield _batch(out, kind, schema.names)
        if state:
            yield _batch([row()], kind, schema.names)

    return texts.repartition(clip).sortWithinPartitions(clip, *order).select(*kept).mapInArrow(digest, schema)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [kind, pa.int64(), *[pa.string()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
