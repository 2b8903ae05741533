"""Whole-text tokenising and hashing in numpy, shared by the Python-side operators.

Texts of one Arrow batch are joined into blocks of about ``BLOCK`` bytes, so that every step below costs a few
vector operations per block and not per document. A longer document is a block by itself. All hashes are 64 bits
wide and depend on the bytes alone, so they are the same on every executor and in every retry.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 18

_U = np.uint64
#: Odd multipliers of the polynomial and of the finaliser.
_BASE, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_POWERS = np.ones(1, dtype=_U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * _BASE)])
    return _POWERS


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each of the non-empty, ordered, disjoint byte spans."""
    if not len(starts):
        return np.empty(0, dtype=_U)
    out = np.empty(len(starts), dtype=_U)
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(starts):  # in slices, so that a very long document needs no more memory than a block
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, side="right")) - 1)
        n = lengths[at:to]
        first = bounds[at:to] - bounds[at]
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        values = _BYTE[data[np.repeat(starts[at:to], n) + within]]
        with np.errstate(over="ignore"):
            values = values * _powers(int(n.max()) + 1)[within]
            out[at:to] = mix(np.add.reduceat(values, first) + n.astype(_U) * _M2)
        at = to
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words; window i starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        out = np.full(n, _U(size), dtype=_U)
        for k in range(size):
            out = (out ^ words[k : k + n]) * _BASE
            out ^= out >> _U(29)
        return mix(out)


#: Windows that are rolled over at once: bounds the tables of powers.
_ROLL = 1 << 16


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words by a rolling polynomial, in a few passes whatever the size.

    Window i is the sum of word i + k times the base to the power k: a difference of two running sums, freed of the power
    of its first word. The base is odd, so its powers have inverses modulo 2**64.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    length = min(len(words), _ROLL + size - 1)
    powers, inverses = _powers(length)[:length], _inverses(length)[:length]
    out = np.empty(n, dtype=_U)
    with np.errstate(over="ignore"):
        for at in range(0, n, _ROLL):
            part = words[at : at + _ROLL + size - 1]
            total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(part * powers[: len(part)], dtype=_U)])
            rolled = total[size:] - total[:-size]
            out[at : at + len(rolled)] = rolled * inverses[: len(rolled)]
        return mix(out)


_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_INVERSES = np.ones(1, dtype=_U)


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    while len(_INVERSES) < n:
        with np.errstate(over="ignore"):
            _INVERSES = np.concatenate([_INVERSES, _INVERSES * (_INVERSES[-1] * _INVERSE)])
    return _INVERSES


#: The bytes of white space; no other UTF-8 sequence holds them.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[_SPACE] = 0
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[128:] = 1


class Block:
    """Some texts in one byte array: text i is ``data[bounds[i]:bounds[i + 1] - 1]`` and ends with a separator."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
        self.n = len(texts)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of ``[^\\x20\\x09-\\x0D]``."""
        solid = ~_SPACE[self.data]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if len(solid) and solid[0]:
            edge = np.concatenate([[0], edge])
        return edge[::2], edge[1::2]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of letters and digits, and of the runs of other signs."""
        kind = _CLASS[self.data]
        edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
        starts, ends = edge[:-1], edge[1:]
        keep = kind[starts] != 0
        return starts[keep], ends[keep]

    def firsts(self, starts: np.ndarray) -> np.ndarray:
        """For each text, the index of its first span; with one more entry, the number of spans."""
        return np.searchsorted(starts, self.bounds)

    def lowered(self) -> np.ndarray:
        return _LOWER[self.data]


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[i]:firsts[i + 1]]; 0 for an empty range."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[firsts[1:]] - total[firsts[:-1]]


def float_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The same for floats: each range is added up by itself, so that a sum does not depend on its neighbours."""
    out = np.zeros(len(firsts) - 1)
    some = np.flatnonzero(firsts[1:] > firsts[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, firsts[:-1][some])
    return out


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about ``BLOCK`` characters, each with the index of its first; a null counts as empty."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= BLOCK or i + 1 == len(texts):
            yield at, [t or "" for t in texts[at : i + 1]]
            at, size = i + 1, 0


#: Rows of a batch between the JVM and Python. Texts are a few kB each: Spark's own 10,000 rows would be large buffers.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """``work(pyarrow.RecordBatch) -> pyarrow.RecordBatch`` (or an iterable of them) over the named columns only.

    Lowers the session's rows per Arrow batch to BATCH_ROWS if they are more.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.select(*columns).mapInArrow(run, schema)


def as_rows(df: DataFrame) -> DataFrame:
    """One column, row: whatever the columns of df are called, no added column clashes. ``select("row.*")`` undoes it."""
    return df.select(F.struct("*").alias("row"))


def texts_of(batch: pa.RecordBatch, text_col: str) -> list[str | None]:
    """The column of this name, else the field of this name of the column row."""
    names = batch.schema.names
    column = batch.column(names.index(text_col)) if text_col in names else pc.struct_field(batch.column(names.index("row")), [text_col])
    return column.to_pylist()
