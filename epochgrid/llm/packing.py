"""Packing: repeat counts of shallow length combinations by non-negative least squares.

1. Every document is tokenised once, with id 0 at its end, and cut into windows; what remains is shorter than a window.
   The pieces are written to the shared folder, remainders with their ids.
2. The histogram of the remainders has fewer bins than the window has tokens, whatever the input. On the driver, all
   pairs and triples of present lengths that fill a window exactly are enumerated, and quadruples of the
   ``QUADRUPLE_LENGTHS`` most frequent lengths (a limit of the plan, not of the rows). Non-negative least squares, solved
   to its optimality conditions by Newton steps on the dual, finds repeat counts; they are rounded within the histogram,
   largest first, and once more over what is left.
3. Each remainder gets a rank among those of its length: rows are counted by length and block of rows, and numbered
   inside, so that a frequent length is spread over many tasks. Rank and repeat counts give sequence and offset.
4. Remainders beyond the counts are the residuals. They are packed greedily in order: each follows the last, and is cut
   where a window ends. So only the last sequence is padded. Ranking moves row numbers and lengths; ids are read again
   for the residuals alone.

Defined results: a null or empty text is one piece that holds the id 0 alone. A very long text is as many windows as it
fills, and a remainder. Rows with the same id, or none, are documents of their own. An empty table gives no row. Columns
other than the named ones are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .storage import gathered, kept
from .text import map_batches

WINDOW = 1024
#: Lengths that quadruples are made of, besides the one that fills up.
QUADRUPLE_LENGTHS = 40


# --- tokens -----------------------------------------------------------------------------------------------------------


class Tokens:
    """Ids of a text. Pieces of ordinary size go through the ranked library, which gives the same ids faster."""

    _LONG = 20_000

    def __init__(self, path: str) -> None:
        import tiktoken

        self.own = bpe.encoder(path)
        m = self.own.merges
        self.fast = None
        if m.ranked:
            ranks = {b: i for i, b in enumerate(m.bytes) if i not in m.specials.values()}
            self.fast = tiktoken.Encoding("ranked", pat_str=bpe.PATTERN.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not self.own.special.search(text) and (len(text) < self._LONG or max(map(len, text.split(" "))) < self._LONG):
            return np.array(self.fast(text), dtype="<u4")
        return np.frombuffer(self.own.encode(text), dtype="<u4")


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


# --- the plan ---------------------------------------------------------------------------------------------------------


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to four present lengths, falling, with zeros behind, whose sum is the window."""
    have = np.zeros(window + 1, dtype=bool)
    have[np.flatnonzero(counts)] = True
    have[0] = False
    lengths = np.flatnonzero(have)
    rows = []
    for a in lengths:
        b = window - a
        if 0 < b <= a and have[b]:
            rows.append(np.array([[a, b, 0, 0]]))
        bs = lengths[(lengths <= a) & (lengths >= (window - a + 1) // 2) & (lengths < window - a)]
        cs = window - a - bs
        ok = have[cs] & (cs <= bs)
        if ok.any():
            rows.append(np.stack([np.full(ok.sum(), a), bs[ok], cs[ok], np.zeros(ok.sum(), dtype=int)], axis=1))
    top = np.sort(np.argsort(-counts, kind="stable")[:QUADRUPLE_LENGTHS])
    top = top[have[top]]
    for i, a in enumerate(top):
        for j, b in enumerate(top[: i + 1]):
            cs = top[: j + 1]
            ds = window - a - b - cs
            ok = (ds > 0) & have[np.clip(ds, 0, window)]
            if ok.any():
                four = np.stack([np.full(ok.sum(), a), np.full(ok.sum(), b), cs[ok], ds[ok]], axis=1)
                rows.append(-np.sort(-four, axis=1))
    return np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 4), dtype=int)


def repeat_counts(counts: np.ndarray, columns: np.ndarray, ridge: float = 1e-5, steps: int = 200) -> np.ndarray:
    """x >= 0 that makes columns * x closest to the histogram: non-negative least squares, solved to optimality.

    There are far more columns than lengths, so many x are equally close; a small ridge picks the one that spreads most.
    With it, x = max(0, A'r) / ridge for the residual r, and r solves r + A x = counts: as many unknowns as lengths. Newton
    steps with a line search on the convex dual find it; see optimality for the conditions that hold at the end.
    """
    size, target = len(counts), counts.astype(float)
    scale = max(1.0, float(target.max(initial=0)))
    target /= scale
    used = (columns > 0).astype(float)

    def reach(r):
        return np.maximum(0, (r[columns] * used).sum(axis=1))

    def value(r, y):
        return r @ r / 2 + y @ y / (2 * ridge) - target @ r

    r = np.zeros(size)
    y = reach(r)
    for _ in range(steps):
        slope = r + np.bincount(columns.ravel(), (used * y[:, None]).ravel(), minlength=size) / ridge - target
        if np.abs(slope).max() < 1e-9:
            break
        # Columns at the edge count as active in the first step, where all are.
        active = columns[y > 0] if y.any() else columns
        on = (active > 0).astype(float)
        pairs = active[:, :, None] * size + active[:, None, :]
        hessian = np.bincount(pairs.ravel(), (on[:, :, None] * on[:, None, :]).ravel(), minlength=size * size).reshape(size, size) / ridge
        hessian[np.diag_indices(size)] += 1
        go = -np.linalg.solve(hessian, slope)
        step, now = 1.0, value(r, y)
        while step > 1e-12:
            new = r + step * go
            y_new = reach(new)
            if value(new, y_new) <= now + 1e-4 * step * (slope @ go):
                break
            step /= 2
        else:
            break
        r, y = new, y_new
    return y * (scale / ridge)


def optimality(counts: np.ndarray, columns: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Of the problem without a ridge: the distance, the most negative slope, and the steepest slope where x > 0.

    At the optimum no slope is negative, and none is steep where x > 0.
    """
    used = (columns > 0).astype(float)
    miss = np.bincount(columns.ravel(), (used * x[:, None]).ravel(), minlength=len(counts)) - counts
    slope = (miss[columns] * used).sum(axis=1)
    return float(np.linalg.norm(miss)), float(min(0, slope.min(initial=0))), float(np.abs(slope[x > 0]).max(initial=0))


def rounded(counts: np.ndarray, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole repeat counts that stay within the histogram."""
    left = counts.astype(np.int64).copy()
    out = np.zeros(len(columns), dtype=np.int64)
    parts = [[(int(k), int(m)) for k, m in zip(*np.unique(c[c > 0], return_counts=True), strict=True)] for c in columns]
    order = np.argsort(-x, kind="stable")
    for whole in (True, False):
        for i in order:
            n = min(left[k] // m for k, m in parts[i])
            if whole:
                n = min(n, int(np.ceil(x[i] - 0.25)))
            if n > 0:
                out[i] += n
                for k, m in parts[i]:
                    left[k] -= n * m
    return out


class Plan:
    """Where the remainder of a length and rank goes: sequence and offset, or none."""

    def __init__(self, counts: np.ndarray, window: int) -> None:
        columns = combinations(counts, window)
        n = rounded(counts, columns, repeat_counts(counts, columns)) if len(columns) else np.zeros(0, dtype=np.int64)
        columns, n = columns[n > 0], n[n > 0]
        self.sequences = int(n.sum())
        base = np.cumsum(n) - n
        slots: list[tuple[int, int, int, int]] = []  # length, repeats, first sequence, offset
        for c, k, first in zip(columns, n, base, strict=True):
            at = 0
            for length in c[c > 0]:
                slots.append((int(length), int(k), int(first), at))
                at += int(length)
        slots.sort()
        self.slots = np.array(slots, dtype=np.int64).reshape(-1, 4)
        self.first = np.searchsorted(self.slots[:, 0], np.arange(window + 1))
        self.ends = np.cumsum(self.slots[:, 1])
        self.begins = self.ends - self.slots[:, 1]

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset; -1 for a residual."""
        if not len(self.slots):
            none = np.full(len(lengths), -1, dtype=np.int64)
            return none, none
        first, past = self.first[lengths], self.first[lengths + 1]
        start = np.where(first < len(self.begins), self.begins[np.minimum(first, len(self.begins) - 1)], 0)
        total = np.where(past > first, self.ends[np.maximum(past, 1) - 1] - start, 0)
        at = np.minimum(np.searchsorted(self.ends, start + ranks, side="right"), len(self.slots) - 1)
        ok = ranks < total
        return np.where(ok, self.slots[at, 2] + start + ranks - self.begins[at], -1), np.where(ok, self.slots[at, 3], -1)


# --- rows -------------------------------------------------------------------------------------------------------------


def pieces(documents: DataFrame, window: int, path: str) -> DataFrame:
    """A row for each window of a document and for its remainder: doc_id, start, length, crc, doc_tokens, ids."""
    schema = documents.select("doc_id").schema.add("start", "long").add("length", "long").add("crc", "long").add("doc_tokens", "long").add("ids", "binary")

    def work(batch):
        enc = tokens(path)
        row, start, length, crc, total, kept_ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = enc.encode(text or "")
            raw, n = ids.tobytes() + b"\0\0\0\0", len(ids) + 1
            for at in range(0, n, window):
                part = raw[4 * at : 4 * (at + window)]
                row.append(i)
                start.append(at)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
                kept_ids.append(part if len(part) < 4 * window else None)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(kept_ids, pa.binary())], names=schema.names)

    return map_batches(documents, ["doc_id", "text"], schema, work)


def pack(documents: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    made = pieces(gathered(documents, documents), window, path or bpe.vocabulary_path())
    # The number of a row is fixed from here on, as the rows are written.
    made = kept(made.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = made.where(F.col("length") == window)
    rest = made.where(F.col("length") < window).withColumn("block", F.shiftright("uid", 33))

    by_block = kept(rest.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths", documents)
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect():  # fewer rows than the window has tokens
        counts[r[0]] = r[1]
    plan = Plan(counts, window)
    shared = spark.sparkContext.broadcast(plan)

    before = by_block.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = rest.drop("ids").join(before.hint("shuffle_merge"), ["length", "block"]).withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("uid")) - 1 + F.col("before"))
    columns = ["doc_id", "start", "length", "crc", "doc_tokens", "uid", "rank"]
    schema = ranked.select(*columns[:-1]).schema.add("sequence", "long").add("offset", "long")

    def place(batch):
        sequence, offset = shared.value.place(np.asarray(batch.column(2)), np.asarray(batch.column(6)))
        return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sequence), pa.array(offset)], names=schema.names)

    placed = kept(map_batches(gathered(ranked, documents), columns, schema, place), "placed")
    residual = placed.where(F.col("sequence") < 0).select("doc_id", "start", "length", "doc_tokens", "uid", F.shiftright("uid", 33).alias("block"))
    # One row for each block of rows: the window over all of them sees counts only.
    sums = residual.groupBy("block").agg(F.sum("length").alias("n"))
    sums = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    laid = residual.join(sums, "block").withColumn("at", F.sum("length").over(Window.partitionBy("block").orderBy("uid")) - F.col("length") + F.col("before"))
    # Written, so that Spark knows its size: if it is under the session's threshold, the ids are not shuffled.
    laid = kept(laid.select("doc_id", "start", "doc_tokens", "uid", "at"), "residual", documents).join(made.select("uid", "ids"), "uid")
    columns = ["doc_id", "start", "doc_tokens", "ids", "at"]
    out_schema = "doc_id " + id_type + ", start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batch):
        row, out = [], []
        for i, (start, total, ids, at) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
            n, done = len(ids) // 4, 0
            while done < n:
                take = min(n - done, window - (at + done) % window)
                row.append(i)
                out.append((start + done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), total, 4 * ((at + done) // window) + 2, (at + done) % window))
                done += take
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    names = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens"]
    first = whole.select(*names, (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    second = placed.where(F.col("sequence") >= 0).select(*names, (F.col("sequence") * 4 + 1).alias("sequence_id"), "offset")
    return gathered(first.unionByName(second), documents).unionByName(map_batches(gathered(laid, documents), columns, out_schema, cut))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
