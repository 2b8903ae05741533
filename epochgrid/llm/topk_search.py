"""Exact top-k search by inner product: KD-trees per shard, best-first traversal, a propagated kth score.

1. Rows are dealt evenly into shards of about ``SHARD`` vectors. In each shard a KD-tree is built by median splits of
   the widest dimension, with tight bounding boxes. A shard with its tree is one written row.
2. The queries of a shard search their own shard first, which gives each a kth score.
3. Then rounds: each block of queries visits ``GROWTH`` - 1 times as many further shards as it has visited. Between rounds
   the k best of each query are merged, and the kth score that all visited shards give together goes on to the next ones,
   which return only what reaches it. A shard visited after v others has on average k / v rows that do, so that answers
   grow with the logarithm of the number of shards.
4. In a tree, the inner product with any vector of a box is at most the sum of the larger products with its bounds. Nodes
   below the kth score are skipped. A child's bound is never above its parent's, so going through the leaves that are left
   from the highest bound down is the order of a best-first traversal; the kth score rises meanwhile, and the search ends
   at the first leaf that does not reach it.

A block and a shard have bounded sizes, whatever the input; the work is queries times rows, less what is pruned.

Defined results: components become floor(scale * x) in double; vectors that are null, or that hold a null, NaN or
infinite component (or one that is infinite after scaling), take no part, and neither do null ids. Shorter vectors
count as filled up with zeros, and vectors of any length are compared whole. Products are exact: in float32 or float64
where sums fit, else in whole numbers; a score outside the range of a long becomes the nearest long. Ties go to the smaller
id. Repeated rows are rows of their own: each is a query, and all but the query's own row are candidates; equal query ids
are ranked apart. An empty table gives no row. Columns other than the named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import gathered, kept

SHARD = 8192
LEAF = 256
#: By how much a round multiplies the shards that a block has visited.
GROWTH = 3
#: For a query with fewer than k answers.
NO_SCORE = -(1 << 63)
_SHARD_SCHEMA = "shard long, n long, dim long, depth long, ids binary, vectors binary, lows binary, highs binary, cuts binary"


class Tree:
    """Vectors in leaf order. Node i has the children 2 i + 1 and 2 i + 2; the last 2 ** depth nodes are leaves."""

    def __init__(self, ids, vectors, depth, lows, highs, cuts) -> None:
        self.ids, self.vectors, self.depth, self.lows, self.highs, self.cuts = ids, vectors, depth, lows, highs, cuts

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order, cuts = np.arange(len(ids)), np.array([0, len(ids)])
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        for _ in range(depth):
            new = [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                middle = (b - a) // 2
                if b - a > 1 and vectors.shape[1]:
                    x = vectors[own]
                    axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                    order[a:b] = own[np.argpartition(x[:, axis], middle)]
                new += [a + middle, b]
            cuts = np.array(new)
        vectors, ids = vectors[order], ids[order]
        low, high = np.full((2 << depth, vectors.shape[1]), np.inf), np.full((2 << depth, vectors.shape[1]), -np.inf)
        first = (1 << depth) - 1
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                low[first + i], high[first + i] = vectors[a:b].min(axis=0), vectors[a:b].max(axis=0)
        for i in range(first - 1, -1, -1):
            low[i], high[i] = np.minimum(low[2 * i + 1], low[2 * i + 2]), np.maximum(high[2 * i + 1], high[2 * i + 2])
        return cls(ids, vectors, depth, low[:-1], high[:-1], cuts)

    def search(self, queries: np.ndarray, k: int, kth: np.ndarray, own: np.ndarray | None = None):
        """(query, row, score) of at least the k best of each query that reach kth. own: each query's row here, if any."""
        vectors, dim = self.vectors, max(self.vectors.shape[1], queries.shape[1])
        queries, vectors = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (queries, vectors))
        if not dim or not len(vectors) or not len(queries):
            q, r = np.divmod(np.arange(len(queries) * len(vectors)), max(1, len(vectors)))
            keep = np.ones(len(q), dtype=bool) if own is None else own[q] != r
            return q[keep], r[keep], np.zeros(int(keep.sum()))
        low, high = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (self.lows, self.highs))
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * dim
        whole = most >= 2**53
        kind = object if whole else np.float32 if most < 2**24 and max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) < 2**24 else np.float64
        as_kind = _whole if whole else (lambda x: x.astype(kind))
        none = np.array(NO_SCORE - 1 if whole else -np.inf, dtype=object if whole else np.float64)[()]
        up, down = as_kind(np.maximum(queries, 0)), as_kind(np.minimum(queries, 0))
        queries, vectors = as_kind(queries), as_kind(vectors)
        low, high = as_kind(np.where(np.isfinite(low), low, 0)), as_kind(np.where(np.isfinite(high), high, 0))
        kth = np.array([none if x == NO_SCORE else int(x) if whole else float(x) for x in kth.tolist()], dtype=object if whole else np.float64)
        kept_kind = object if whole else np.float64
        alive = np.ones((len(queries), 1), dtype=bool)
        for level in range(self.depth + 1):  # down the tree, for all queries at once; a node counts if its box may reach the kth score
            nodes = np.arange((1 << level) - 1, (2 << level) - 1)
            if level:
                alive = np.repeat(alive, 2, axis=1)
            some = np.flatnonzero(alive.any(axis=0))
            bound = np.full(alive.shape, none, dtype=kept_kind)
            bound[:, some] = up @ high[nodes[some]].T + down @ low[nodes[some]].T
            alive &= (bound >= kth[:, None]).astype(bool)
        bound[~alive] = none
        order = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(queries), k), none, dtype=kept_kind)
        rows = np.arange(len(queries))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            value = bound[rows, leaf]
            go = np.flatnonzero((value >= kth) & (value > none))
            if not len(go):
                break
            go = go[np.argsort(leaf[go], kind="stable")]
            at = leaf[go]
            edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                q, (a, b) = go[s:e], self.cuts[at[s] : at[s] + 2]
                if b == a:
                    continue
                score = (queries[q] @ vectors[a:b].T).astype(kept_kind)
                if whole:
                    score = np.clip(score, -(1 << 63), (1 << 63) - 1)
                if own is not None:
                    mine = np.flatnonzero((own[q] >= a) & (own[q] < b))
                    score[mine, own[q][mine] - a] = none
                both = np.concatenate([best[q], score], axis=1)
                both = np.sort(both, axis=1)[:, -k:] if whole else -np.partition(-both, k - 1, axis=1)[:, :k]
                best[q] = both
                kth[q] = np.maximum(kth[q], both.min(axis=1))
                i, j = np.nonzero(((score >= kth[q][:, None]) & (score > none)).astype(bool))
                found.append((q[i], a + j, score[i, j]))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        q, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = (s >= kth[q]).astype(bool)
        return q[keep], r[keep], s[keep].astype(np.int64) if whole else s[keep]


def _whole(x: np.ndarray) -> np.ndarray:
    """Python's whole numbers, for components whose products do not fit a double."""
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _cut(q, r, s, ids, k):
    """The k best of each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids[r], -s if s.dtype.kind == "f" else ~s, q))
    q, r, s = q[order], r[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[r[keep]], s[keep].astype(np.int64)


def _row(shard: int, tree: Tree) -> pa.RecordBatch:
    f = lambda x: pa.array([np.ascontiguousarray(x, dtype="<f8").tobytes()], pa.binary())
    g = lambda x: pa.array([np.ascontiguousarray(x, dtype="<i8").tobytes()], pa.binary())
    n = [pa.array([x], pa.int64()) for x in (shard, len(tree.ids), tree.vectors.shape[1], tree.depth)]
    return pa.RecordBatch.from_arrays([*n, g(tree.ids), f(tree.vectors), f(tree.lows), f(tree.highs), g(tree.cuts)], names=["shard", "n", "dim", "depth", "ids", "vectors", "lows", "highs", "cuts"])


def _tree(row: dict) -> Tree:
    f = lambda x: np.frombuffer(row[x], "<f8").reshape(-1, row["dim"]) if row["dim"] else np.zeros((row["n"], 0))
    return Tree(np.frombuffer(row["ids"], "<i8"), f("vectors"), row["depth"], f("lows"), f("highs"), np.frombuffer(row["cuts"], "<i8"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite)
    shards = max(1, -(-rows.count() // shard))

    def build(batches):
        ids, parts, lengths = [], [], []
        for batch in batches:
            ids.append(np.asarray(batch.column(0)))
            lists = batch.column(1)
            lengths.append(np.diff(np.asarray(lists.offsets)))
            parts.append(np.asarray(lists.flatten()))
        if ids:
            n, flat = np.concatenate(lengths), np.floor(np.concatenate(parts))
            x = np.zeros((len(n), int(n.max(initial=0))))
            x[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
            yield _row(TaskContext.get().partitionId(), Tree.build(np.concatenate(ids), x))

    # One partition is one shard, and its number the shard's: these must not be put together.
    trees = kept(rows.repartition(shards).mapInArrow(build, _SHARD_SCHEMA), "shards")
    found = "block long, place long, query_id long, vec_id long, score long"

    def answers(block, places, query_ids, hits):
        q, ids, s = hits
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(q), block), places[q], query_ids[q], ids, s)], names=["block", "place", "query_id", "vec_id", "score"])

    def queries_of(row):
        own = np.flatnonzero(row[0] % every == 0)
        return own, row[0][own], row[1][own]

    def asked(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = _tree(row)
                own, ids, vectors = queries_of((t.ids, t.vectors))
                g = lambda x, t: pa.array([np.ascontiguousarray(x, dtype=t).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([row["dim"]], pa.int64()), g(own, "<i8"), g(ids, "<i8"), g(vectors, "<f8")], names=["block", "qdim", "places", "query_ids", "queries"])

    def at_home(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = _tree(row)
                own, ids, vectors = queries_of((t.ids, t.vectors))
                yield answers(row["shard"], own, ids, _cut(*t.search(vectors, k, np.full(len(own), NO_SCORE), own), t.ids, k))

    def away(batches):
        last, t = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != last:
                    last, t = row["shard"], _tree(row)
                ids, places = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["places"], "<i8")
                q = np.frombuffer(row["queries"], "<f8").reshape(len(ids), -1) if row["qdim"] else np.zeros((len(ids), 0))
                known = {x["place"]: x["kth"] for x in row["known"] or ()}
                kth = np.array([known.get(x, NO_SCORE) for x in places.tolist()], dtype=np.int64)
                yield answers(row["block"], places, ids, _cut(*t.search(q, k, kth), t.ids, k))

    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = trees.mapInArrow(at_home, found).withColumn("rank", F.row_number().over(best))
    if shards > 1:
        blocks = kept(trees.mapInArrow(asked, "block long, qdim long, places binary, query_ids binary, queries binary").where(F.length("query_ids") > 0), "queries")
    seen = 1
    while seen < shards:
        until = min(shards, seen * GROWTH)
        ranked = kept(ranked, "best")
        # A row for each block: its queries' kth scores, of those that have k answers.
        kth = ranked.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("place", F.col("score").alias("kth"))).alias("known"))
        turn = F.explode(F.sequence(F.lit(seen).cast("long"), F.lit(until - 1).cast("long")))
        met = blocks.join(kth.hint("shuffle_merge"), "block", "left").withColumn("turn", turn).withColumn("shard", F.pmod(F.col("block") + F.col("turn"), F.lit(shards).cast("long"))).drop("turn")
        new = met.join(trees.hint("shuffle_merge"), "shard").mapInArrow(away, found)
        ranked = ranked.drop("rank").unionByName(new).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        seen = until
    return gathered(ranked.select("query_id", "rank", "vec_id", "score"), vectors)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op2_topk_search": op2_topk_search}
ORACLE_SQL = {
    "op2_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS row
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.row, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
