"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text's tokens are its runs of letters and digits and its runs of other signs. Features are the hashed tokens and
the hashed pairs of neighbours; a pair of equal tokens hashes to one shared feature, so that stuttering is learned
once for all words. Counts are divided by the number of tokens (pairs), which makes the score of a text one sparse dot
product with the weights, whatever its length.

Fitting reads a bounded sample of labelled rows (``max_rows``, chosen by the hash of the row, hence the same in every
run) in one task; nothing but the weights goes to the driver (4 * 2**bits bytes). Scoring reads every whole text once,
without a shuffle.

Defined results: a null text is an empty text, whose score is that of the bias; a null label or id takes no part in
fitting; an id with several labels has the smallest; without any labelled row all scores are 0.5. Repeated rows are
scored one by one. A text of any length is scored whole, in a block of its own. An empty table gives no row. Scoring whole
rows carries their other columns along unread, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import gathered
from .text import Block, as_rows, blocks, float_sums, map_batches, span_hashes, texts_of, window_hashes

BITS = 18
#: Labelled rows that are read for fitting.
MAX_ROWS = 8000
THRESHOLD = 0.7
_STUTTER = np.uint64(0x5EED)


def _features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed tokens with the first of each text, and hashed pairs with the first of each text."""
    block = Block(texts)
    starts, ends = block.tokens()
    firsts = block.firsts(starts)
    words = span_hashes(block.data, starts, ends)
    pairs = window_hashes(words, 2)
    pairs[words[1:] == words[:-1]] = _STUTTER
    text_of = np.repeat(np.arange(block.n), np.diff(firsts))
    inside = np.flatnonzero(text_of[1:] == text_of[:-1])
    mask = np.uint64((1 << bits) - 1)
    return (words & mask).astype(np.int64), firsts, (pairs[inside] & mask).astype(np.int64), np.searchsorted(inside, firsts)


def vectors(texts: list[str], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sparse vector of each text: feature numbers, and counts divided by the number of tokens or of pairs."""
    a, a_first, b, b_first = _features(texts, bits)
    out = []
    for i in range(len(texts)):
        index, value = [], []
        for x, first in ((a, a_first), (b, b_first)):
            own = x[first[i] : first[i + 1]]
            k, n = np.unique(own, return_counts=True)
            index.append(k)
            value.append(n / max(1, len(own)))
        out.append((np.concatenate(index), np.concatenate(value)))
    return out


def dots(texts: list[str], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The dot products of all the texts' vectors with the weights; each is the same in whatever company."""
    out = np.zeros(len(texts))
    a, a_first, b, b_first = _features(texts, bits)
    for x, first in ((a, a_first), (b, b_first)):
        out += float_sums(weights[x], first) / np.maximum(1, np.diff(first))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int = 4, alpha: float = 2.0, beta: float = 0.1, l1: float = 0.002, l2: float = 0.002) -> np.ndarray:
    """FTRL-proximal with a rate for each coordinate. The last weight is the bias.

    Vectors are dense in mass, not in length: they sum to 1 for tokens and for pairs, so l1 is small.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def at(i):
        v = z[i]
        w = -(v - np.sign(v) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(v) <= l1, 0.0, w)

    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.append(index, size), np.append(value, 1.0)
            i, first = np.unique(i, return_inverse=True)
            x = np.bincount(first, x)
            w = at(i)
            g = (_sigmoid(w @ x) - label) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return at(np.arange(size + 1))


def train(documents: DataFrame, labels: DataFrame, use: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray | None:
    """Weights fitted on at most ``max_rows`` labelled rows whose id meets ``use``; None if there are none."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (F.lit(True) if use is None else use))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # At most max_rows ids: a proven bound for the broadcast. An id may stand for many rows, hence the second limit.
    rows = texts.join(F.broadcast(known), "_id").select("_text", "_label", F.xxhash64("_id", "_text").alias("_order"))
    rows = rows.orderBy("_order", "_label").limit(max_rows)

    def fit(batches):
        seen = []
        for batch in batches:
            y, order = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(0).to_pylist()
            for at, part in blocks(texts):
                for k, (index, value) in enumerate(vectors(part, bits)):
                    seen.append((order[at + k], y[at + k], index.astype(np.int32), value.astype(np.float32)))
        if seen:
            seen.sort(key=lambda r: r[:2])
            w = ftrl([(i, v.astype(np.float64), int(y > 0)) for _, y, i, v in seen], 1 << bits)
            yield pa.RecordBatch.from_pydict({"weights": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    got = rows.repartition(1).mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(got[0][0], "<f4").astype(np.float64) if got else None


def score(documents: DataFrame, weights: np.ndarray | None, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """row (all columns of documents) and score for every row."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(None if weights is None else weights.astype("<f4"))
    rows = as_rows(documents)

    def work(batch):
        w = shared.value
        out = np.full(batch.num_rows, 0.5)
        if w is not None:
            for at, texts in blocks(texts_of(batch, text_col)):
                out[at : at + len(texts)] = _sigmoid(dots(texts, w[:-1], bits) + w[-1])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["row", "score"])

    return map_batches(gathered(rows, documents), ["row"], rows.select("*").schema.add("score", "double"), work)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no label is learned from: crc32 of the id as text leaves 2 by 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on) for every row of documents."""
    weights = train(documents, labels, ~held_out("_id"))
    out = score(documents.select("doc_id", "text"), weights)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, with all their columns, that are not rejected; all of them if there is no label."""
    weights = train(documents, labels, ~held_out("_id"))
    if weights is None:
        return documents
    return score(documents, weights).where(F.col("score") >= THRESHOLD).select("row.*")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
