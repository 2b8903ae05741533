"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule names a host (which stands for its subdomains too) and a path prefix; the longest rule that fits decides. URLs
that a rule decides are the labelled URLs that the trees learn from; the trees judge all others.

Features: length of url, host and path, depth, digit ratios, character entropy, hyphens, parameter counts, whether there
is a fragment or a file ending, and suffix statistics: the smoothed share of blocked labelled URLs for the host's last
one, two and three labels, for the path's first segment, for last label and first segment together, and for the last two
labels with the path up to the second segment's first character. Trees split on histograms of at most 32 quantile bins
and fit the gradient of the logistic loss.

While fitting, a URL's statistics come from the other folds: labelled URLs are dealt into ``FOLDS`` by their hash, and a
fold's counts are taken off the sums for its own URLs. So no URL meets its own label, and all URLs of a fold that share a
suffix have one rate for it, which therefore tells nothing about the labels inside that group. (Taking out only a URL's own
label would: blocked URLs would have the lower rate of their group, and the trees would learn the inverse.)

The suffix statistics count all distinct labelled URLs, in Spark. Fitting the trees reads a bounded sample of these
(``MAX_ROWS``, chosen by the hash of the url) in one task, with the statistics that each needs; the driver gets the trees.
The statistics are written, and rows to be judged get theirs by joins, which Spark broadcasts if the measured size is
under the session's threshold, else it splits skewed suffixes.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule. Without labelled URLs, or
with labels of one kind only, the method's verdict is that kind, else allow. Repeated rows are judged one by one, and a
URL that stands in many rows is one labelled URL. URLs of any length are judged whole. An empty table gives no row.
Columns other than the named ones are not read.
"""

from __future__ import annotations

import math
import pickle
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import gathered, kept
from .text import map_batches

MAX_ROWS = 10_000
FOLDS = 5
THRESHOLD = 0.5
#: The contract's rules: verdict, host and path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null if none does."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = (F if rule is None else rule).when(fits, h + p)
        verdict = (F if verdict is None else verdict).when(fits, kind)
    return rule, verdict


# --- features ---------------------------------------------------------------------------------------------------------


def lexical(url: str, host: str, path: str) -> list[float]:
    n = max(1, len(url))
    query = url.partition("?")[2].partition("#")[0]
    counts = Counter(url).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts) if url else 0.0
    last = path.rsplit("/", 1)[-1]
    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count("."), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in path) / max(1, len(path)),
        sum(c.isdigit() for c in host), entropy, host.count("-"), (query.count("&") + 1) if query else 0, query.count("="), float("#" in url), float("." in last), float(path.endswith("/")), float(url.startswith("https")),
    ]


def suffix_columns(host: Column, path: Column) -> list[Column]:
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    first = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")
    return [
        F.concat(F.lit("1 "), last(1)), F.concat(F.lit("2 "), last(2)), F.concat(F.lit("3 "), last(3)), F.concat(F.lit("p "), first),
        F.concat(F.lit("s "), last(1), F.lit(" "), first), F.concat(F.lit("d "), last(2), F.regexp_extract(path, "^/[^/]*/?[^/]?", 0)),
    ]


#: Keys of suffix_columns.
N_KEYS = 6


def statistics(labelled: DataFrame) -> DataFrame:
    """For each suffix of labelled URLs: key, n and k (their number and that of blocked ones), and both without each fold.

    labelled: host, path, blocked, fold; it must be distinct.
    """
    keys = F.explode(F.array(*suffix_columns(F.col("host"), F.col("path")))).alias("key")
    rows = labelled.select(keys, F.col("blocked").cast("long").alias("b"), "fold")
    own = [F.sum(F.when(F.col("fold") == f, x).otherwise(0)) for f in range(FOLDS) for x in (F.lit(1).cast("long"), F.col("b"))]
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("b").alias("k"), F.array(*own).alias("own"))
    without = lambda at: F.transform(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: (F.col("k") if at else F.col("n")) - F.get("own", 2 * f + at))
    return sums.select("key", "n", "k", without(0).alias("n_without"), without(1).alias("k_without"))


def with_counts(rows: DataFrame, table: DataFrame, fold: str | None = None) -> DataFrame:
    """Adds counts: n and k for each of the suffixes; with fold, the name of a column, those without the row's fold."""
    names = rows.columns
    for j, key in enumerate(suffix_columns(F.col("host"), F.col("path"))):
        own = table.select(F.col("key").alias(f"key{j}"), *[F.col(c if fold is None else f"{c}_without").alias(f"{c}{j}") for c in "nk"])
        rows = rows.withColumn("own", key).join(own, F.col("own") == F.col(f"key{j}"), "left").drop("own", f"key{j}")
    value = lambda c: F.col(c) if fold is None else F.get(c, F.col(fold))
    counts = [F.coalesce(value(f"{c}{j}"), F.lit(0).cast("long")) for j in range(N_KEYS) for c in "nk"]
    return rows.select(*names, F.array(*counts).alias("counts"))


def rates(counts: np.ndarray, prior: float) -> np.ndarray:
    """Smoothed shares of blocked URLs for each suffix, of its n and k."""
    counts = counts.reshape(-1, N_KEYS, 2)
    return (counts[:, :, 1] + 4 * prior) / (counts[:, :, 0] + 4)


# --- trees ------------------------------------------------------------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0):
    """The start value and trees as (feature, cut, value) arrays in heap order; a node without a split has feature -1."""
    start = math.log(y.mean() / (1 - y.mean()))
    score = np.full(len(y), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1), np.zeros(2 ** (depth + 1) - 1)
        node = np.zeros(len(y), dtype=int)
        for i in range(2 ** (depth + 1) - 1):
            own = np.flatnonzero(node == i)
            if not len(own):
                continue
            gi, hi = g[own].sum(), h[own].sum()
            value[i] = rate * gi / (hi + ridge)
            if i >= 2**depth - 1 or len(own) < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[own, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=len(e) + 1))[:-1] for w in (g[own], h[own], None))
                gain = gs**2 / (hs + ridge) + (gi - gs) ** 2 / (hi - hs + ridge) - gi**2 / (hi + ridge)
                gain[(ns < least) | (len(own) - ns < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[i], cut[i] = best[1], edges[best[1]][best[2]]
                node[own] = 2 * i + 1 + (x[own, best[1]] > cut[i])
        out.append((feature, cut, value))
        score = score + predict_tree(x, out[-1])
    return start, out


def predict_tree(x: np.ndarray, tree) -> np.ndarray:
    feature, cut, value = tree
    node = np.zeros(len(x), dtype=int)
    while True:
        f = feature[node]
        go = np.flatnonzero(f >= 0)
        if not len(go):
            return value[node]
        node[go] = 2 * node[go] + 1 + (x[go, f[go]] > cut[node[go]])


class Model:
    """Trees over the lexical features and rates of (url, host, path) with counts, see with_counts."""

    def __init__(self, urls: list[tuple[str, str, str]], blocked: np.ndarray, counts: np.ndarray) -> None:
        self.constant = None
        if len(set(blocked.tolist())) < 2:
            self.constant = float(blocked[0]) if len(blocked) else 0.0
            return
        self.prior = float(blocked.mean())
        self.start, self.trees = boost(self._features(urls, counts), blocked.astype(float))

    def _features(self, urls: list[tuple[str, str, str]], counts: np.ndarray) -> np.ndarray:
        return np.concatenate([np.array([lexical(*u) for u in urls]), rates(counts, self.prior)], axis=1)

    def score(self, urls: list[tuple[str, str, str]], counts: np.ndarray) -> np.ndarray:
        if self.constant is not None or not urls:
            return np.full(len(urls), self.constant or 0.0)
        x = self._features(urls, counts)
        return 1 / (1 + np.exp(-(self.start + sum(predict_tree(x, t) for t in self.trees))))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url (null: empty), host, path, rule and by_rule (its verdict) for every row of pages."""
    url = F.col("url")
    host, path = host_and_path(url)
    rows = pages.select("page_id", F.coalesce(url, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "by_rule": verdict})


def labelled_urls(rows: DataFrame) -> DataFrame:
    """url, host, path, blocked and fold of the distinct URLs that a rule decides."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")
    return rows.where("by_rule is not null").select("url", "host", "path", (F.col("by_rule") == "block").alias("blocked")).distinct().withColumn("fold", fold)


def train(labelled: DataFrame, table: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """labelled: see labelled_urls. table: its statistics."""
    rows = labelled.select("url", "host", "path", "fold", F.col("blocked").cast("int").alias("blocked"), F.xxhash64("url").alias("order"))
    rows = with_counts(rows.orderBy("order", "url").limit(max_rows), table, "fold").select("url", "host", "path", "blocked", "order", "counts").repartition(1)

    def fit(batches):
        urls = []
        for batch in batches:
            a, b, c, y, order, counts = (x.to_pylist() for x in batch.columns)
            urls += zip(order, a, b, c, y, counts, strict=True)
        urls.sort()
        model = Model([u[1:4] for u in urls], np.array([u[4] for u in urls], dtype=int), np.array([u[5] for u in urls]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = rows.mapInArrow(fit, "model binary").collect()
    return pickle.loads(got[0][0]) if got else Model([], np.zeros(0, dtype=int), np.zeros((0, 2 * N_KEYS)))


def scored(rows: DataFrame, model: Model, table: DataFrame, source: DataFrame) -> DataFrame:
    """The columns of ruled with the method's score, the probability that the URL is to be blocked."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["page_id", "url", "host", "path", "rule", "by_rule"]

    def work(batch):
        a, b, c, counts = (batch.column(k).to_pylist() for k in (1, 2, 3, 6))
        return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(shared.value.score(list(zip(a, b, c, strict=True)), np.array(counts)))], names=[*names, "score"])

    return map_batches(with_counts(gathered(rows, source), table), [*names, "counts"], rows.select(*names).schema.add("score", "double"), work)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score for every row of pages."""
    rows = ruled(pages, rules)
    labelled = labelled_urls(rows)
    table = kept(statistics(labelled), "suffixes", pages)
    out = scored(rows, train(labelled, table), table, pages)
    by_method = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL: dict[str, str] = {}
