"""MinHash near-dedup with sequential Bayesian verification, exact links and connected components.

1. One pass gives each document the size of its shingle set, a 128-bit fingerprint of that set, and band hashes of its
   MinHash signature. Documents with the same fingerprint are one class: copies cost one row from here on.
2. Classes that share a band hash form a bucket. Buckets with the same members in several bands are looked at once, in
   the first of these bands. Only classes in a bucket are looked at again, and only their texts are shuffled: a bitmap of
   their fingerprints, of at most ``BITS`` bits whatever the input, lets tasks leave out the others (a few wrongly let
   through go in the join that follows).
3. If a bucket has ``REPRESENT`` members or more, each member of such buckets is first compared with the ``CENTRES``
   representatives of its largest one, once, and links found so become parts. Members of one part need not meet again:
   buckets that lie in one part are done, and in others the members of the largest part meet the rest only. So a group of
   near copies costs a number of comparisons in proportion to its members.
4. A bucket whose members exceed ``CELL`` rows or ``CELL_SHINGLES`` shingles is dealt into blocks, and each pair of blocks
   that has anything to compare is a cell; smaller buckets are one cell. So every pair of different parts meets in one cell,
   and no task holds more than a cell.
5. In a cell, pairs of one part, pairs that met in an earlier band, and those whose set sizes rule the threshold out are
   left out. The rest is compared in batches of independent MinHash values: after each batch, a pair goes when the posterior
   probability (uniform prior) that its similarity reaches the threshold is below ``MISS``. Survivors that the cell hasn't
   linked yet are verified on their full sets. Only links that join two parts of the cell leave it.
6. Links become components by alternating large-star and small-star steps, in written rounds.

With ``BANDS`` bands of ``ROWS`` rows a pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**30 = 7e-6;
no cap is set on buckets, candidates or partners.

Defined results: texts are lower-cased in A-Z; words are runs of ``[^\\x20\\x09-\\x0D]``; a text with fewer words than a
shingle has is one shingle; a text without words (or null) has an empty set and is linked with nothing. Texts of any length
are read whole. Shingles are told apart by 64-bit hashes. A null id is never the smallest; if a component has no other, its
id is null. Rows with one id are documents of their own with equal ids. An empty table gives no row.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import gathered, kept
from .text import Block, as_rows, blocks, map_batches, mix, span_hashes, sums, texts_of, window_hashes

BANDS, ROWS = 30, 5
MISS = 1e-6
#: MinHash values for verification, and how many are compared at a time.
CHECKS, BATCH = 256, 32
CELL, CELL_SHINGLES = 1024, 1 << 21
#: Members from which a bucket's are compared with its representative first.
REPRESENT = 256
#: Representatives of a large bucket, and members that a task compares with them.
CENTRES, STAR = 8, 256
#: Most bits of the bitmap of classes in buckets (64 MB).
BITS = 1 << 29
#: Edges of the component graph that a task writes.
EDGES = 200_000

_SEEDS = mix(np.arange(1, BANDS * ROWS + CHECKS + 1, dtype=np.uint64))
_TIMES = (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_XOR = (_SEEDS >> np.uint64(32)).astype(np.uint32)


# --- sets and signatures ----------------------------------------------------------------------------------------------


class Sets:
    """The distinct shingles of some texts: those of text i are ``values[firsts[i]:firsts[i + 1]]``, ascending."""

    def __init__(self, texts: list[str], size: int) -> None:
        block = Block(texts)
        starts, ends = block.words()
        firsts = block.firsts(starts)
        words = span_hashes(block.lowered(), starts, ends)
        n = np.diff(firsts)
        text_of = np.repeat(np.arange(block.n), n)
        windows = window_hashes(words, size)
        at = np.flatnonzero(text_of[: len(windows)] == text_of[size - 1 :]) if len(windows) else np.empty(0, dtype=np.int64)
        short = np.flatnonzero((n > 0) & (n < size))
        values = np.concatenate([windows[at], *(window_hashes(words[firsts[i] : firsts[i + 1]], int(n[i])) for i in short)])
        owner = np.concatenate([text_of[at], short])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, owner = values[new], owner[new]
        self.firsts = np.searchsorted(owner, np.arange(block.n + 1))
        self.sizes = np.diff(self.firsts)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.firsts[i] : self.firsts[i + 1]]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            a = sums(mix(self.values), self.firsts)
            b = sums(mix(self.values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.firsts)
            return a.view(np.int64), mix(b + self.sizes.astype(np.uint64)).view(np.int64)

    def minima(self, first: int, count: int) -> np.ndarray:
        """MinHash values number ``first`` on, a row for each text; those of empty sets are 0."""
        out = np.zeros((len(self.sizes), count), dtype=np.uint32)
        some = np.flatnonzero(self.sizes)
        if len(some):
            low = self.values.astype(np.uint32)
            at = self.firsts[some]
            for j in range(count):
                out[some, j] = np.minimum.reduceat((low ^ _XOR[first + j]) * _TIMES[first + j], at)
        return out

    def bands(self) -> np.ndarray:
        """Hashes of the bands, a row for each text."""
        m = self.minima(0, BANDS * ROWS).astype(np.uint64).reshape(-1, BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                out = mix(out + m[:, :, r] * np.uint64(0xD6E8FEB86659FD93))
        return out


def read_sets(rows: DataFrame, size: int, with_bands: bool, text_col: str = "text") -> DataFrame:
    """The columns of rows with _n, _a, _b (set size and fingerprint) and, if asked for, _bands."""
    schema = type(rows.schema)(list(rows.schema.fields)).add("_n", "long").add("_a", "long").add("_b", "long")
    if with_bands:
        schema = schema.add("_bands", T.ArrayType(T.LongType()))
    names = [f.name for f in schema.fields]

    def work(batch):
        parts: list[list] = []
        for _, texts in blocks(texts_of(batch, text_col)):
            s = Sets(texts, size)
            parts.append([s.sizes, *s.fingerprints(), *([s.bands().view(np.int64)] if with_bands else [])])
        out = [np.concatenate(x) for x in zip(*parts, strict=True)]
        columns = [pa.array(x, pa.int64()) for x in out[:3]]
        if with_bands:
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, out[3].size + 1, BANDS), pa.int32()), pa.array(out[3].ravel())))
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return map_batches(rows, rows.columns, schema, work)


# --- cells ------------------------------------------------------------------------------------------------------------


def fewest_matches(threshold: float, miss: float, most: int = CHECKS, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest matches with which the posterior still gives the threshold ``miss`` or more."""
    out = []
    for n in range(batch, most + 1, batch):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class Parts:
    """Union-find over a cell's members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def cell_links(texts: list[str], blocks_of: np.ndarray, band: int, size: int, percent: int, parts_of: np.ndarray | None = None, star: int = 0) -> list[tuple[int, int]]:
    """Verified links that connect whatever is linked in the cell.

    With two blocks, pairs inside one are left out, and so are pairs with one number in parts_of. With star, only pairs
    with one of so many first texts are looked at, whatever bands they share.
    """
    s = Sets(texts, size)
    n = len(texts)
    two = blocks_of.min() != blocks_of.max()
    early = s.bands()[:, :band] if band and not star else None
    least = fewest_matches(percent / 100, MISS)
    checks = None
    parts, out = Parts(n), []
    for i in range(min(star, n - 1) if star else n - 1):
        j = np.arange(i + 1, n)
        a, b = s.sizes[i], s.sizes[j]
        j = j[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
        if two:
            j = j[blocks_of[j] != blocks_of[i]]
        if parts_of is not None:
            j = j[parts_of[j] != parts_of[i]]
        if early is not None and len(j):
            j = j[~(early[j] == early[i]).any(axis=1)]
        if not len(j):
            continue
        if checks is None:
            checks = s.minima(BANDS * ROWS, CHECKS)
        matches = np.zeros(len(j), dtype=np.int64)
        for k, m in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += (checks[j, part] == checks[i, part]).sum(axis=1)
            go = matches >= m
            j, matches = j[go], matches[go]
            if not len(j):
                break
        own = s.of(i)
        for x in j.tolist():
            if parts.find(i) != parts.find(x):
                other = s.of(x)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both) and parts.join(i, x):
                    out.append((i, x))
    return out


def _positions(bits: int) -> list[Column]:
    """Four bits of the bitmap for a fingerprint, whose halves are evenly spread."""
    return [F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(bits - 1)) for c in ("_a", "_b") for shift in (0, 32)]


def class_bitmap(need: DataFrame) -> np.ndarray:
    """A bitmap with the four bits of each row set (_a, _b): at least 16 bits for each row, and at most ``BITS`` in all."""
    bits = min(BITS, max(1 << 15, 1 << int(16 * need.count() - 1).bit_length()))
    at = need.select(F.explode(F.array(*_positions(bits))).alias("at")).select(F.shiftright("at", 15).alias("word"), F.col("at").bitwiseAND(F.lit(32767)).alias("bit"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for word, held in at.groupBy("word").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        out[4096 * word : 4096 * word + len(held)] = np.frombuffer(held, np.uint8)
    return out


def _in_bitmap(bitmap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), dtype=bool)
    for x in (a.view(np.uint64), b.view(np.uint64)):
        for shift in (0, 32):
            at = (x >> np.uint64(shift)) & np.uint64(8 * len(bitmap) - 1)
            out &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def class_texts(source: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """_a, _b, _text: one text of each needed class. need: distinct _a, _b."""
    spark = source.sparkSession
    shared = spark.sparkContext.broadcast(class_bitmap(need))

    def work(batch):
        texts = batch.column(0).to_pylist()
        a, b, kept_texts = [], [], []
        for at, part in blocks(texts):
            first, second = Sets(part, size).fingerprints()
            go = np.flatnonzero(_in_bitmap(shared.value, first, second))
            a += first[go].tolist()
            b += second[go].tolist()
            kept_texts += [part[i] for i in go.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kept_texts, pa.string())], names=["_a", "_b", "_text"])

    found = map_batches(gathered(source.select("text"), source), ["text"], "_a long, _b long, _text string", work)
    # One text for each class, chosen before the shuffle too: copies do not meet in one task.
    return found.groupBy("_a", "_b").agg(F.min("_text").alias("_text")).join(need.hint("shuffle_merge"), ["_a", "_b"])


_CELL = ["band", "key", "low", "high"]
_PAIR = "a1 long, a2 long, b1 long, b2 long"


def verified(cells: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of all cells. cells: _CELL, block, _a, _b, _part (null: none). A high of -1 marks a star: its centres are in block 0."""
    dealt = cells.join(texts.hint("shuffle_merge"), ["_a", "_b"]).repartition(*_CELL).sortWithinPartitions(*_CELL)

    def verify(batches):
        held: list[tuple] = []

        def done():
            if len(held) > 1:
                held.sort(key=lambda r: (r[4] if r[3] < 0 else 0, r[5:7]))  # the same order in every retry
                star = sum(r[4] == 0 for r in held) if held[0][3] < 0 else 0
                parts = None if star or held[0][8] is None else np.unique(np.array([r[8] for r in held]), return_inverse=True)[1]
                for i, j in cell_links([r[7] for r in held], np.array([0 if star else r[4] for r in held]), held[0][0], size, percent, parts, star):
                    yield held[i][5:7] + held[j][5:7]

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:4] != row[:4]:
                    out += done()
                    held.clear()
                held.append(row)
            if out:
                yield _pairs(out)
        if rest := list(done()):
            yield _pairs(rest)

    def _pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["a1", "a2", "b1", "b2"])

    return dealt.select(*_CELL, "block", "_a", "_b", "_text", "_part").mapInArrow(verify, _PAIR)


def as_edges(pairs: DataFrame) -> DataFrame:
    """Pairs of classes as edges of components."""
    return pairs.select(F.struct(F.col("a1").alias("a"), F.col("a2").alias("b")).alias("u"), F.struct(F.col("b1").alias("a"), F.col("b2").alias("b")).alias("v"))


def links(classes: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of classes (a1, a2, b1, b2) that connect all that is linked. classes: _a, _b, _n, _bands; source: text."""
    rows = classes.select("_a", "_b", "_n", F.posexplode("_bands").alias("band", "key"))
    met = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("_n").alias("shingles"), F.bit_xor("_a").alias("x"), F.bit_xor("_b").alias("y")).where("n > 1")
    # The same members in several bands: once, in the first.
    once = met.groupBy("x", "y", "n").agg(F.min(F.struct("band", "key", "shingles")).alias("m")).select("m.band", "m.key", "n", "m.shingles")
    # Written, so that both sides of the join are shuffles of their own, and a bucket of many members is split.
    buckets = kept(once, "buckets", classes)
    members = kept(rows.join(buckets.hint("shuffle_merge"), ["band", "key"]), "members", classes)
    need = kept(members.select("_a", "_b").distinct(), "need", classes)
    texts = kept(class_texts(source, need, size), "texts", source)
    if buckets.where(F.col("n") >= REPRESENT).isEmpty():
        wide = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("long")
        parted = members.withColumns({"wide": wide, "major": F.lit(0).cast("long"), "is_major": F.lit(False), "_part": F.lit(None).cast("string")})
        return verified(dealt_cells(parted), texts, size, percent)

    # Each member of a large bucket against the representatives of its largest one: the smallest of each slice.
    large = members.where(F.col("n") >= REPRESENT)
    slices = F.pmod(F.xxhash64(F.lit("centre"), "_a", "_b"), F.lit(CENTRES))
    centres = large.groupBy("band", "key", slices.alias("slice")).agg(F.min(F.struct("_a", "_b")).alias("c")).select("band", "key", "c.*")
    home = large.groupBy("_a", "_b").agg(F.max(F.struct("n", "shingles", "band", "key")).alias("m"))
    many = F.greatest(F.ceil(F.col("m.n") / STAR), F.ceil(F.col("m.shingles") / CELL_SHINGLES)).cast("long")
    home = kept(home.select("m.band", "m.key", F.pmod(F.xxhash64("_a", "_b"), many).alias("low"), F.lit(-1).cast("long").alias("high"), F.lit(1).cast("long").alias("block"), "_a", "_b"), "home", classes)
    in_each = home.select(*_CELL).distinct().join(centres.hint("shuffle_merge"), ["band", "key"]).select(*_CELL, F.lit(0).cast("long").alias("block"), "_a", "_b")
    near = kept(verified(home.unionByName(in_each).withColumn("_part", F.lit(None).cast("string")), texts, size, percent), "stars")
    of = components(as_edges(near), classes).select(F.col("node.a").alias("_a"), F.col("node.b").alias("_b"), F.concat_ws(" ", "root.a", "root.b").alias("root"))
    of = kept(of, "parts")

    # What lies in the largest part of its bucket meets only what does not.
    named = members.join(of.hint("shuffle_merge"), ["_a", "_b"], "left").withColumn("_part", F.coalesce("root", F.concat_ws(" ", "_a", "_b")))
    named = kept(named.select("band", "key", "_a", "_b", "_n", "_part"), "named", classes)
    parts = named.groupBy("band", "key", "_part").agg(F.count("*").alias("n"), F.sum("_n").alias("shingles")).groupBy("band", "key")
    parts = parts.agg(F.max(F.struct("n", "shingles", "_part")).alias("lead"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("lead.n < n")
    count = lambda n, shingles: F.greatest(F.ceil(n / CELL), F.ceil(shingles / CELL_SHINGLES)).cast("long")
    n, shingles, lead = F.col("n"), F.col("shingles"), F.col("lead")
    small = (n <= CELL) & (shingles <= CELL_SHINGLES)
    wide = F.when(small, 1).otherwise(count(n - lead["n"], shingles - lead["shingles"]))
    sizes = kept(parts.select("band", "key", lead["_part"].alias("lead"), wide.alias("wide"), F.when(small, 0).otherwise(count(lead["n"], lead["shingles"])).alias("major")), "sizes", classes)
    parted = named.join(sizes.hint("shuffle_merge"), ["band", "key"]).withColumn("is_major", F.col("_part") == F.col("lead"))
    return near.unionByName(verified(dealt_cells(parted), texts, size, percent))


def dealt_cells(members: DataFrame) -> DataFrame:
    """The cells of buckets. members: band, key, _a, _b, _part, is_major, and the bucket's numbers of blocks.

    Blocks 0 to wide - 1 meet each other and themselves, and each of the major blocks behind them, which hold the members
    with is_major; these don't meet among themselves. With no major block all members are in the first ones.
    """
    hashed = F.xxhash64("_a", "_b")
    behind = F.col("is_major") & (F.col("major") > 0)
    block = F.when(behind, F.col("wide") + F.pmod(hashed, F.greatest("major", F.lit(1)))).otherwise(F.pmod(hashed, F.col("wide")))
    last = F.when(behind, F.col("wide") - 1).otherwise(F.col("wide") + F.col("major") - 1)
    cells = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cells.select("band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "_a", "_b", "_part")


# --- components -------------------------------------------------------------------------------------------------------


def components(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of a pair (columns u, v). Rounds are written."""
    edges = kept(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", source)
    before, n = None, edges.count()
    while True:
        tasks = 1 + n // EDGES  # a round's edges are known, and few against the documents
        # A centre of many edges is split while joining if the other side is a shuffle of its own, not an aggregate's.
        apart = (lambda df: kept(df, "low")) if n > EDGES else (lambda df: df)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Now every edge points down: the small star of u takes its lower neighbours.
        large = apart(large)
        low = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low.hint("shuffle_merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v")
        edges = kept(small.distinct().coalesce(tasks), "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == before:
            break
        before, n = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(documents: DataFrame, size: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _n, _a, _b, _component for every row of documents."""
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = kept(read_sets(gathered(source, source), size, True).drop("text"), "sets")
    classes = kept(rows.where("_n > 0").groupBy("_a", "_b", "_n", "_bands").agg(F.min("doc_id").alias("first")), "classes", source)
    linked = components(as_edges(links(classes, source, size, percent)), classes)
    linked = linked.select(F.col("node.a").alias("_a"), F.col("node.b").alias("_b"), "root")
    own = classes.select("_a", "_b", "first").join(linked.hint("shuffle_merge"), ["_a", "_b"], "left")
    # Classes without a link have no root, and take no part in the join by root.
    linked, single = own.where("root is not null"), own.where("root is null")
    low = linked.groupBy("root").agg(F.min("first").alias("low"))
    linked = linked.join(low.hint("shuffle_merge"), "root").select("_a", "_b", F.col("root").alias("_root"), F.col("low").alias("_component"))
    own = linked.unionByName(single.select("_a", "_b", F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")).alias("_root"), F.col("first").alias("_component")))
    names = ["doc_id", "_n", "_a", "_b", "_root", "_component"]
    some = rows.where("_n > 0").select(*names[:4]).join(own.hint("shuffle_merge"), ["_a", "_b"]).select(*names)
    return gathered(some.unionByName(rows.where("_n = 0").select(*names[:4], F.lit(None).cast(own.schema["_root"].dataType).alias("_root"), F.col("doc_id").alias("_component"))), source)


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents with all their columns: of each component, one row with the smallest id. Texts without words all stay.

    Of rows that share this id, those with the smallest fingerprint are looked at, and of these the one with the smallest text
    stays, then the one that is smallest as JSON. Shingles have five words unless size says otherwise.
    """
    first = groups(documents, size, percent).where("_n > 0 and doc_id <=> _component")
    # Rows may share the smallest id, or have none: of those one set, and of its rows one.
    best = first.groupBy("_root").agg(F.min(F.struct("_a", "_b")).alias("s"), F.count("*").alias("_rows"), F.first("_component").alias("_id"))
    best = kept(best.select("_id", F.col("s._a").alias("_sa"), F.col("s._b").alias("_sb"), "_rows"), "first", documents)
    rows = read_sets(gathered(as_rows(documents), documents), size, False)
    key = (F.col("_a") == F.col("_sa")) & (F.col("_b") == F.col("_sb")) & F.col("row.doc_id").eqNullSafe(F.col("_id"))
    met = rows.where("_n > 0").join(best.hint("shuffle_merge"), key)
    alone = met.where("_rows = 1").select("row")
    several = met.where("_rows > 1").groupBy("_id", "_a", "_b").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row")).select("row")
    return gathered(alone.unionByName(several), documents).unionByName(rows.where("_n = 0").select("row")).select("row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)
    return out.select("doc_id", F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("_component"), F.lit(False)).alias("kept"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
#: Compares all pairs that share a shingle: for small tables.
ORACLE_SQL = {
    "op8_near_dedup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT row, array_to_string(words[pos + 1 : pos + 4], ' ') AS shingle
  FROM (SELECT row, words, unnest(range(greatest(len(words) - 3, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END))) AS pos FROM d)
), n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
shared AS (SELECT a.row AS a, b.row AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.row <> b.row GROUP BY ALL),
edges AS (SELECT p.a, p.b FROM shared p JOIN n x ON x.row = p.a JOIN n y ON y.row = p.b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
reach AS (SELECT row AS a, row AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
c AS (SELECT r.a AS row, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.row = r.b GROUP BY r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(d.doc_id = c.component_id, false) AS kept FROM d JOIN c ON c.row = d.row LEFT JOIN n ON n.row = d.row"""
}
