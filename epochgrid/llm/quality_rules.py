"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

For each text the words are hashed once per block of texts; the rolling hashes of windows of 3, 5, 8 and 12 words come
from running sums over those, in the same few passes for each length. A window that its text holds twice or more (the first included) covers its words. The rules look at the
share of the text's word characters that lie inside covered words, for each length, and at the share inside lines that
equal an earlier line.

Method's verdict: a document is rejected when a line repeats too much (``MAX_LINE_COVERAGE``) or when the coverage at
one of the lengths exceeds its limit in ``MAX_COVERAGE``. These limits leave room for short clean documents that carry the
same header and footer line twice, which covers up to 43 % of their characters. So repeated lines that make a run of at
most ``RUN_WORDS`` words are left to the line limit, and the rest of the text is held against ``MAX_PASSAGES``: its limits
fall with the length, so that each length rejects texts of its own. A block of many lines that stands twice is a longer
run, and counts.

Defined results: a null or empty text has no words, so it fails the base rules (fewer than ``MIN_WORDS`` words). Rows
are judged one by one, so ids may be null or repeat. An empty table gives no row. Equality of windows is equality of 64-bit
hashes, equality of lines is exact. A very long text is one block; it takes up to 230 bytes of memory for each word.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .storage import gathered
from .text import Block, as_rows, blocks, map_batches, mix, rolling_hashes, span_hashes, sums, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_COVERAGE = {5: 0.50, 8: 0.50, 12: 0.50}
MAX_LINE_COVERAGE = 0.30
#: Those published for 5 and 8 words (0.15, 0.12), and the same slope further.
MAX_PASSAGES = {5: 0.15, 8: 0.12, 12: 0.08}
RUN_WORDS = 40
_SIZES = (3, *MAX_COVERAGE)
_SIGNS = np.zeros(256, dtype=np.int64)
_SIGNS[list(b"#*$%&|<>")] = 1
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def _line_repeats(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and the characters of their words."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0, 0
    seen, count, chars = set(), 0, 0
    for line in lines:
        if line in seen:
            count += 1
            chars += len(_SPACES.sub("", line))
        elif _WORD.search(line):
            seen.add(line)
    return count, chars


def _short_repeats(text: str) -> list[tuple[int, int]]:
    """Ranges of words of the runs of repeated lines that are short enough for the line limit alone."""
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    often = Counter(lines)
    if len(often) == len(lines):
        return []
    found, at = [], 0
    for repeated, run in groupby(lines, lambda x: often[x] > 1):
        to = at + sum(sum(1 for w in _SPACES.split(x) if w) for x in run)
        if repeated and to - at <= RUN_WORDS:
            found.append((at, to))
        at = to
    return found


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts and coverages of each text."""
    block = Block(texts)
    starts, ends = block.words()
    firsts = block.firsts(starts)
    text_of = np.repeat(np.arange(block.n), np.diff(firsts))
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    word_points = points[ends] - points[starts]
    out = {"n_words": np.diff(firsts), "word_chars": sums(word_points, firsts), "n_symbols": sums(_SIGNS[block.data], block.bounds)}
    body = np.ones(len(starts), dtype=bool)
    for first, text in zip(firsts, texts, strict=False):
        for a, b in _short_repeats(text):
            body[first + a : first + b] = False
    out["body_chars"] = sums(np.where(body, word_points, 0), firsts)
    words = span_hashes(block.data, starts, ends)
    salt = mix(np.arange(block.n, dtype=np.uint64))[text_of]
    for size in _SIZES:
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        if len(words) >= size:
            at = np.flatnonzero(text_of[: len(words) - size + 1] == text_of[size - 1 :])
            keys = rolling_hashes(words, size)[at] ^ salt[at]
            order = np.argsort(keys)
            equal = np.diff(keys[order]) == 0
            twice = np.zeros(len(keys), dtype=bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            at = at[twice]
            covered[at] = 1
            np.subtract.at(covered, at + size, 1)
        inside = np.cumsum(covered)[:-1] > 0
        out[f"repeat_words_{size}"] = sums(inside.astype(np.int64), firsts)
        out[f"repeat_chars_{size}"] = sums(np.where(inside, word_points, 0), firsts)
        out[f"passage_chars_{size}"] = sums(np.where(inside & body, word_points, 0), firsts)
    lines = [_line_repeats(t) for t in texts]
    out["n_dup_lines"] = np.array([x for x, _ in lines], dtype=np.int64)
    out["dup_line_chars"] = np.array([x for _, x in lines], dtype=np.int64)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["repeat_words_3"] > MAX_REPEAT_PERCENT * m["n_words"])
    chars = np.maximum(1, m["word_chars"])
    kept = ~base_failed & (m["dup_line_chars"] <= MAX_LINE_COVERAGE * chars)
    for size, most in MAX_COVERAGE.items():
        kept &= m[f"repeat_chars_{size}"] <= most * chars
    for size, most in MAX_PASSAGES.items():
        kept &= m[f"passage_chars_{size}"] <= most * m["body_chars"]
    return base_failed, kept


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, " + ", ".join(f"coverage_{n} double" for n in MAX_COVERAGE)


def rules(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """row (all columns of documents), and the measures and verdicts of SCHEMA."""
    rows = as_rows(documents)
    schema = rows.select("*").schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split())

    def work(batch):
        found: list[list[np.ndarray]] = []
        for _, texts in blocks(texts_of(batch, text_col)):
            m = measure(texts)
            base_failed, kept = verdicts(m)
            chars = np.maximum(1, m["word_chars"])
            found.append([m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["repeat_words_3"], base_failed, kept, m["dup_line_chars"] / chars, *(m[f"repeat_chars_{n}"] / chars for n in MAX_COVERAGE)])
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], names=schema.names)

    return map_batches(gathered(rows, documents), ["row"], schema, work)


def judge(documents: DataFrame) -> DataFrame:
    """doc_id with its measures and verdicts, for every row of documents."""
    out = rules(documents.select("doc_id", "text"))
    return out.select("row.doc_id", *out.columns[1:])


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of documents, with all their columns, that pass."""
    return rules(documents).where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_quality_rules": op10_quality_rules}


def _repeats_sql(size: int) -> str:
    """rep_N: words and characters of each text that lie in windows of N words found twice or more."""
    return f"""
win_{size} AS (
  SELECT row, pos, count(*) OVER (PARTITION BY row, key) AS n
  FROM (SELECT row, pos, array_to_string(words[pos + 1 : pos + {size}], ' ') AS key FROM (SELECT row, words, unnest(range(len(words) - {size - 1})) AS pos FROM split WHERE len(words) >= {size}))
), rep_{size} AS (
  SELECT c.row, count(*) AS words, sum(length(w.word)) AS chars, sum(length(w.word)) FILTER (o.pos IS NULL) AS body
  FROM (SELECT DISTINCT row, unnest(range(pos, pos + {size})) AS pos FROM win_{size} WHERE n > 1) c JOIN w ON w.row = c.row AND w.pos = c.pos LEFT JOIN outside o ON o.row = c.row AND o.pos = c.pos GROUP BY c.row
)"""


_BASE = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
ORACLE_SQL = {
    "op10_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
w AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS pos FROM split),
n AS (SELECT row, count(*) AS n_words, sum(length(word)) AS chars FROM w GROUP BY row),
lines AS (SELECT row, line, row_number() OVER (PARTITION BY row, line ORDER BY pos) AS nth FROM (SELECT row, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
again AS (SELECT row, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM lines WHERE nth > 1 GROUP BY row),
wl AS (SELECT row, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, count(*) OVER (PARTITION BY row, line) > 1 AS twice FROM (SELECT row, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
turns AS (SELECT *, sum(n) OVER (PARTITION BY row ORDER BY pos) - n AS beg, CASE WHEN twice = lag(twice) OVER (PARTITION BY row ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM wl),
runs AS (SELECT row, min(beg) AS a, max(beg + n) AS b FROM (SELECT *, sum(turn) OVER (PARTITION BY row ORDER BY pos) AS run FROM turns) WHERE twice GROUP BY row, run HAVING max(beg + n) - min(beg) <= {RUN_WORDS}),
outside AS (SELECT row, unnest(range(CAST(a AS BIGINT), CAST(b AS BIGINT))) AS pos FROM runs),
gone AS (SELECT o.row, sum(length(w.word)) AS chars FROM outside o JOIN w ON w.row = o.row AND w.pos = o.pos GROUP BY o.row),
{",".join(_repeats_sql(n) for n in _SIZES)},
m AS (
  SELECT d.doc_id, CAST(coalesce(n.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n.chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(again.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep_3.words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(again.chars, 0) AS DOUBLE) / greatest(1, coalesce(n.chars, 0)) AS line_coverage,
    {", ".join(f"CAST(coalesce(rep_{k}.chars, 0) AS DOUBLE) / greatest(1, coalesce(n.chars, 0)) AS coverage_{k}, coalesce(rep_{k}.chars, 0) <= CAST({most} AS DOUBLE) * greatest(1, coalesce(n.chars, 0)) AS ok_{k}" for k, most in MAX_COVERAGE.items())},
    {" AND ".join(f"coalesce(rep_{k}.body, 0) <= CAST({most} AS DOUBLE) * (coalesce(n.chars, 0) - coalesce(gone.chars, 0))" for k, most in MAX_PASSAGES.items())} AS ok_passages,
    coalesce(again.chars, 0) <= CAST({MAX_LINE_COVERAGE} AS DOUBLE) * greatest(1, coalesce(n.chars, 0)) AS ok_lines
  FROM d LEFT JOIN n ON n.row = d.row LEFT JOIN again ON again.row = d.row LEFT JOIN gone ON gone.row = d.row {" ".join(f"LEFT JOIN rep_{k} ON rep_{k}.row = d.row" for k in _SIZES)}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE} AS base_failed, NOT ({_BASE}) AND ok_lines AND ok_passages AND {" AND ".join(f"ok_{k}" for k in MAX_COVERAGE)} AS kept, line_coverage, {", ".join(f"coverage_{k}" for k in MAX_COVERAGE)}
FROM m"""
}
