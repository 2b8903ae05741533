"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host the pages that contain a line are counted, once each, and divided by the host's pages. A line on at least
``MIN_PAGES`` pages whose share exceeds ``BOILERPLATE_PERCENT`` percent is boilerplate of that host and is dropped from
all its pages. Pages of a host with the same text count as one: copies of a page don't make its lines boilerplate. Lines
and pages are compared whole, by their 64-bit hash; lines of spaces only are neither counted nor dropped.

Near copies are not equal pages, but what they share is not boilerplate either. Lines that are frequent by the count above
are counted again: pages with more than ``COPY_PERCENT`` percent of their characters in such lines are copies of each
other for the most part, and all of a host's count as one. A line stays boilerplate if pages with text of their own make
it so. So a host whose pages nearly all hold less text than their frame keeps its frame.

Counting shuffles hashes, made distinct and summed before the shuffle, so that neither a host nor a line that holds a
third of all rows meets in one task. A host has at most (lines per page) * 100 / ``BOILERPLATE_PERCENT`` boilerplate lines on average;
their table is written, and Spark broadcasts it if its measured size is under the session's threshold, else it splits
skewed hosts while joining. Texts are never shuffled in the first case, and lines keep their order in both.

Defined results: a null host counts as the empty one; a null text stays null and has no lines; a text whose lines all go
becomes empty, its row stays. Repeated rows are pages of their own. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import gathered, kept
from .text import as_rows

MIN_PAGES = 5
BOILERPLATE_PERCENT = 2
#: A page of which more than this is in frequent lines is taken for a copy.
COPY_PERCENT = 75


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _counted(line: Column) -> Column:
    return F.trim(line) != ""


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def boilerplate(documents: DataFrame, host_col: str = "source", text_col: str = "text", min_pages: int = MIN_PAGES, percent: int = BOILERPLATE_PERCENT) -> DataFrame:
    """_host and _lines: the hashes of the host's boilerplate lines, for hosts that have any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pages = documents.select(F.coalesce(F.col(host_col), F.lit("")).alias("_host"), F.xxhash64(text).alias("_page"), text.alias("_text"))
    totals = pages.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_pages"))
    hashes = F.array_distinct(_hashes(F.filter(_lines(F.col("_text")), _counted)))
    lines = pages.select("_host", "_page", F.explode(hashes).alias("_line")).distinct().groupBy("_host", "_line").agg(F.count("*").alias("_n"))
    often = (F.col("_n") >= min_pages) & (F.col("_n") * 100 > F.col("_pages") * percent)
    found = lines.where(F.col("_n") >= min_pages).join(totals, "_host").where(often).groupBy("_host", "_pages").agg(F.collect_list("_line").alias("_found"))
    # Again for these lines, with the host's copied pages as one.
    met = gathered(pages, documents).join(kept(found, "frequent", documents), "_host")
    full = F.filter(_lines(F.col("_text")), _counted)
    own = F.array_intersect(_hashes(full), F.col("_found"))
    met = met.select("_host", "_pages", "_page", full.alias("_full"), own.alias("_own")).where(F.size("_own") > 0)
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x))
    shared = size(F.filter("_full", lambda x: F.array_contains(F.col("_own"), F.xxhash64(x))))
    page = F.when(shared * 100 <= size(F.col("_full")) * COPY_PERCENT, F.col("_page"))
    again = met.select("_host", "_pages", page.alias("_page"), F.explode("_own").alias("_line")).distinct().groupBy("_host", "_pages", "_line").agg(F.count("*").alias("_n"))
    return again.where(often).groupBy("_host").agg(F.collect_list("_line").alias("_lines"))


def drop_boilerplate(documents: DataFrame, host_col: str = "source", text_col: str = "text", min_pages: int = MIN_PAGES, percent: int = BOILERPLATE_PERCENT) -> DataFrame:
    """row (all columns of documents), cleaned, n_lines and n_dropped for every row."""
    found = kept(boilerplate(documents, host_col, text_col, min_pages, percent), "boilerplate", documents)
    text = F.col(f"row.{text_col}")
    lines = _lines(text)
    met = gathered(as_rows(documents), documents).join(found, F.coalesce(F.col(f"row.{host_col}"), F.lit("")) == F.col("_host"), "left")
    # Of the host's lines, those in this text: few, so that the search for each line is short.
    own = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col("_lines"))
    hit = met.select("row", F.coalesce(own, F.array().cast("array<bigint>")).alias("own"))
    keep = F.filter(lines, lambda x: ~_counted(x) | ~F.array_contains(F.col("own"), F.xxhash64(x)))
    some = F.size("own") > 0
    return hit.select(
        "row",
        F.when(some, F.array_join(keep, "\n")).otherwise(text).alias("cleaned"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(some, F.size(lines) - F.size(keep)).otherwise(0).cast("long").alias("n_dropped"),
    )


def clean(documents: DataFrame) -> DataFrame:
    """documents with all their columns, texts without boilerplate, and n_chars, if there, as it is now."""
    out = drop_boilerplate(documents)
    new = {"text": F.col("cleaned")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("cleaned").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).select("row.doc_id", F.col("cleaned").alias("text"), "n_lines", "n_dropped")


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE_SQL = {
    "op5_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, text FROM documents),
l AS (SELECT row, host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
t AS (SELECT host, count(DISTINCT coalesce(text, '')) AS pages FROM d GROUP BY host),
p AS (SELECT host, text, min(row) AS row FROM d GROUP BY host, text),
c AS (SELECT l.host, l.text, l.line FROM l JOIN p ON p.row = l.row WHERE trim(l.line) <> ''),
f AS (
  SELECT x.host, x.line FROM (SELECT DISTINCT host, text, line FROM c) x JOIN t ON t.host = x.host
  GROUP BY x.host, x.line, t.pages HAVING count(*) >= {MIN_PAGES} AND count(*) * 100 > t.pages * {BOILERPLATE_PERCENT}
),
o AS (SELECT c.host, c.text, CASE WHEN 100 * coalesce(sum(length(c.line)) FILTER (f.line IS NOT NULL), 0) <= {COPY_PERCENT} * sum(length(c.line)) THEN c.text END AS page FROM c LEFT JOIN f ON f.host = c.host AND f.line = c.line GROUP BY c.host, c.text),
b AS (
  SELECT x.host, x.line FROM (SELECT DISTINCT c.host, o.page, c.line FROM c JOIN f ON f.host = c.host AND f.line = c.line JOIN o ON o.host = c.host AND o.text = c.text) x JOIN t ON t.host = x.host
  GROUP BY x.host, x.line, t.pages HAVING count(*) >= {MIN_PAGES} AND count(*) * 100 > t.pages * {BOILERPLATE_PERCENT}
),
k AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON b.host = l.host AND b.line = l.line),
a AS (SELECT row, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM k GROUP BY row)
SELECT d.doc_id, a.text, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_dropped, 0) AS n_dropped FROM d LEFT JOIN a ON a.row = d.row
"""
}
