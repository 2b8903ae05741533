"""Chunk plans, skipping and reconciling over the same tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, planning, selection, skip
from .registry import HOUR, TRACK_SQL, gridded, query, track

TARGET = 2 * 24 * HOUR

_CLEAN = """
clean AS (
  SELECT *, max(pts) OVER (PARTITION BY clip_id ORDER BY dec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prefix_max,
    min(pts) OVER (PARTITION BY clip_id ORDER BY dec_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix_min
  FROM track
)"""


@query(f"WITH {TRACK_SQL}, {_CLEAN} SELECT clip_id, dec_idx, pts, prefix_max, suffix_min, is_sync AND coalesce(prefix_max < suffix_min, true) AS clean FROM clean")
def chunk_clean_cut(spark, sf_dir):
    return chunks.clean_cuts(track(spark, sf_dir)).select("clip_id", "dec_idx", "pts", "prefix_max", "suffix_min", "clean")


def _greedy_sql(candidates: str, first: str, target: int) -> str:
    """candidates: clip_id, at, value; first: clip_id, value."""
    return f"""
cand AS ({candidates}), start AS ({first}),
cuts AS (
  SELECT clip_id, CAST(0 AS BIGINT) AS at, value FROM start
  UNION ALL
  SELECT u.clip_id, n.at, n.value FROM cuts u, LATERAL (SELECT c.at, c.value FROM cand c WHERE c.clip_id = u.clip_id AND c.at > u.at AND c.value - u.value >= {target} ORDER BY c.at LIMIT 1) n
), sizes AS (SELECT clip_id, count(*) AS n FROM track GROUP BY clip_id)
SELECT u.clip_id, row_number() OVER w - 1 AS chunk_id, u.at AS dec_lo, coalesce(lead(u.at) OVER w, s.n) AS dec_hi FROM cuts u JOIN sizes s ON s.clip_id = u.clip_id WINDOW w AS (PARTITION BY u.clip_id ORDER BY u.at)"""


_PLAN = _greedy_sql("SELECT clip_id, dec_idx AS at, suffix_min AS value FROM clean WHERE is_sync AND prefix_max < suffix_min AND dec_idx > 0", "SELECT clip_id, min(pts) AS value FROM track GROUP BY clip_id", TARGET)


@query(f"WITH RECURSIVE {TRACK_SQL}, {_CLEAN}, {_PLAN}")
def chunk_plan_greedy(spark, sf_dir):
    return chunks.plan_chunks(track(spark, sf_dir), TARGET)


def _irap(samples):
    """Signups are random access pictures; views are leading ones."""
    return samples.withColumns({"is_irap": F.col("is_sync"), "is_rasl": F.col("disposable")})


@query(f"WITH RECURSIVE {TRACK_SQL}, " + _greedy_sql("SELECT clip_id, dec_idx AS at, pts AS value FROM track WHERE is_sync AND dec_idx > 0", "SELECT clip_id, pts AS value FROM track WHERE dec_idx = 0", TARGET))
def irap_chunk_plan(spark, sf_dir):
    return chunks.plan_irap_chunks(_irap(track(spark, sf_dir)), TARGET)


@query(f"""
WITH {TRACK_SQL}, w AS (
  SELECT *, max(CASE WHEN is_sync THEN dec_idx END) OVER o AS last_irap, max(CASE WHEN NOT is_sync AND NOT disposable THEN dec_idx END) OVER o AS last_other FROM track
  WINDOW o AS (PARTITION BY clip_id ORDER BY dec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) SELECT clip_id, dec_idx, last_irap AS run_of FROM w WHERE disposable AND last_irap IS NOT NULL AND coalesce(last_other, -1) < last_irap""")
def leading_runs(spark, sf_dir):
    return chunks.leading_runs(_irap(track(spark, sf_dir))).where("run_of is not null").select("clip_id", "dec_idx", "run_of")


@query(f"""
WITH {TRACK_SQL} SELECT clip_id, count(*) AS kept FROM track t
WHERE NOT (disposable AND dec_idx > 0 AND NOT EXISTS (SELECT 1 FROM track o WHERE o.clip_id = t.clip_id AND o.dec_idx > 0 AND o.dec_idx < t.dec_idx AND NOT o.disposable)) GROUP BY clip_id""")
def drop_leading(spark, sf_dir):
    return skip.drop_leading(_irap(track(spark, sf_dir))).groupBy("clip_id").agg(F.count("*").alias("kept"))


_SELECTED = f"""
ends AS (
  SELECT clip_id, dec_idx, pts, least((pts + (lead(pts) OVER w - pts) // 2) // {HOUR} + 1, total) AS f, total
  FROM (SELECT *, (max(pts) OVER (PARTITION BY clip_id) + {HOUR}) // {HOUR} AS total FROM track) WINDOW w AS (PARTITION BY clip_id ORDER BY pts, dec_idx)
), sel AS (
  SELECT * FROM (SELECT *, coalesce(f, total) AS fin, lag(coalesce(f, total), 1, 0) OVER (PARTITION BY clip_id ORDER BY pts, dec_idx) AS beg FROM ends) WHERE fin > beg
)"""


@query(f"""
WITH RECURSIVE {TRACK_SQL}, {_CLEAN}, {_SELECTED}, plan AS (SELECT * FROM (WITH RECURSIVE {_PLAN}))
SELECT s.clip_id, p.chunk_id, count(*) AS pictures, CAST(sum(s.fin - s.beg) AS BIGINT) AS epochs FROM sel s JOIN plan p ON p.clip_id = s.clip_id AND s.dec_idx >= p.dec_lo AND s.dec_idx < p.dec_hi GROUP BY ALL""")
def selection_to_chunk(spark, sf_dir):
    samples = track(spark, sf_dir)
    chosen = selection.chosen_pictures(gridded(samples)).select("clip_id", "dec_idx", "beg", "fin")
    owned = chunks.assign_to_chunks(chosen, chunks.plan_chunks(samples, TARGET))
    return owned.groupBy("clip_id", "chunk_id").agg(F.count("*").alias("pictures"), F.sum(F.col("fin") - F.col("beg")).alias("epochs"))


@query(f"""
WITH RECURSIVE {TRACK_SQL}, {_CLEAN}, {_SELECTED}, plan AS (SELECT * FROM (WITH RECURSIVE {_PLAN})),
n AS (SELECT s.clip_id, p.chunk_id, count(*) AS n FROM sel s JOIN plan p ON p.clip_id = s.clip_id AND s.dec_idx >= p.dec_lo AND s.dec_idx < p.dec_hi GROUP BY ALL),
c AS (SELECT clip_id, count(*) AS chunks, max(n) * 224 * 224 * 12 AS chunk_bytes FROM n GROUP BY clip_id)
SELECT clip_id, chunks, chunk_bytes, greatest(1, least(8 + 1, 67108864 // greatest(chunk_bytes, 1))) AS in_flight, least(8, greatest(1, least(8 + 1, 67108864 // greatest(chunk_bytes, 1))), chunks) AS workers,
  CASE WHEN chunks < 2 THEN 'fewer than two chunks' WHEN chunk_bytes > 67108864 THEN 'a chunk exceeds the buffer' ELSE 'chunked' END AS plan_reason
FROM c""")
def chunk_window(spark, sf_dir):
    """Chunks in flight under a byte budget, and why a clip is not decoded in chunks."""
    samples = track(spark, sf_dir)
    chosen = selection.chosen_pictures(gridded(samples)).select("clip_id", "dec_idx", "beg", "fin")
    n = chunks.assign_to_chunks(chosen, chunks.plan_chunks(samples, TARGET)).groupBy("clip_id", "chunk_id").agg(F.count("*").alias("n"))
    c = n.groupBy("clip_id").agg(F.count("*").alias("chunks"), (F.max("n") * (224 * 224 * 12)).alias("chunk_bytes"))
    in_flight, workers = chunks.chunk_window(F.lit(8), F.lit(64 << 20), F.col("chunk_bytes"), F.col("chunks"))
    reason = F.when(F.col("chunks") < 2, "fewer than two chunks").when(F.col("chunk_bytes") > 64 << 20, "a chunk exceeds the buffer").otherwise("chunked")
    return c.select("clip_id", "chunks", "chunk_bytes", in_flight.alias("in_flight"), workers.alias("workers"), reason.alias("plan_reason"))


@query(f"""
WITH {TRACK_SQL}, {_SELECTED}, u AS (SELECT t.*, t.disposable AND s.pts IS NULL AS skipped FROM track t LEFT JOIN (SELECT DISTINCT clip_id, pts FROM sel) s ON s.clip_id = t.clip_id AND s.pts = t.pts)
SELECT clip_id, count(*) AS units, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped) AS decoded FROM u GROUP BY clip_id""")
def skip_nonref(spark, sf_dir):
    samples = track(spark, sf_dir)
    left = skip.decodable(samples, selection.chosen_pictures(gridded(samples))).groupBy("clip_id").agg(F.count("*").alias("decoded"))
    units = samples.groupBy("clip_id").agg(F.count("*").alias("units")).join(left, "clip_id", "left")
    decoded = F.coalesce("decoded", F.lit(0))
    return units.select("clip_id", "units", (F.col("units") - decoded).alias("skipped"), decoded.alias("decoded"))


@query(f"""
WITH {TRACK_SQL}, a AS (SELECT clip_id, pts, row_number() OVER (PARTITION BY clip_id ORDER BY pts, dec_idx) AS i FROM track),
b AS (SELECT clip_id, pts, row_number() OVER (PARTITION BY clip_id ORDER BY pts, dec_idx) AS i FROM track WHERE event_type <> 'error')
SELECT coalesce(a.clip_id, b.clip_id) AS clip_id, count(*) AS expected, count(b.pts) AS decoded, count(*) FILTER (a.pts = b.pts) AS matched, min(CASE WHEN a.pts IS DISTINCT FROM b.pts THEN a.i END) AS first_difference
FROM a FULL JOIN b ON a.clip_id = b.clip_id AND a.i = b.i GROUP BY 1""")
def picture_reconcile(spark, sf_dir):
    """Decoding lost the errors: where does the order of what came out first differ from what was expected?"""
    samples = track(spark, sf_dir)
    met = skip.reconcile(samples, samples.where("event_type <> 'error'"))
    differs = ~F.col("expected_pts").eqNullSafe(F.col("decoded_pts"))
    return met.groupBy("clip_id").agg(F.count("*").alias("expected"), F.count("decoded_pts").alias("decoded"), F.count_if(F.col("expected_pts") == F.col("decoded_pts")).alias("matched"), F.min(F.when(differs, F.col("i").cast("long"))).alias("first_difference"))


#: Some pictures of every seventh clip are decoded eighty places late.
_LATE = "rn + CASE WHEN clip_id % 7 = 0 AND rn % 40 = 3 THEN 80 ELSE 0 END"


@query(f"""
WITH {TRACK_SQL}, d AS (SELECT clip_id, pts, row_number() OVER (PARTITION BY clip_id ORDER BY {_LATE}, rn) AS dec FROM track),
n AS (SELECT a.clip_id, a.dec, count(b.dec) AS before FROM d a LEFT JOIN d b ON b.clip_id = a.clip_id AND b.dec < a.dec AND b.pts > a.pts GROUP BY ALL)
SELECT clip_id, count(*) FILTER (before >= {chunks.REORDER}) AS n_late FROM n GROUP BY clip_id""")
def reorder_violation(spark, sf_dir):
    """Against counting inversions by a self-join."""
    from pyspark.sql import Window

    samples = track(spark, sf_dir).withColumn("dec_idx", F.row_number().over(Window.partitionBy("clip_id").orderBy(F.expr(_LATE), "rn")))
    return chunks.reorder_violations(samples)


@query(f"""
WITH {TRACK_SQL}, x AS (SELECT clip_id, dec_idx, pts, is_sync, lead(dec_idx) OVER (PARTITION BY clip_id, is_sync ORDER BY dec_idx) AS nxt FROM track)
SELECT clip_id, dec_idx AS dec_lo, coalesce(nxt, 1099511627776) AS dec_hi, pts AS pts_lo FROM x WHERE is_sync""")
def sync_spans(spark, sf_dir):
    """The decode span that each sync picture opens."""
    from pyspark.sql import Window

    sync = track(spark, sf_dir).where("is_sync")
    return sync.select("clip_id", F.col("dec_idx").alias("dec_lo"), F.coalesce(F.lead("dec_idx").over(Window.partitionBy("clip_id").orderBy("dec_idx")), F.lit(1 << 40)).alias("dec_hi"), F.col("pts").alias("pts_lo"))


@query(f"WITH {TRACK_SQL} SELECT clip_id, count(*) AS samples, count(*) * {chunks.SAMPLE_BYTES} AS bytes, count(*) <= {chunks.MAX_SAMPLES} AS fits FROM track GROUP BY clip_id")
def planning_budget(spark, sf_dir):
    out = track(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("samples"))
    return out.select("clip_id", "samples", (F.col("samples") * chunks.SAMPLE_BYTES).alias("bytes"), (F.col("samples") <= chunks.MAX_SAMPLES).alias("fits"))




_OVER = """
others AS (SELECT clip_id, dec_idx FROM track WHERE NOT disposable),
behind AS (SELECT t.clip_id, t.dec_idx, t.pts, (SELECT min(o.dec_idx) FROM others o WHERE o.clip_id = t.clip_id AND o.dec_idx > t.dec_idx) AS behind FROM track t),
over AS (
  SELECT p.clip_id, p.chunk_id, p.dec_lo AS head, coalesce(b.behind, s.n) AS tail_lo, greatest(coalesce(b.behind, s.n), coalesce(lead(coalesce(b.behind, s.n)) OVER w, s.n)) AS tail_hi, b.pts AS pts_lo, lead(b.pts) OVER w AS pts_hi
  FROM plan p JOIN behind b ON b.clip_id = p.clip_id AND b.dec_idx = p.dec_lo JOIN (SELECT clip_id, count(*) AS n FROM track GROUP BY ALL) s ON s.clip_id = p.clip_id
  WINDOW w AS (PARTITION BY p.clip_id ORDER BY p.chunk_id)
)"""
_IRAP_PLAN = _greedy_sql("SELECT clip_id, dec_idx AS at, pts AS value FROM track WHERE is_sync AND dec_idx > 0", "SELECT clip_id, pts AS value FROM track WHERE dec_idx = 0", TARGET)


@query(f"WITH RECURSIVE {TRACK_SQL}, plan AS (SELECT * FROM (WITH RECURSIVE {_IRAP_PLAN})), {_OVER} SELECT * FROM over")
def overlapping_chunks(spark, sf_dir):
    """Views are leading pictures: chunks decode beyond the next start, and own times up to it."""
    return chunks.plan_overlapping_chunks(_irap(track(spark, sf_dir)), TARGET)


@query(f"""
WITH RECURSIVE {TRACK_SQL}, plan AS (SELECT * FROM (WITH RECURSIVE {_IRAP_PLAN})), {_OVER}
SELECT t.clip_id, t.dec_idx, t.pts FROM track t LEFT JOIN over o ON o.clip_id = t.clip_id AND t.pts >= o.pts_lo AND (o.pts_hi IS NULL OR t.pts < o.pts_hi)
WHERE NOT coalesce(t.dec_idx = o.head OR t.dec_idx >= o.tail_lo AND t.dec_idx < o.tail_hi, false)""")
def unowned_pictures(spark, sf_dir):
    """Here some pictures are not decodable by their owner, since views are taken for leading pictures anywhere."""
    samples = _irap(track(spark, sf_dir))
    return chunks.unowned(samples, chunks.plan_overlapping_chunks(samples, TARGET))


@query(f"""
WITH {TRACK_SQL}, c AS (SELECT clip_id, clip_id % 5 AS workers, CASE WHEN clip_id % 7 = 6 THEN 2 ELSE 0 END AS decoder_threads, count(*) * 2500 AS samples, count(*) FILTER (event_type = 'click') - 10 AS presented, (clip_id % 4) // 3 AS duplicates, count(*) FILTER (is_sync) % 3 AS chunks FROM track GROUP BY clip_id)
SELECT clip_id, CASE WHEN workers < 2 OR decoder_threads <> 0 THEN 'one worker was asked for' WHEN samples > 174762 THEN 'too many samples to plan within the memory for it' WHEN presented = 0 THEN 'no picture lies on the timeline'
  WHEN duplicates > 0 THEN 'several pictures share a time' WHEN chunks < 2 THEN 'there is no clean place to cut' ELSE 'chunked' END AS plan_reason FROM c""")
def plan_reason(spark, sf_dir):
    c = track(spark, sf_dir).groupBy("clip_id").agg((F.count("*") * 2500).alias("samples"), (F.count_if(F.col("event_type") == "click") - 10).alias("presented"), (F.count_if("is_sync") % 3).alias("chunks"))
    c = c.withColumns({"workers": F.col("clip_id") % 5, "decoder_threads": F.when(F.col("clip_id") % 7 == 6, 2).otherwise(0), "duplicates": F.floor((F.col("clip_id") % 4) / 3)})
    return c.select("clip_id", planning.plan_reason(set(c.columns)).alias("plan_reason"))
