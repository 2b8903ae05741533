"""Timeline projection, epoch grids and nearest-picture selection over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeline as t
from ..operators import align, selection
from .registry import E6, HOUR, TRACK_SQL, gridded, query, read, scaled, track


@query("""
SELECT event_id, user_id AS clip_id,
  CAST(round(((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 - 1.25e0 + 0.5e0) * 1e3) AS BIGINT) AS pts_ms
FROM events""")
def timeline_pts_ms(spark, sf_dir):
    samples = track(spark, sf_dir)
    return samples.select("event_id", "clip_id", t.seconds_to_ms(t.ticks_to_seconds(F.col("ticks"), 1e6, 1.25, 0.5)).alias("pts_ms"))


@query(f"""
WITH p AS (
  SELECT p_partkey, p_size % 4 AS kind, CAST(p_size AS DOUBLE) AS size, 60e0 + p_size AS track_sec FROM part
), e AS (
  SELECT p_partkey, track_sec,
    CASE kind WHEN 0 THEN [] WHEN 1 THEN [{{'m': 1000 * size, 'd': 0e0, 'r': 1e0}}]
      WHEN 2 THEN [{{'m': -1e0, 'd': 500 * size, 'r': 1e0}}, {{'m': 2000e0, 'd': 1000 * size, 'r': 1e0}}]
      ELSE CASE WHEN size % 3 = 0 THEN [{{'m': 0e0, 'd': size, 'r': 2e0}}] WHEN size % 3 = 1 THEN [{{'m': 0e0, 'd': size, 'r': 1e0}}, {{'m': 5e0, 'd': size, 'r': 1e0}}] ELSE [{{'m': -1e0, 'd': size, 'r': 1e0}}] END END AS edits
  FROM p
), r AS (
  SELECT p_partkey,
    CASE WHEN len(edits) = 0 THEN 'ok' WHEN edits[1].r <> 1 THEN 'rate'
      WHEN len(edits) = 2 AND edits[1].m <> -1 THEN 'active edits' WHEN len(edits) = 1 AND edits[1].m = -1 THEN 'active edits' ELSE 'ok' END AS status,
    CASE WHEN len(edits) = 2 THEN edits[2].m / 48000 WHEN len(edits) = 1 THEN edits[1].m / 48000 ELSE 0e0 END AS skip,
    CASE WHEN len(edits) = 2 THEN edits[1].d / 1000 ELSE 0e0 END AS delay,
    CASE WHEN len(edits) = 2 THEN edits[2].d / 1000 + edits[1].d / 1000 WHEN len(edits) = 1 AND edits[1].d > 0 THEN edits[1].d / 1000
      WHEN len(edits) = 1 THEN track_sec - edits[1].m / 48000 ELSE track_sec END AS duration
  FROM e
)
SELECT p_partkey, status, CASE WHEN status = 'ok' THEN CAST(round(skip * {E6}) AS BIGINT) END AS skip_us, CASE WHEN status = 'ok' THEN CAST(round(delay * {E6}) AS BIGINT) END AS delay_us,
  CASE WHEN status = 'ok' THEN CAST(round(duration * {E6}) AS BIGINT) END AS duration_us
FROM r""")
def edit_list_resolve(spark, sf_dir):
    size = F.col("p_size").cast("double")
    edit = lambda m, d, r=1.0: F.struct(*[(x if not isinstance(x, float) else F.lit(x)).cast("double").alias(n) for n, x in (("media_time", m), ("duration", d), ("rate", r))])
    kind = F.col("p_size") % 4
    none = F.array().cast("array<struct<media_time:double,duration:double,rate:double>>")
    bad = F.when(F.col("p_size") % 3 == 0, F.array(edit(0.0, size, 2.0))).when(F.col("p_size") % 3 == 1, F.array(edit(0.0, size), edit(5.0, size))).otherwise(F.array(edit(-1.0, size)))
    edits = F.when(kind == 0, none).when(kind == 1, F.array(edit(size * 1000, 0.0))).when(kind == 2, F.array(edit(-1.0, size * 500), edit(2000.0, size * 1000))).otherwise(bad)
    r = t.resolve_edits(F.col("edits"), size + 60.0, F.lit(1000.0), F.lit(48000.0))
    out = read(spark, sf_dir, "part").withColumn("edits", edits).withColumn("r", r)
    return out.select("p_partkey", "r.status", scaled(F.col("r.skip")).alias("skip_us"), scaled(F.col("r.delay")).alias("delay_us"), scaled(F.col("r.duration")).alias("duration_us"))


_BRUTE = f"""
tot AS (SELECT clip_id, (max(pts) + {{extra}} + {HOUR}) // {HOUR} AS total FROM track GROUP BY clip_id),
grid AS (SELECT clip_id, unnest(range(total)) AS epoch FROM tot),
chosen AS (
  SELECT g.clip_id, g.epoch, g.epoch * {HOUR} AS timestamp_ms, t.pts AS video_timestamp_ms
  FROM grid g JOIN track t ON t.clip_id = g.clip_id
  QUALIFY row_number() OVER (PARTITION BY g.clip_id, g.epoch ORDER BY abs(t.pts - g.epoch * {HOUR}), t.pts) = 1
)"""


@query(f"WITH {TRACK_SQL}, {_BRUTE.format(extra=0)} SELECT * FROM chosen")
def epoch_select(spark, sf_dir):
    """Against the definition: of all pictures the nearest to the epoch's start, the earlier of two."""
    return selection.select_epochs(gridded(track(spark, sf_dir))).select("clip_id", "epoch", "timestamp_ms", F.col("pts").alias("video_timestamp_ms"))


@query(f"WITH {TRACK_SQL}, {_BRUTE.format(extra=5 * HOUR)} SELECT clip_id, count(*) AS epochs, count(*) FILTER (timestamp_ms > video_timestamp_ms + {HOUR}) AS repeated, max(timestamp_ms - video_timestamp_ms) AS longest FROM chosen GROUP BY clip_id")
def tail_repeat(spark, sf_dir):
    """The grid goes five hours beyond the last picture, which repeats."""
    chosen = selection.select_epochs(gridded(track(spark, sf_dir), extra=5 * HOUR))
    late = F.col("timestamp_ms") - F.col("pts")
    return chosen.groupBy("clip_id").agg(F.count("*").alias("epochs"), F.count_if(late > HOUR).alias("repeated"), F.max(late).alias("longest"))


@query(f"""
WITH {TRACK_SQL}, c AS (SELECT clip_id, max(pts) + 1 AS video_ms, count(*) * 44100 * 1800 AS len FROM track GROUP BY clip_id),
a AS (SELECT *, (len * 16000 // 44100 + 800) AS samples FROM c)
SELECT clip_id, video_ms, samples, (samples * 1000 + 15999) // 16000 AS audio_ms, (greatest(video_ms, (samples * 1000 + 15999) // 16000) + {HOUR - 1}) // {HOUR} AS total FROM a""")
def epoch_grid_total(spark, sf_dir):
    clips = track(spark, sf_dir).groupBy("clip_id").agg((F.max("pts") + 1).alias("video_ms"), (F.count("*") * 44100 * 1800).alias("len"))
    clips = clips.withColumn("samples", t.output_samples(F.col("len"), F.lit(44100), 800))
    sound = t.audio_ms(F.col("samples"))
    return clips.select("clip_id", "video_ms", "samples", sound.alias("audio_ms"), t.total_epochs(F.col("video_ms"), sound, HOUR).alias("total"))


@query(f"WITH {TRACK_SQL} SELECT clip_id, count(*) AS kept, max(pts) AS last_pts FROM track WHERE pts >= 0 AND pts < 1296000.5e0 * 1e3 GROUP BY clip_id")
def in_range_filter(spark, sf_dir):
    samples = track(spark, sf_dir).where(t.in_range(F.col("pts"), F.lit(1296000.5)))
    return samples.groupBy("clip_id").agg(F.count("*").alias("kept"), F.max("pts").alias("last_pts"))


@query("""
WITH n AS (SELECT l_suppkey AS clip_id, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT clip_id, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_duplicates, max(n) AS most FROM n GROUP BY clip_id""")
def duplicate_pts(spark, sf_dir):
    return selection.duplicates(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip_id"), "l_shipdate"), "clip_id", "l_shipdate")


@query(f"""
WITH {TRACK_SQL}, {_BRUTE.format(extra=0)}
SELECT clip_id, count(DISTINCT video_timestamp_ms) AS unique_pictures, count(*) AS epochs FROM chosen GROUP BY clip_id""")
def unique_selected(spark, sf_dir):
    """Pictures that are converted once, however many epochs they serve: counted before the epochs are multiplied."""
    chosen = selection.chosen_pictures(gridded(track(spark, sf_dir)))
    return chosen.groupBy("clip_id").agg(F.countDistinct("pts").alias("unique_pictures"), F.sum(F.col("fin") - F.col("beg")).alias("epochs"))


@query(f"""
WITH {TRACK_SQL}, ends AS (
  SELECT clip_id, pts, total, least((pts + (lead(pts) OVER w - pts) // 2) // {HOUR} + 1, total) AS fin
  FROM (SELECT *, (max(pts) OVER (PARTITION BY clip_id) + {HOUR}) // {HOUR} AS total FROM track) WINDOW w AS (PARTITION BY clip_id ORDER BY pts, dec_idx)
) SELECT clip_id, max(coalesce(fin, total)) AS covered, max(total) AS total, max(coalesce(fin, total)) = max(total) AS complete FROM ends GROUP BY clip_id""")
def selection_coverage(spark, sf_dir):
    out = selection.pictures(gridded(track(spark, sf_dir))).groupBy("clip_id").agg(F.max("fin").alias("covered"), F.max("total").alias("total"))
    return out.withColumn("complete", F.col("covered") == F.col("total"))


@query(f"""
WITH {TRACK_SQL}, h AS (SELECT clip_id, pts // {HOUR} AS epoch, event_type, count(*) AS n, min(pts) AS first_pts FROM track GROUP BY ALL),
tot AS (SELECT clip_id, (max(pts) + {HOUR}) // {HOUR} AS total FROM track GROUP BY clip_id), grid AS (SELECT clip_id, unnest(range(total)) AS epoch FROM tot)
SELECT g.clip_id, g.epoch, g.epoch * {HOUR} AS timestamp_ms, coalesce(v.first_pts, -1) AS video_timestamp_ms, coalesce(a.n, 0) AS audio_valid_frames, CASE WHEN a.n IS NULL THEN -10 ELSE a.n END AS level
FROM grid g LEFT JOIN h v ON v.clip_id = g.clip_id AND v.epoch = g.epoch AND v.event_type = 'click' LEFT JOIN h a ON a.clip_id = g.clip_id AND a.epoch = g.epoch AND a.event_type = 'purchase'""")
def stream_align(spark, sf_dir):
    """Clicks as video and purchases as audio: one row per epoch, filled where one is missing."""
    samples = track(spark, sf_dir).withColumn("epoch", t.div(F.col("pts"), HOUR))
    clips = samples.groupBy("clip_id").agg(t.ceil_div(F.max("pts") + 1, HOUR).alias("total")).withColumn("window_ms", F.lit(HOUR).cast("long"))
    video = samples.where("event_type = 'click'").groupBy("clip_id", "epoch").agg(F.min("pts").alias("video_timestamp_ms"))
    audio = samples.where("event_type = 'purchase'").groupBy("clip_id", "epoch").agg(F.count("*").alias("audio_valid_frames"))
    audio = audio.withColumn("level", F.col("audio_valid_frames").cast("int"))
    out = align.merge(align.grid(clips), video, audio, {"video_timestamp_ms": -1, "audio_valid_frames": 0, "level": int(align.SILENCE)})
    return out.select("clip_id", "epoch", "timestamp_ms", F.col("video_timestamp_ms").cast("long"), F.col("audio_valid_frames").cast("long"), "level")


@query(f"""
WITH {TRACK_SQL}, x AS (SELECT clip_id, rn AS epoch, lag(rn, 1, -1) OVER (PARTITION BY clip_id ORDER BY rn) AS before FROM track WHERE event_type <> 'error')
SELECT clip_id, count(*) AS rows, count(*) FILTER (epoch <> before + 1) AS gaps FROM x GROUP BY clip_id""")
def epoch_order_check(spark, sf_dir):
    """Errors are taken out, which leaves gaps."""
    return align.order_check(track(spark, sf_dir).where("event_type <> 'error'").withColumn("epoch", F.col("rn")))


@query("SELECT o_custkey AS clip_id, o_orderkey, epoch, epoch // 4 AS batch_id, epoch % 4 AS batch_row FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS epoch FROM orders)")
def batch_pack(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "clip_id")
    return align.batches(rows, ["o_orderdate", "o_orderkey"], 4).select("clip_id", "o_orderkey", "epoch", "batch_id", "batch_row")


@query("""
WITH c AS (SELECT o_custkey AS clip_id, count(*) AS rows FROM orders GROUP BY ALL), x AS (SELECT *, unnest([0, 5, -1, -12, 1000000]) AS index FROM c),
e AS (SELECT clip_id, rows, index, CASE WHEN index < 0 THEN index + rows ELSE index END AS k FROM x)
SELECT clip_id, rows, CAST(index AS BIGINT) AS index, CASE WHEN k >= 0 AND k < rows THEN k END AS epoch, CASE WHEN k >= 0 AND k < rows THEN k // 4 END AS batch_id, CASE WHEN k >= 0 AND k < rows THEN k % 4 END AS batch_row FROM e""")
def batch_locate(spark, sf_dir):
    clips = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("clip_id")).agg(F.count("*").alias("rows"))
    return align.locate(clips, [0, 5, -1, -12, 1_000_000], 4).select("clip_id", "rows", "index", "epoch", "batch_id", "batch_row")


@query("""
WITH c AS (SELECT o_custkey AS clip_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS epoch FROM orders),
b AS (SELECT clip_id, epoch // 4 AS batch_id, count(*) AS rows FROM c GROUP BY ALL)
SELECT clip_id, batch_id, rows, CAST(sum(rows) OVER (PARTITION BY clip_id ORDER BY batch_id) AS BIGINT) AS ends FROM b""")
def batch_prefix_ends(spark, sf_dir):
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "clip_id")
    sizes = align.batches(rows, ["o_orderdate", "o_orderkey"], 4).groupBy("clip_id", "batch_id").agg(F.count("*").alias("rows"))
    return sizes.withColumn("ends", F.sum("rows").over(Window.partitionBy("clip_id").orderBy("batch_id")))
