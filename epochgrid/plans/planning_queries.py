"""Dispatch, sizing, reports and unit classification."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import nal
from ..functions import timeline as t
from ..operators import planning
from ..operators.compare import ordered_digests
from ..operators.quantiles import quantiles
from .registry import E6, TRACK_SQL, query, read, scaled, track


@query(r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM pages)
SELECT page_id, ext, CASE WHEN ext IN ('mp4', 'wav') THEN 'read' ELSE 'unsupported extension ''' || ext || '''' END AS verdict FROM p""")
def format_dispatch(spark, sf_dir):
    ext = planning.extension(F.col("url"))
    verdict = F.when(ext.isin("mp4", "wav"), "read").otherwise(F.concat(F.lit("unsupported extension '"), ext, F.lit("'")))
    return read(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), verdict.alias("verdict"))


@query(r"""
WITH s AS (SELECT regexp_replace(regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1), '\.[A-Za-z0-9]+$', '') AS stem FROM pages)
SELECT stem, count(*) AS n FROM s GROUP BY stem HAVING count(*) > 1""")
def duplicate_stems(spark, sf_dir):
    return planning.duplicate_stems(read(spark, sf_dir, "pages"), "url")


_TRACKS = """
tracks AS (SELECT l_orderkey AS clip_id, CASE WHEN l_linenumber % 3 = 0 THEN 'video' WHEN l_linenumber % 3 = 1 THEN 'audio' ELSE 'text' END AS kind,
  ['avc1', 'hvc1', 'av01', 'vp09', 'xxxx'][l_partkey % 5 + 1] AS codec FROM lineitem)"""


@query(f"""
WITH {_TRACKS}, n AS (SELECT clip_id, count(*) FILTER (kind = 'audio') AS n_audio, count(*) FILTER (kind = 'video') AS n_video, max(CASE WHEN kind = 'video' THEN codec END) AS codec FROM tracks GROUP BY clip_id)
SELECT clip_id, n_audio, n_video, CASE WHEN n_audio > 1 THEN 'more than one audio track' WHEN n_video > 1 THEN 'more than one video track' WHEN n_audio + n_video = 0 THEN 'no track'
  WHEN n_video = 1 AND codec NOT IN ('avc1', 'hvc1', 'hev1') THEN 'video is ' || CASE codec WHEN 'av01' THEN 'AV1' WHEN 'vp09' THEN 'VP9' ELSE 'an unrecognized codec' END || ', not H.264 or H.265' ELSE 'ok' END AS status FROM n""")
def track_check(spark, sf_dir):
    number = F.col("l_linenumber")
    kind = F.when(number % 3 == 0, "video").when(number % 3 == 1, "audio").otherwise("text")
    codec = F.element_at(F.array(*[F.lit(c) for c in ("avc1", "hvc1", "av01", "vp09", "xxxx")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    tracks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), kind.alias("kind"), codec.alias("codec"))
    return planning.track_errors(tracks)


@query("""
WITH s AS (SELECT l_orderkey AS clip_id, l_linenumber, CAST(l_quantity AS BIGINT) AS dur, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected,
  coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END AS dts FROM lineitem)
SELECT clip_id, CAST(sum(dur) AS BIGINT) AS samples, count(*) FILTER (dts <> expected) AS breaks FROM s GROUP BY clip_id""")
def aac_contiguity(spark, sf_dir):
    """Units whose decode time is not the sum of the durations before; some are moved by one."""
    w = Window.partitionBy("clip_id").orderBy("l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, -1)
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), "l_linenumber", "l_partkey", F.round("l_quantity").cast("long").alias("dur"))
    s = s.withColumn("expected", F.coalesce(F.sum("dur").over(w), F.lit(0))).withColumn("dts", F.col("expected") + (F.col("l_partkey") % 17 == 0).cast("long"))
    return s.groupBy("clip_id").agg(F.sum("dur").alias("samples"), F.count_if(F.col("dts") != F.col("expected")).alias("breaks"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def skip_existing(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return planning.pending(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query(f"""
WITH a AS (SELECT p_partkey, p_size AS files, p_partkey % 16 + 1 AS cores, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 + 1 END AS jobs, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 7 + 1 END AS workers, CASE WHEN p_partkey % 2 = 0 THEN p_size * 40 END AS rss FROM part),
b AS (SELECT *, coalesce(jobs, greatest(1, CASE WHEN workers IS NULL THEN least(files, cores) ELSE cores // workers END)) AS j0 FROM a),
c AS (SELECT *, coalesce(workers, greatest(1, cores // j0)) AS w, greatest(1, least(j0, files)) AS j1 FROM b)
SELECT p_partkey, CAST(CASE WHEN coalesce(rss, 0) > 0 THEN greatest(1, least(j1, rss // ({planning.BASE_RSS_MIB} + {planning.WORKER_RSS_MIB} * (w - 1)))) ELSE j1 END AS BIGINT) AS jobs, CAST(w AS BIGINT) AS workers FROM c""")
def batch_cost_plan(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("files"), (key % 16 + 1).alias("cores"), F.when(key % 3 == 0, key % 5 + 1).alias("jobs"), F.when(key % 4 == 0, key % 7 + 1).alias("workers"), F.when(key % 2 == 0, F.col("p_size") * 40).alias("rss"))
    jobs, workers = planning.jobs_and_workers_columns(*[F.col(c) for c in ("files", "cores", "jobs", "workers", "rss")])
    return rows.select("p_partkey", jobs.alias("jobs"), workers.alias("workers"))


_GRID = "(SELECT unnest([160, 224, 336, 1024]) AS resolution), (SELECT unnest([0, 1048576, 4194304]) AS budget), (SELECT unnest([1, 2, 4]) AS depth)"


@query(f"""
WITH g AS (SELECT resolution, budget, depth, CAST((3 * resolution * resolution + 50 * 64) * 4 AS BIGINT) AS bytes FROM {_GRID})
SELECT resolution, budget, depth, bytes AS row_bytes, least(depth, budget // bytes) AS slots, least(depth, budget // bytes) * bytes AS queued, bytes * 32 <= 268435456 AS batch_fits FROM g""")
def queue_capacity(spark, sf_dir):
    three = [F.explode(F.array(*[F.lit(v) for v in values])).alias(n) for n, values in (("resolution", (160, 224, 336, 1024)), ("budget", (0, 1 << 20, 4 << 20)), ("depth", (1, 2, 4)))]
    rows = spark.range(1).select(three[0]).select("*", three[1]).select("*", three[2]).withColumn("row_bytes", planning.row_bytes(F.col("resolution").cast("long"), F.lit(50)))
    slots, queued = planning.queue_slots(F.col("depth"), F.col("budget"), F.col("row_bytes"))
    return rows.select("resolution", "budget", "depth", "row_bytes", slots.alias("slots"), queued.alias("queued"), (F.col("row_bytes") * 32 <= 256 << 20).alias("batch_fits"))


@query(f"""
WITH {TRACK_SQL}, s AS (SELECT clip_id, event_type, CAST(sum(round(value * {E6})) AS BIGINT) AS us FROM track GROUP BY ALL)
SELECT clip_id, '{{' || string_agg('"' || event_type || '":' || us, ',' ORDER BY event_type) || '}}' AS profile FROM s GROUP BY clip_id""")
def stage_profile(spark, sf_dir):
    """Time by stage as JSON, stages in order of their names."""
    s = track(spark, sf_dir).groupBy("clip_id", "event_type").agg(F.sum(scaled(F.col("value"))).alias("us"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "us"))), lambda x: F.concat(F.lit('"'), x["event_type"], F.lit('":'), x["us"].cast("string")))
    return s.groupBy("clip_id").agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("profile"))


@query(f"""
SELECT l_suppkey, count(*) AS n, CAST(round(quantile_cont(l_extendedprice, 0.5) * 10000) AS BIGINT) AS median_e4, CAST(round(quantile_cont(l_extendedprice, 0.05) * 10000) AS BIGINT) AS p5_e4, CAST(round(quantile_cont(l_extendedprice, 0.95) * 10000) AS BIGINT) AS p95_e4 FROM lineitem GROUP BY l_suppkey""")
def bench_summary(spark, sf_dir):
    points = {"median_e4": 0.5, "p5_e4": 0.05, "p95_e4": 0.95}
    found = quantiles(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", points, F.count("*").alias("n"))
    return found.select("l_suppkey", "n", *[scaled(F.col(p), 10_000).alias(p) for p in points])


@query("""
WITH m AS (SELECT l_suppkey, l_linenumber AS workers, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, min(m) AS best FROM m GROUP BY ALL)
SELECT m.l_suppkey, min(workers) AS pick FROM m JOIN b ON b.l_suppkey = m.l_suppkey WHERE m <= best * 1.05 GROUP BY ALL""")
def worker_choice(spark, sf_dir):
    return planning.smallest_within(read(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "workers"), "l_suppkey", "workers", "l_extendedprice")


@query("""
WITH r AS (SELECT o_custkey AS clip_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_orderkey, o_orderstatus FROM orders)
SELECT clip_id, count(*) AS rows, sha256(string_agg(o_orderkey, ',' ORDER BY i)) AS key_digest, sha256(string_agg(o_orderstatus, ',' ORDER BY i)) AS status_digest FROM r GROUP BY clip_id""")
def column_digest(spark, sf_dir):
    """A digest for each logical column of a clip, in the order of its rows, whatever the batches."""
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "clip_id")
    return ordered_digests(rows, "clip_id", ["o_orderdate", "o_orderkey"], {"key_digest": "o_orderkey", "status_digest": "o_orderstatus"})


@query(f"""
WITH {TRACK_SQL}, h AS (SELECT clip_id, dec_idx, pts FROM track WHERE is_sync), q AS (SELECT clip_id, dec_idx, pts FROM track WHERE event_type = 'click'),
u AS (SELECT * FROM h UNION ALL SELECT * FROM q)
SELECT clip_id, count(*) AS n, count(DISTINCT dec_idx) AS distinct_units, min(pts) AS first_pts, max(pts) AS last_pts FROM u GROUP BY clip_id""")
def ordered_union(spark, sf_dir):
    """Head and tail ranges of a chunk, one after the other."""
    samples = track(spark, sf_dir).select("clip_id", "dec_idx", "pts", "is_sync", "event_type")
    both = samples.where("is_sync").unionByName(samples.where("event_type = 'click'"))
    return both.groupBy("clip_id").agg(F.count("*").alias("n"), F.countDistinct("dec_idx").alias("distinct_units"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"))


@query(f"WITH {TRACK_SQL}, l AS (SELECT clip_id, CASE WHEN event_type = 'view' THEN rn % 4 ELSE 0 END AS tid FROM track), m AS (SELECT clip_id, max(tid) AS max_temporal_id FROM l GROUP BY ALL) SELECT m.clip_id, max_temporal_id, count(*) AS n FROM l JOIN m ON m.clip_id = l.clip_id AND m.max_temporal_id = l.tid GROUP BY ALL")
def max_temporal_id(spark, sf_dir):
    rows = track(spark, sf_dir).select("clip_id", F.when(F.col("event_type") == "view", F.col("rn") % 4).otherwise(0).alias("tid"))
    return rows.groupBy("clip_id", "tid").agg(F.count("*").alias("n")).groupBy("clip_id").agg(F.max("tid").alias("max_temporal_id"), F.max_by("n", "tid").alias("n"))


@query(f"WITH {TRACK_SQL}, s AS (SELECT clip_id, sha256(CAST(value AS VARCHAR)) IS NULL AS x, event_type, rn, first_value(event_type) OVER (PARTITION BY clip_id ORDER BY rn) AS declared FROM track) SELECT clip_id, declared, count(*) FILTER (event_type <> declared) AS changed, min(CASE WHEN event_type <> declared THEN rn END) AS first_change FROM s GROUP BY ALL")
def midstream_guard(spark, sf_dir):
    """Parameter sets that differ from the declared ones: here, event types from the clip's first."""
    declared = F.first("event_type").over(Window.partitionBy("clip_id").orderBy("rn"))
    rows = track(spark, sf_dir).withColumn("declared", declared)
    differs = F.col("event_type") != F.col("declared")
    return rows.groupBy("clip_id", "declared").agg(F.count_if(differs).alias("changed"), F.min(F.when(differs, F.col("rn"))).alias("first_change"))


@query("""
SELECT doc_id, octet_length(encode(text)) AS n_bytes, count(*) AS units, CAST(sum(len) AS BIGINT) AS payload, 4 * count(*) AS prefix_bytes
FROM (SELECT doc_id, text, unnest(list_transform(string_split(text, chr(10)), lambda l: octet_length(encode(l)))) AS len FROM documents) GROUP BY ALL""")
def nal_walk(spark, sf_dir):
    """Lines of a document as length-prefixed units: packed, walked again and summed up."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    schema = "doc_id long, n_bytes long, units long, payload long, prefix_bytes long"

    def walk(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = [x.encode() for x in (text or "").split("\n")]
                packed = b"".join(len(x).to_bytes(4, "big") + x for x in lines if x)
                found = [len(u) for u in nal.units(packed, 4) if u is not None]
                empty = len(lines) - len(found)  # a unit is never empty: counted beside
                out.append((doc_id, len((text or "").encode()), len(found) + empty, sum(found), 4 * (len(found) + empty)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "n_bytes", "units", "payload", "prefix_bytes"])

    return rows.mapInArrow(walk, schema)


@query("SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_partkey) % 32 AS kind, l_suppkey % 4 AS ref_idc, (l_orderkey * 7 + l_partkey) % 32 = 1 AND l_suppkey % 4 = 0 AS disposable, (l_orderkey * 7 + l_partkey) % 32 = 5 AS idr FROM lineitem")
def nal_classify(spark, sf_dir):
    """One unit with a slice header for each line item: H.264 classes from the bytes."""
    kind, ref = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 32, F.col("l_suppkey") % 4
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), ref.alias("ref_idc"))

    def classify(batches):
        for batch in batches:
            kinds, refs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            data = [b"\0\0\0\2" + bytes([r << 5 | k, 0x80]) for k, r in zip(kinds, refs, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([nal.avc_disposable(d, 4) for d in data]), pa.array([nal.avc_idr(d, 4) for d in data])], names=[*batch.schema.names, "disposable", "idr"])

    return rows.mapInArrow(classify, rows.select("*").schema.add("disposable", "boolean").add("idr", "boolean"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 10 AS window_ms, ((l_extendedprice::BIGINT) + CAST(l_quantity AS BIGINT) * 10 - 1) // (CAST(l_quantity AS BIGINT) * 10) AS total FROM lineitem WHERE false UNION ALL SELECT l_orderkey, l_linenumber, CAST(round(l_quantity) AS BIGINT) * 10, (CAST(round(l_extendedprice) AS BIGINT) + CAST(round(l_quantity) AS BIGINT) * 10 - 1) // (CAST(round(l_quantity) AS BIGINT) * 10) FROM lineitem")
def epoch_counts(spark, sf_dir):
    window = F.round("l_quantity").cast("long") * 10
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", window.alias("window_ms"), F.round("l_extendedprice").cast("long").alias("ms"))
    return rows.select("l_orderkey", "l_linenumber", "window_ms", t.ceil_div(F.col("ms"), F.col("window_ms")).alias("total"))
