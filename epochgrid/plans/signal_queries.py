"""Audio and picture arithmetic: embeddings serve as signals and planes, parts and line items as samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dsp
from ..functions import timeline as t
from ..operators.quantiles import quantiles
from .registry import E6, query, read, scaled


def signals(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query(f"""
WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(32)) AS frame FROM embeddings)
SELECT vec_id, frame, CAST(round((x[2 * frame + 1] + x[2 * frame + 2]) / 2 * {E6}) AS BIGINT) AS mono_e6 FROM f""")
def downmix(spark, sf_dir):
    """Vectors as 32 frames of two channels."""
    f = signals(spark, sf_dir).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("x", i * 2 + 1, F.lit(2)))).alias("frame", "c"))
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), scaled(dsp.channel_mean(F.col("c"))).alias("mono_e6"))


@query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) % 65536 - 32768 AS v, [8, 16, 24, 32][l_linenumber % 4 + 1] AS bits FROM lineitem)
SELECT l_orderkey, l_linenumber, bits, CAST(round(v / CAST(1::BIGINT << (bits - 1) AS DOUBLE) * {E6}) AS BIGINT) AS sample_e6 FROM s""")
def pcm_scale(spark, sf_dir):
    bits = F.element_at(F.array(*[F.lit(b) for b in (8, 16, 24, 32)]), F.col("l_linenumber") % 4 + 1)
    v = F.round("l_extendedprice").cast("long") % 65536 - 32768
    s = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.alias("bits"), v.alias("v"))
    return s.select("l_orderkey", "l_linenumber", "bits", scaled(F.col("v") / F.pow(F.lit(2.0), F.col("bits") - 1)).alias("sample_e6"))


_SINC = """
raw AS (
  SELECT p, t, t - p / 1024e0 AS x FROM (SELECT unnest(range(1024)) AS p), (SELECT unnest(range(-64, 65)) AS t)
), w AS (
  SELECT p, t, CASE WHEN abs(x * {cutoff}) < 1e-12 THEN 1e0 ELSE sin(pi() * x * {cutoff}) / (pi() * x * {cutoff}) END
    * CASE WHEN (x + 64) / 128 BETWEEN 0 AND 1 THEN 0.42e0 - 0.5e0 * cos(2 * pi() * (x + 64) / 128) + 0.08e0 * cos(4 * pi() * (x + 64) / 128) ELSE 0e0 END * {cutoff} AS w FROM raw
), sinc AS (SELECT p, t, w / sum(w) OVER (PARTITION BY p) AS w FROM w)"""


def sinc_weights_frame(spark, rate):
    from pyspark.sql import Window

    rows = spark.range(1024).select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(-64), F.lit(64))).alias("t"))
    raw = rows.withColumn("w", dsp.raw_sinc_weight(F.col("p").cast("double"), F.col("t").cast("double"), rate))
    return raw.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("p")))


@query(f"WITH {_SINC.format(cutoff='(0.95e0 * 16000 / 44100)')} SELECT p, t, CAST(round(w * {E6}) AS BIGINT) AS w_e6 FROM sinc")
def sinc_weights(spark, sf_dir):
    """The whole table for 44.1 kHz, closed form against closed form."""
    return sinc_weights_frame(spark, 44100).select("p", F.col("t").cast("long").alias("t"), scaled(F.col("w")).alias("w_e6"))


@query(f"""
WITH {_SINC.format(cutoff='(0.95e0 * 16000 / 24000)')}, o AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(42)) AS pos FROM embeddings),
c AS (SELECT *, pos * 24000e0 / 16000 AS src FROM o)
SELECT c.vec_id, c.pos, CAST(round(sum(c.x[CAST(floor(src) AS BIGINT) + s.t + 1] * s.w) * {E6}) AS BIGINT) AS y_e6
FROM c JOIN sinc s ON s.p = least(round((src - floor(src)) * 1024), 1023) AND floor(src) + s.t BETWEEN 0 AND 63 GROUP BY ALL""")
def resample_fir(spark, sf_dir):
    """64 samples at 24 kHz to 16 kHz. Positions and the taps they need are literals; only the signal is a column."""
    import numpy as np

    from ..functions.kernels import PHASES, RADIUS

    cutoff = 0.95 * 16000 / 24000
    outputs = []
    for pos in range(64 * 16000 // 24000):
        src = pos * 24000 / 16000
        center = int(src)
        phase = min(int((src - center) * PHASES + 0.5), PHASES - 1)
        x = np.arange(-RADIUS, RADIUS + 1) - phase / PHASES
        at = (x + RADIUS) / (2 * RADIUS)
        w = np.sinc(x * cutoff) * np.where((at >= 0) & (at <= 1), 0.42 - 0.5 * np.cos(2 * np.pi * at) + 0.08 * np.cos(4 * np.pi * at), 0) * cutoff
        w /= w.sum()
        taps = [(center + k - RADIUS, w[k]) for k in range(2 * RADIUS + 1) if 0 <= center + k - RADIUS < 64]
        outputs.append(dsp.dot(F.slice("x", taps[0][0] + 1, len(taps)), F.array(*[F.lit(float(v)) for _, v in taps])))
    rows = signals(spark, sf_dir).select("vec_id", F.posexplode(F.array(*outputs)).alias("pos", "y"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), scaled(F.col("y")).alias("y_e6"))


_FRAMES = """
f AS (
  SELECT vec_id, frame, list_transform(range(16), lambda n: coalesce(x[frame * 8 + n + 1], 0e0) * 0.5e0 * (1 - cos(2 * pi() * n / 15))) AS h
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(8)) AS frame FROM embeddings)
)"""
_POWER = """
p AS (
  SELECT vec_id, frame, k, power(list_sum(list_transform(range(16), lambda n: h[n + 1] * cos(2 * pi() * k * n / 16))), 2) + power(list_sum(list_transform(range(16), lambda n: h[n + 1] * sin(2 * pi() * k * n / 16))), 2) AS e
  FROM (SELECT *, unnest(range(9)) AS k FROM f)
)"""


def shaped(spark, sf_dir):
    """Frames of 16 samples, 8 apart, under a Hann window."""
    f = signals(spark, sf_dir).select("vec_id", F.posexplode(dsp.frames(F.col("x"), 16, 8, 8)).alias("frame", "f"))
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), F.zip_with("f", dsp.hann(16), lambda a, b: a * b).alias("h"))


@query(f"WITH {_FRAMES} SELECT vec_id, frame, CAST(round(list_sum(list_transform(h, lambda v: v * v)) * {E6}) AS BIGINT) AS energy_e6 FROM f")
def hann_frame(spark, sf_dir):
    return shaped(spark, sf_dir).select("vec_id", "frame", scaled(dsp.dot(F.col("h"), F.col("h"))).alias("energy_e6"))


@query(f"WITH {_FRAMES}, {_POWER} SELECT vec_id, frame, k, CAST(round(e * {E6}) AS BIGINT) AS power_e6 FROM p")
def stft_power(spark, sf_dir):
    rows = shaped(spark, sf_dir).select("vec_id", "frame", F.posexplode(dsp.power(F.col("h"), 16)).alias("k", "e"))
    return rows.select("vec_id", "frame", F.col("k").cast("long").alias("k"), scaled(F.col("e")).alias("power_e6"))


def _corners(mels: int, fft: int) -> str:
    point = lambda i: f"{fft} * 700 * (pow(10e0, 2595e0 * log10(1 + 8000 / 700e0) * ({i}) / {mels + 1} / 2595) - 1) / 16000"
    return f"""
bank AS (
  SELECT m, k, CASE WHEN k > l AND k < c THEN (k - l) / (c - l) WHEN k >= c AND k < r THEN (r - k) / (r - c) ELSE 0e0 END AS w
  FROM (SELECT m, k, {point("m")} AS l, {point("m + 1")} AS c, {point("m + 2")} AS r FROM (SELECT unnest(range({mels})) AS m), (SELECT unnest(range({fft // 2 + 1})) AS k))
)"""


def filterbank(spark, mels, fft):
    rows = spark.range(mels).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fft // 2).cast("long"))).alias("k"))
    corner = lambda i: dsp.mel_point(F.col("m") + float(i), mels, 16000, fft)
    return rows.withColumn("w", dsp.triangle(F.col("k").cast("double"), corner(0), corner(1), corner(2)))


@query(f"WITH {_corners(64, 400)} SELECT m, k, CAST(round(w * {E6}) AS BIGINT) AS w_e6 FROM bank")
def mel_filterbank(spark, sf_dir):
    return filterbank(spark, 64, 400).select("m", "k", scaled(F.col("w")).alias("w_e6"))


@query(f"WITH {_FRAMES}, {_POWER}, {_corners(6, 16)} SELECT vec_id, frame, m, CAST(round(log10(sum(w * e) + 1e-10) * 10000) AS BIGINT) AS mel_e4 FROM p JOIN bank b ON b.k = p.k GROUP BY ALL")
def log_mel(spark, sf_dir):
    """Six bands over nine bins: the bank is a constant, so that no join is needed."""
    import math

    top = 2595 * math.log10(1 + 8000 / 700)
    corner = [16 * 700 * (10 ** (top * i / 7 / 2595) - 1) / 16000 for i in range(8)]
    weight = lambda m, k: max(0.0, (k - corner[m]) / (corner[m + 1] - corner[m]) if corner[m] < k < corner[m + 1] else (corner[m + 2] - k) / (corner[m + 2] - corner[m + 1]) if corner[m + 1] <= k < corner[m + 2] else 0.0)
    power = shaped(spark, sf_dir).select("vec_id", "frame", dsp.power(F.col("h"), 16).alias("p"))
    bands = F.array(*[F.log10(dsp.dot(F.col("p"), F.array(*[F.lit(weight(m, k)) for k in range(9)])) + 1e-10) for m in range(6)])
    return power.select("vec_id", "frame", F.posexplode(bands).alias("m", "v")).select("vec_id", "frame", F.col("m").cast("long").alias("m"), scaled(F.col("v"), 10_000).alias("mel_e4"))


@query("""
WITH c AS (SELECT l_suppkey AS clip_id, CAST(sum(l_quantity) AS BIGINT) * 11 AS stop, count(*) * 12 AS epochs FROM lineitem GROUP BY ALL), g AS (SELECT *, unnest(range(epochs)) AS epoch FROM c)
SELECT clip_id, epoch, greatest(0, least(50, (stop + 159) // 160 - epoch * 50)) AS valid FROM g""")
def valid_hops(spark, sf_dir):
    clips = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("clip_id")).agg((F.sum("l_quantity").cast("long") * 11).alias("stop"), (F.count("*") * 12).alias("epochs"))
    g = clips.select("clip_id", "stop", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    return g.select("clip_id", "epoch", t.valid_hops(F.col("stop"), F.col("epoch"), 50).alias("valid"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, [8000, 16000, 44100, 48000][l_linenumber % 4 + 1] AS rate, CAST(l_quantity AS BIGINT) * 40 AS missing, CAST(l_quantity AS BIGINT) * 4800 + 9000 AS len FROM lineitem)
SELECT l_orderkey, l_linenumber, rate, missing, 25 * rate // 1000 AS tolerated,
  CASE WHEN missing = 0 THEN 'complete' WHEN missing <= 25 * rate // 1000 THEN 'padded' ELSE 'rejected' END AS verdict,
  CASE WHEN missing <= 25 * rate // 1000 THEN 800 + CASE WHEN missing = 0 THEN len * 16000 // rate ELSE (len - missing) * 16000 // rate END END AS available
FROM c""")
def tail_policy(spark, sf_dir):
    """Audio that ends early: padded within 25 ms, else rejected."""
    n = F.round("l_quantity").cast("long")
    c = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*[F.lit(r) for r in (8000, 16000, 44100, 48000)]), F.col("l_linenumber") % 4 + 1).alias("rate"), (n * 40).alias("missing"), (n * 4800 + 9000).alias("len"))
    tolerated = t.tolerated_samples(25, F.col("rate"))
    ok = F.col("missing") <= tolerated
    verdict = F.when(F.col("missing") == 0, "complete").when(ok, "padded").otherwise("rejected")
    return c.select("l_orderkey", "l_linenumber", "rate", "missing", tolerated.alias("tolerated"), verdict.alias("verdict"), F.when(ok, t.output_samples(F.col("len") - F.col("missing"), F.col("rate"), 800)).alias("available"))


@query("""
SELECT p_partkey, dst, dst * (p_size + 15) // 31 AS src, least((dst * (p_size + 15) // 31) // 2, (p_size + 16 + 1) // 2 - 1) AS chroma
FROM (SELECT p_partkey, p_size, unnest(range(32)) AS dst FROM part)""")
def resize_index(spark, sf_dir):
    """Rows of p_size + 16 columns to 32."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("dst"))
    size = F.col("p_size").cast("long") + 16
    src = dsp.nearest(F.col("dst"), 32, size)
    return rows.select("p_partkey", "dst", src.alias("src"), dsp.chroma(src, size).alias("chroma"))


@query(f"""
SELECT vec_id, y, x, CAST(round(CAST(embedding[(y * 7 // 4) * 8 + x * 7 // 4 + 1] AS DOUBLE) * {E6}) AS BIGINT) AS v_e6
FROM (SELECT *, unnest(range(5)) AS x FROM (SELECT *, unnest(range(5)) AS y FROM embeddings))""")
def resize_gather(spark, sf_dir):
    """Planes of 8 x 8 to 5 x 5: the places are literals."""
    places = [(y, x, (y * 7 // 4) * 8 + x * 7 // 4) for y in range(5) for x in range(5)]
    cells = F.array(*[F.struct(F.lit(y).cast("long").alias("y"), F.lit(x).cast("long").alias("x"), scaled(F.get("x", F.lit(k))).alias("v_e6")) for y, x, k in places])
    return signals(spark, sf_dir).select("vec_id", F.inline(cells))


_YUV = """
b AS (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS DOUBLE) AS y, CAST(l_suppkey * 7 % 256 AS DOUBLE) AS u, CAST(l_orderkey * 13 % 256 AS DOUBLE) AS v, l_linenumber % 2 = 0 AS bt709, l_linenumber % 4 >= 2 AS whole FROM lineitem
), k AS (
  SELECT *, CASE WHEN whole THEN y ELSE greatest(y - 16, 0e0) * (255e0 / 219) END AS c, CASE WHEN whole THEN 1e0 ELSE 255e0 / 224 END AS s, CASE WHEN bt709 THEN 0.2126e0 ELSE 0.299e0 END AS kr, CASE WHEN bt709 THEN 0.0722e0 ELSE 0.114e0 END AS kb FROM b
), rgb AS (
  SELECT *, greatest(0e0, least(255e0, c + (2 - 2 * kr) * (v - 128) * s)) AS r, greatest(0e0, least(255e0, c + (2 - 2 * kb) * (u - 128) * s)) AS bl,
    greatest(0e0, least(255e0, c - 2 * kb * (1 - kb) / (1 - kr - kb) * (u - 128) * s - 2 * kr * (1 - kr) / (1 - kr - kb) * (v - 128) * s)) AS g FROM k
)"""


@query(f"""
WITH {_YUV} SELECT l_orderkey, l_linenumber, CASE WHEN bt709 THEN 'BT.709' ELSE 'BT.601' END || CASE WHEN whole THEN ' full' ELSE ' limited' END AS matrix,
  CAST(round((r / 127.5e0 - 1) * 100000) AS BIGINT) AS r_e5, CAST(round((g / 127.5e0 - 1) * 100000) AS BIGINT) AS g_e5, CAST(round((bl / 127.5e0 - 1) * 100000) AS BIGINT) AS b_e5 FROM rgb""")
def yuv_to_rgb(spark, sf_dir):
    bt709, full = F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 4 >= 2
    byte = lambda c: (c % 256).cast("double")
    r, g, b = dsp.yuv_to_rgb(byte(F.col("l_partkey")), byte(F.col("l_suppkey") * 7), byte(F.col("l_orderkey") * 13), bt709, full)
    matrix = F.concat(F.when(bt709, "BT.709").otherwise("BT.601"), F.when(full, " full").otherwise(" limited"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", matrix.alias("matrix"), *[scaled(x / 127.5 - 1.0, 100_000).alias(n) for n, x in (("r_e5", r), ("g_e5", g), ("b_e5", b))])


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS finite, len(embedding) AS samples FROM embeddings")
def finite_guard(spark, sf_dir):
    x = F.col("x")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return signals(spark, sf_dir).select("vec_id", ok.alias("finite"), F.size(x).cast("long").alias("samples"))


@query(f"""
WITH d AS (SELECT label, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x - round(x * 100) / 100))) AS d FROM embeddings)
SELECT label, count(*) AS n, CAST(round(avg(d) * {E6}) AS BIGINT) AS mae_e6, CAST(round(max(d) * {E6}) AS BIGINT) AS most_e6, CAST(round(quantile_cont(d, 0.99) * {E6}) AS BIGINT) AS p99_e6, CAST(round(-10 * log10(avg(d * d)) * 1000) AS BIGINT) AS psnr_e3 FROM d GROUP BY label""")
def fidelity_metrics(spark, sf_dir):
    """Vectors against a copy rounded to two digits."""
    rows = read(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    d = rows.select("label", F.abs(F.col("x") - F.round(F.col("x") * 100) / 100).alias("d"))
    also = [F.count("*").alias("n"), scaled(F.avg("d")).alias("mae_e6"), scaled(F.max("d")).alias("most_e6"), scaled(F.log10(F.avg(F.col("d") * F.col("d"))) * -10, 1000).alias("psnr_e3")]
    return quantiles(d, ["label"], "d", {"p99": 0.99}, *also).withColumn("p99_e6", scaled(F.col("p99"))).drop("p99")


@query("""
SELECT vec_id, list_position(CAST(embedding AS DOUBLE[]), list_max(CAST(embedding AS DOUBLE[]))) - 1 AS peak, CAST(round(list_sum(CAST(embedding AS DOUBLE[])) / len(embedding) * 1000000) AS BIGINT) AS mean_e6 FROM embeddings""")
def peak_hop(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", (F.array_position("x", F.array_max("x")) - 1).cast("long").alias("peak"), scaled(dsp.channel_mean(F.col("x"))).alias("mean_e6"))
