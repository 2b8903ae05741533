"""Closed-form vectors and edge cases of the operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochgrid.functions import timeline as t
from epochgrid.operators import align, chunks, planning, selection, skip
from epochgrid.operators.compare import ordered_digests
from epochgrid.operators.quantiles import quantiles
from epochgrid.plans import planning_queries
from epochgrid.sources.convert import choose


def brute_choose(times, window, total):
    """For each epoch, walk on while it lies behind the middle to the next picture."""
    out = []
    for e in range(total):
        i = 0
        while i + 1 < len(times) and e * window > times[i] + (times[i + 1] - times[i]) // 2:
            i += 1
        out.append(times[i])
    return out


CASES = ([0], [0, 1000, 2000], [0, 0, 33, 500, 501], [80, 117, 401, 1200, 1337])


@pytest.mark.parametrize("times", CASES)
@pytest.mark.parametrize("window", [50, 330, 500, 1000])
def test_choose(times, window):
    got = [p for p, a, b in choose(times, window, 80) for _ in range(b - a)]
    assert got == brute_choose(times, window, 80)


def test_thirty_frames_a_second():
    chosen = choose([round(i * 1000 / 30) for i in range(9900)], 500, 660)
    assert len(chosen) == 660 and sum(b - a for _, a, b in chosen) == 660


def track(spark, clips):
    rows = [(c, d, p) for c, times in clips.items() for d, p in enumerate(times)]
    return spark.createDataFrame(rows, "clip_id string, dec_idx long, pts long")


@pytest.mark.parametrize("window", [50, 500])
def test_select_epochs(spark, window):
    df = track(spark, {str(i): times for i, times in enumerate(CASES)}).withColumns({"total": F.lit(80).cast("long"), "window_ms": F.lit(window).cast("long")})
    got = {(r.clip_id, r.epoch): r.pts for r in selection.select_epochs(df).collect()}
    assert got == {(str(i), e): p for i, times in enumerate(CASES) for e, p in enumerate(brute_choose(times, window, 80))}


def test_partitions_do_not_matter(spark):
    r = random.Random(1)
    df = track(spark, {str(c): sorted(r.randrange(5000) for _ in range(40)) for c in range(9)}).withColumns({"total": F.lit(30).cast("long"), "window_ms": F.lit(200).cast("long")})
    results = [sorted(map(tuple, selection.select_epochs(df.repartition(n)).select("clip_id", "epoch", "pts").collect())) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize(
    ("times", "idr", "target", "want"),
    [
        ([0, 300, 100, 200, 400, 700, 500, 600], {0, 4}, 0, [(0, 4), (4, 8)]),
        ([0, 300, 100, 200, 400, 700, 500, 600], {0, 4}, 10_000, [(0, 8)]),
        ([0, 300, 100, 450, 400, 700, 500, 600], {0, 4}, 0, [(0, 8)]),
        ([0, 300, 100, 200, 400, 700, 500, 600], set(), 0, [(0, 8)]),
    ],
)
def test_chunk_plan(spark, times, idr, target, want):
    df = track(spark, {"a": times}).withColumn("is_sync", F.col("dec_idx").isin(list(idr)) if idr else F.lit(False))
    got = sorted((r.dec_lo, r.dec_hi) for r in chunks.plan_chunks(df, target).collect())
    assert got == want


def test_assign_to_chunks(spark):
    df = track(spark, {"a": list(range(10))})
    plan = spark.createDataFrame([("a", 0, 0, 4), ("a", 1, 4, 10)], "clip_id string, chunk_id long, dec_lo long, dec_hi long")
    got = {r.dec_idx: r.chunk_id for r in chunks.assign_to_chunks(df, plan).collect()}
    assert got == {i: int(i >= 4) for i in range(10)}


def test_reorder(spark):
    groups = [p for g in range(50) for p in (g * 4, g * 4 + 3, g * 4 + 1, g * 4 + 2)]
    late = [*range(1, 71), 0]
    got = {r.clip_id: r.n_late for r in chunks.reorder_violations(track(spark, {"ok": groups, "late": late})).collect()}
    assert got == {"ok": 0, "late": 1}


def test_reorder_of_a_long_clip(spark):
    n = chunks.MAX_SAMPLES + 1000
    pts = F.when(F.col("id") % 1000 == 999, F.col("id") - 500).otherwise(F.col("id"))
    long = spark.range(n).select(F.lit("long").alias("clip_id"), F.col("id").alias("dec_idx"), pts.alias("pts"))
    short = track(spark, {"short": [*range(1, 71), 0]})
    got = {r.clip_id: r.n_late for r in chunks.reorder_violations(long.unionByName(short)).collect()}
    assert got == {"long": n // 1000, "short": 1}


def test_track_check_sees_all_lines(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect()
    want = {}
    for r in lines:
        n = want.setdefault(r.l_orderkey, [0, 0])
        if r.l_linenumber % 3 < 2:
            n[r.l_linenumber % 3 == 0] += 1
    got = {r.clip_id: [r.n_audio, r.n_video] for r in planning_queries.track_check(spark, sf_dir).collect()}
    assert got == want


def test_skip_and_reconcile(spark):
    df = track(spark, {"a": [0, 10, 20, 30]}).withColumn("disposable", F.col("dec_idx").isin(1, 2))
    chosen = spark.createDataFrame([("a", 20)], "clip_id string, pts long")
    assert sorted(r.dec_idx for r in skip.decodable(df, chosen).collect()) == [0, 2, 3]
    met = skip.reconcile(df, df.where("pts <> 10"))
    assert sorted((r.i, r.expected_pts, r.decoded_pts) for r in met.collect()) == [(1, 0, 0), (2, 10, 20), (3, 20, 30), (4, 30, None)]


def test_drop_leading(spark):
    df = track(spark, {"a": [5, 1, 2, 6, 4]}).withColumn("is_rasl", F.col("dec_idx").isin(1, 2, 4))
    assert sorted(r.dec_idx for r in skip.drop_leading(df).collect()) == [0, 3, 4]


def test_merge_fills(spark):
    clips = spark.createDataFrame([("a", 3, 500)], "clip_id string, total long, window_ms long")
    video = spark.createDataFrame([("a", 1, 480)], "clip_id string, epoch long, pts long")
    audio = spark.createDataFrame([("a", 0, 1.5)], "clip_id string, epoch long, mel double")
    got = sorted((r.epoch, r.timestamp_ms, r.pts, r.mel) for r in align.merge(align.grid(clips), video, audio, {"pts": -1, "mel": align.SILENCE}).collect())
    assert got == [(0, 0, -1, 1.5), (1, 500, 480, -10.0), (2, 1000, -1, -10.0)]


def test_jobs_and_workers(spark):
    cases = [(f, c, j, w, m) for f in (1, 3, 16) for c in (1, 4, 16) for j in (None, 2) for w in (None, 4) for m in (None, 200, 1000)]
    df = spark.createDataFrame(cases, "files long, cores long, jobs long, workers long, rss long")
    jobs, workers = planning.jobs_and_workers_columns(*[F.col(c) for c in df.columns])
    for r in df.select("*", jobs.alias("j"), workers.alias("w")).collect():
        assert (r.j, r.w) == planning.jobs_and_workers(r.files, r.cores, r.jobs, r.workers, r.rss)
    assert planning.jobs_and_workers(16, 16) == (16, 1)


def test_valid_hops(spark):
    got = spark.range(5).select(t.valid_hops(F.lit(11680), F.col("id"), 50).alias("v")).collect()
    assert [r.v for r in got] == [50, 23, 0, 0, 0]


def test_planning_cap():
    assert chunks.MAX_SAMPLES * 192 <= 32 << 20 < (chunks.MAX_SAMPLES + 1) * 192


def test_epoch_select_shuffles_once(spark, sf_dir):
    """Both windows of the selection share one exchange by clip; nothing is joined by range."""
    from epochgrid.plans.registry import gridded, track

    plan = selection.select_epochs(gridded(track(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


POINTS = {"least": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "most": 1.0}


def test_quantiles_of_any_group(spark):
    """Against numpy: a hot group, heavy tails, ties, few values, none, a null key and a clashing name."""
    rng = np.random.default_rng(5)
    groups = {1: rng.standard_cauchy(30_000), 2: np.repeat([1.0, 2.0, 2.0, 9.0], 700), 3: np.array([4.0]), 4: np.array([4.0, 5.0]), None: rng.random(50), 6: np.exp(rng.normal(0, 9, 5000))}
    rows = [(k, float(v), "x") for k, vs in groups.items() for v in vs] + [(5, None, "x"), (1, None, "x")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v double, label string").repartition(13)
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", POINTS, F.count("*").alias("n"), F.max("label").alias("label")).collect()}
    assert set(got) == {*groups, 5}
    for k, vs in groups.items():
        assert [got[k][p] for p in POINTS] == pytest.approx([np.quantile(vs, q) for q in POINTS.values()], rel=1e-12)
    assert got[1]["n"] == 30_001 and got[5]["n"] == 1 and all(got[5][p] is None for p in POINTS)
    assert quantiles(df.limit(0), ["k"], "v", POINTS).count() == 0


def test_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch):
    """Bounds that miss the rank are opened."""
    from epochgrid.operators import quantiles as module

    wrong = lambda c, ends, accuracy: F.array(*[F.lit(1e9 if i % 4 < 2 else -1e9) for i in range(len(ends))])
    monkeypatch.setattr(module.F, "percentile_approx", wrong)
    vs = [float(v) for v in range(1000)]
    got = quantiles(spark.createDataFrame([(1, v) for v in vs], "k int, v double"), ["k"], "v", POINTS).first()
    assert [got[p] for p in POINTS] == pytest.approx([np.quantile(vs, q) for q in POINTS.values()])


def test_quantiles_do_not_gather_a_group(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = quantiles(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_" not in plan and "NestedLoop" not in plan


def test_ordered_digests(spark):
    """Over several batches, with nulls, and whatever the partitions."""
    rows = [(k, i, None if i % 7 == 0 else f"v{i}", None) for k in (1, 2, None) for i in range(25_000 if k == 1 else 5)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, v string, none string")
    got = {r["k"]: r for r in ordered_digests(df.repartition(5), "k", ["i"], {"a": "v", "b": "i", "c": "none"}).collect()}
    assert set(got) == {1, 2, None}
    for k, r in got.items():
        n = 25_000 if k == 1 else 5
        digest = lambda xs: hashlib.sha256(",".join(xs).encode()).hexdigest()
        assert (r["rows"], r["a"], r["b"], r["c"]) == (n, digest([f"v{i}" for i in range(n) if i % 7]), digest([str(i) for i in range(n)]), digest([]))
    assert ordered_digests(df.limit(0), "k", ["i"], {"a": "v"}).count() == 0
