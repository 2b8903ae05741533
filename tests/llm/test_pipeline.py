"""Each stage against a brute-force version, on what the stage before it kept."""

from collections import Counter, defaultdict

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
import __spark_entry__ as entry  # noqa: E402
from epochgrid.llm import line_dedup, quality_classifier  # noqa: E402

from .test_brute import BIG, brute_components, brute_rules  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{BIG}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in pipeline.STAGES:
        out.append(docs)
        path = f"{folder}/{name}"
        stage(spark, docs, BIG).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def table(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_stages(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "near_dedup", "packing"]
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[:-1])


def test_classifier_stage(spark, stages):
    good = {r.doc_id for r in quality_classifier.classify(stages[0], spark.read.parquet(f"{BIG}/labels.parquet")).where("predicted = 1").collect()}
    assert table(stages[1]) == [r for r in table(stages[0]) if r[0] in good]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert sum(1 for i in good if labels.get(i) == 0) <= 2 and sum(1 for i, q in labels.items() if q == 1 and i not in good) <= 2


def test_rules_stage(stages):
    assert table(stages[2]) == [r for r in table(stages[1]) if brute_rules(r[1] or "")[-1]]


def test_lines_stage(stages):
    pages, holds = Counter(), defaultdict(Counter)
    for source, text in {(r[3], r[1]) for r in table(stages[2])}:
        pages[source] += 1
        holds[source].update({line for line in text.split("\n") if line.strip(" ")})
    want = []
    for i, text, lang, source, n in table(stages[2]):
        lines = [x for x in text.split("\n") if not (holds[source][x] >= line_dedup.MIN_PAGES and 100 * holds[source][x] > line_dedup.BOILERPLATE_PERCENT * pages[source])]
        new = "\n".join(lines)
        want.append((i, new, lang, source, len(new) if new != text else n))
    assert table(stages[3]) == sorted(want)


def test_dedup_stage(stages):
    before = table(stages[3])
    found = brute_components({i: t for i, t, *_ in before}, 5)
    assert table(stages[4]) == [r for r in before if found[r[0]][1] == r[0]]


def test_packing_stage(spark, stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == {r[0] for r in table(stages[4])}
    used = Counter()
    for r in rows:
        used[r.doc_id] += r.length
    assert all(used[r.doc_id] == r.doc_tokens for r in rows)


def test_registered(spark, stages):
    got = entry.queries()["pipeline"](spark, BIG)
    assert sorted(map(tuple, got.select("doc_id", "start", "length", "ids_crc32").collect()))[:5] and got.select("doc_id").distinct().count() == stages[4].count()
    assert pipeline.ORACLE_SQL is None
