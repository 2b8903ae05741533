"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
from epochgrid.llm import bpe, html_extract, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, topk_search, url_filter  # noqa: E402

CLASHING = ["row", "score", "kept", "_text", "_n", "_a", "_b", "own", "_lines", "_host", "quality", "words.and"]


@pytest.fixture(scope="module")
def documents(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    rows = [
        (None, None, None, None), (None, "some words without an id", "en", "src0"), (1, None, None, "src0"), (2, "", "en", "src0"), (3, "   \n \t\n", "en", "src1"), (4, long, "en", "src0"), (5, long + " tail", "en", "src0"),
        (6, "a b c", "en", "src1"), (6, "a b c", "en", "src1"), (7, "a b c", "de", "src2"), (8, "x" * 50_000, "en", "src0"), (9, "\x00 é 中 😀 <|endoftext|> #*$%&|<>", "en", None), (9, "another text under the same id, with words of its own", "en", None),
        *[(20 + i, f"line of the site\nown words number {i} and some more of them\nline of the site", "en", "src0") for i in range(12)],
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.withColumn(c, F.lit(7))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(20 + i, i % 2, 0) for i in range(12)] + [(4, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


def names(df):
    return sorted(df.columns)


def test_classifier(documents, labels):
    out = quality_classifier.classify(documents, labels)
    rows = out.collect()
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(rows) == documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out is not None for r in rows)
    assert quality_classifier.classify(empty(documents), labels).count() == 0
    assert {r.score for r in quality_classifier.classify(documents, empty(labels)).collect()} == {0.5}
    assert names(quality_classifier.keep_good(documents, labels)) == names(documents)
    assert quality_classifier.keep_good(documents, empty(labels)).count() == documents.count()


def test_rules(documents):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.judge(documents).collect()}
    assert rows[(1, 0)].base_failed and not rows[(1, 0)].kept and rows[(9, 6)].n_symbols == 12
    assert quality_rules.judge(documents).count() == documents.count() and quality_rules.judge(empty(documents)).count() == 0
    assert names(quality_rules.keep_good(documents)) == names(documents)


def test_line_dedup(documents):
    out = line_dedup.clean(documents)
    rows = {(r.doc_id, r.lang): r for r in out.collect()}
    assert names(out) == names(documents) and out.count() == documents.count()
    assert rows[(20, "en")].text == "own words number 0 and some more of them" and rows[(20, "en")].n_chars == len(rows[(20, "en")].text)
    assert rows[(None, None)].text is None and rows[(3, "en")].text == "   \n \t\n"
    assert line_dedup.clean(empty(documents)).count() == 0


def test_bpe(documents):
    rows = {r.doc_id: r for r in bpe.round_trip(documents).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and rows[1].ids_sha256 == rows[1].decoded_sha256 == rows[2].ids_sha256
    assert bpe.round_trip(documents).count() == documents.count() and bpe.round_trip(empty(documents)).count() == 0


def test_packing(documents):
    rows = packing.pack(documents).collect()
    sequences, tokens = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        tokens.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 6)
    assert next(r.length for r in rows if r.doc_id == 2) == 1
    assert packing.pack(empty(documents)).count() == 0


def test_near_dedup(documents):
    rows = [(r.doc_id, r._n, r._component) for r in near_dedup.groups(documents, 4).collect()]
    assert len(rows) == documents.count() and (1, 0, 1) in rows and (7, 1, 6) in rows and rows.count((6, 1, 6)) == 2
    assert {c for i, _, c in rows if i in (4, 5)} == {4}
    out = near_dedup.keep_one(documents)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert names(out) == names(documents)
    assert [i for i, t in kept].count(6) == 1 and not [1 for i, t in kept if i in (5, 7)] and [i for i, _ in kept].count(9) == 2
    assert (1, None) in kept and (2, "") in kept and (None, None) in kept and (None, "some words without an id") in kept
    assert near_dedup.groups(empty(documents), 4).count() == 0 and near_dedup.keep_one(empty(documents)).count() == 0


def test_near_copies_keep_their_body(spark):
    """Stages 3 and 4 leave one document of a large group with its body."""
    body = [" ".join(f"body{i}word{j}" for j in range(20)) for i in range(6)]
    copies = [(i, "\n".join(["the header", *body[: i % 6], body[i % 6].replace(f"word{i % 20} ", f"other{i} "), *body[i % 6 + 1 :], "the footer"])) for i in range(60)]
    others = [(100 + i, "\n".join(["the header", *(" ".join(f"text{i}x{k}y{j}" for j in range(9)) for k in range(3)), "the footer"])) for i in range(60)]
    df = spark.createDataFrame([(i, t, "s") for i, t in copies + others], "doc_id long, text string, source string")
    out = line_dedup.clean(df)
    got = {r.doc_id: r.text.split("\n") for r in out.collect()}
    assert all("the header" not in t and "the footer" not in t for t in got.values())
    assert all(len(got[i]) == 6 for i, _ in copies) and all(len(got[i]) == 3 for i, _ in others)
    left = [r for r in near_dedup.keep_one(out).collect() if r.doc_id < 100]
    assert len(left) == 1 and len(left[0].text.split("\n")) == 6


def test_templates_inside_articles_and_on_large_hosts(spark):
    """A plain notice inside every article goes, a shared passage stays; a block on 150 of 2,000 pages goes."""
    shared = lambda i: "<p>Shared passage</p>" if i % 4 == 0 else ""
    rows = [(i, f"http://a.com/{i}", f"<article><p>Story {i}</p>{shared(i)}<p>Join our letter</p><ul><li>One offer<li>Two</ul></article>") for i in range(40)]
    rows += [(100 + i, f"http://big.com/{i}", f"<div><p>Text {i}</p></div>" + ("<div>Summer sale</div>" if i < 150 else "")) for i in range(2000)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "Story 4\nShared passage" and got[5] == "Story 5" and got[107] == "Text 7" and got[2000] == "Text 1900"


@pytest.mark.parametrize("late", ["class='ad-banner'", "hidden", "role=navigation", "aria-hidden=true"])
def test_attributes_behind_a_long_one(late):
    long = f"data-state='{'x' * 5000}' style='{'color: red; ' * 300}'"
    assert html_extract.extract(html_extract.parse(f"<p>text<div {long} {late}>advert</div>")) == "text"
    assert html_extract.extract(html_extract.parse(f"<div>aside</div><div {long} itemprop=articleBody><p>text</div>")) == "text"


def test_url_statistics_cover_all(spark):
    """Suffixes outside the sample count, and a URL that fills the table does not fill the sample."""
    urls = [(f"http://h{i}.com/en/{i}", f"h{i}.com", f"/en/{i}", i % 2 == 0, i % 5) for i in range(300)]
    labelled = spark.createDataFrame(urls, "url string, host string, path string, blocked boolean, fold int")
    table = url_filter.statistics(labelled)
    want = Counter(k for _, h, p, *_ in urls for k in ("1 com", f"2 {h}", f"3 {h}", "p en", "s com en", f"d {h} {p[:5]}".replace(" /", "/")))
    assert {r.key: r.n for r in table.collect()} == dict(want)
    got = url_filter.with_counts(labelled, table).collect()
    assert all(r.counts[0] == 300 and r.counts[1] == 150 and r.counts[4] == 1 and r.counts[5] == r.blocked for r in got)
    pages = [(0, "http://a.com/en/1")] * 11_000 + [(i, f"http://{'b' if i % 2 else 'c'}{i}.{'com/en' if i % 2 else 'net/de'}/{i}") for i in range(1, 400)] + [(1000 + i, f"http://x{i}.{'com' if i % 2 else 'net'}/it/{i}") for i in range(100)]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string")).where("page_id >= 1000").collect()
    assert len(rows) == 100 and {(r.page_id % 2, r.verdict) for r in rows} == {(1, "block"), (0, "allow")}


@pytest.mark.parametrize("size, times, words", [(5, 40, 1000), (8, 8, 480), (12, 2, 250), (400, 2, 2000)])
def test_repeated_passages(size, times, words):
    """A passage of size words, in other company each time, in a text of so many words that the base rules let through."""
    passages = [[f"p{j:03}{k:03}" for k in range(size)] for j in range(max(1, times // 8))]
    new = iter(f"new{i:04}" for i in range(words))
    out = []
    for t in range(times):
        out += [*passages[t % len(passages)], next(new)]
    out += [next(new) for _ in range(words - len(out))]
    m = quality_rules.measure([" ".join(out)])
    base_failed, kept = quality_rules.verdicts(m)
    over = [n for n, most in quality_rules.MAX_PASSAGES.items() if m[f"passage_chars_{n}"][0] > most * m["body_chars"][0]]
    assert not base_failed[0] and not kept[0]
    assert over == {5: [5], 8: [8], 12: [12]}.get(size, [5, 8, 12])


def test_a_doubled_header_is_no_passage():
    header, body = " ".join(f"h{i}" for i in range(12)), " ".join(f"body{i}" for i in range(38))
    block, rest = "\n".join(f"one line of block {i}" for i in range(80)), "\n".join(f"x{i} y{i} z{i} rest{i}" for i in range(300))
    texts = [f"{header}\n{body}\n{header}", f"{body} {header} and {header}", f"{block}\n{rest}\n{block}"]
    m = quality_rules.measure(texts)
    base_failed, kept = quality_rules.verdicts(m)
    assert kept.tolist() == [True, False, False] and not base_failed.any()


def test_licenses(spark, documents):
    assert license_scan.licenses(documents).count() == documents.count() and license_scan.licenses(empty(documents)).count() == 0
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, None), (3, ""), (4, "all RIGHTS reserved")], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in license_scan.licenses(df).collect()} == {1: ["MIT"], 2: [], 3: [], 4: ["reserved"]}


def test_licenses_of_many_kinds():
    known = license_scan.Templates(license_scan.TEMPLATES)
    names = lambda t: sorted({known.names[i] for i, *_ in license_scan.scan([t], known)[0]})
    assert names("a b c This work is licensed under the GNU Lesser General Public License, version 2.1 d e f") == ["LGPL-2.1"]
    assert names("a b c This work is provided under the GNU General Public License, version 3 d e f") == ["GPL-3.0"]
    assert names("Distributed under the MIT License") == names("It is released under MIT License.") == ["MIT"]
    assert names("Licensed under CC BY-SA 4.0") == ["CC-BY-SA-4.0"] and names("Use is under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert not names("Released under the BSD License") and not names("some rights reserved")
    assert "GPL-3.0" not in names("This work is licensed under the GNU Lesser General Public License, version 3")
    body = license_scan.TEMPLATES["GPL-3.0-text"].split()
    assert "GPL-3.0-text" in names(" ".join(["so"] * 50 + body[:2000] + ["changed"] + body[2001:-500]))
    for name in ("MPL-2.0-text", "ISC-grant", "Unlicense-text", "BSD-disclaimer", "AGPL-grant", "EPL-2.0", "CC0-1.0-text"):
        assert name in names("before it " * 9 + license_scan.TEMPLATES[name] + " behind it" * 9), name


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, None, None), (None, "no scheme", "<p>x"), (2, "http://A.Example.COM", ""), (2, "http://A.Example.COM", ""), (3, "x://h/en/7?q=1#f", "<div>" * 3000 + "deep"), (4, "https://Q.net/de/8", "plain & text"), (5, "https://com/en/", "<article><p>a<script>b</script></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ["host", "hash", "hashes", "templates", "text", "rule", "verdict", "score"]:
        df = df.withColumn(c, F.lit(7))
    return df


def test_pages(pages):
    rows = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()]
    assert sorted(rows, key=str) == sorted([(1, "", 0), (None, "x", 1), (2, "", 0), (2, "", 0), (3, "deep", 4), (4, "plain & text", 12), (5, "a", 1)], key=str)
    assert html_extract.extract_pages(empty(pages)).count() == 0
    judged = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert (judged[1].host, judged[1].path, judged[None].host) == ("", "", "") and judged[2].host == "a.example.com"
    assert judged[4].rule == "net/de/" and judged[4].verdict == "allow" and judged[5].rule == "com/en/" and judged[5].verdict == "block" and judged[3].path == "/en/7"
    assert url_filter.judge(pages).count() == pages.count() and url_filter.judge(empty(pages)).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (None, [1.0, 1.0]), (20, [1.0]), (40, []), (7, [3.0e30, 3.0e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("id", F.lit(1))
    got = topk_search.top_k(df, k=3).collect()
    best = {}
    for r in got:
        best.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(best) == [0, 20, 40]
    assert sorted(best[0])[:2] == [(1, 7, 2**63 - 1)] * 2 and len(best[0]) == 6
    assert sorted(best[40]) == [(1, 0, 0), (2, 0, 0), (3, 5, 0)]
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_every_stage(spark, documents, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out, none = stage(spark, documents, str(tmp_path)), stage(spark, empty(documents), str(tmp_path))
        assert none.count() == 0, name
        if k + 1 < len(pipeline.STAGES):
            assert names(out) == names(documents), name
        out.write.parquet(f"{tmp_path}/{name}")
