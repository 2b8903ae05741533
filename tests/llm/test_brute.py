"""Each operator against a brute-force version, an exact round trip or held-out accuracy, over whole small tables."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epochgrid.llm import bpe, html_extract, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, queries, topk_search, url_filter
from epochgrid.llm.text import Block, blocks, rolling_hashes, span_hashes, window_hashes

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name, sf_dir=BIG):
    return queries.QUERIES[name](spark, sf_dir).collect()


# --- hashing ----------------------------------------------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    r = random.Random(1)
    words = list({"".join(r.choice("abcAB é") for _ in range(r.randrange(1, 9))).strip().replace(" ", "x") or "q" for _ in range(5000)})
    block = Block([" ".join(words), words[0]])
    starts, ends = block.words()
    h = span_hashes(block.data, starts, ends)
    assert len(set(h[: len(words)].tolist())) == len(words) and h[-1] == h[0]
    assert len(window_hashes(h[:3], 5)) == 0
    assert [(a, len(t)) for a, t in blocks([None, "x" * 300_000, "y"])] == [(0, 2), (2, 1)]


def test_long_text_hashes_in_slices():
    text = "ab " * 400_000 + "z" * 700_000
    block = Block([text])
    starts, ends = block.words()
    h = span_hashes(block.data, starts, ends)
    assert len(set(h[:-1].tolist())) == 1 and len(h) == 400_001


@pytest.mark.parametrize("size", [1, 3, 12])
def test_rolling_hashes_tell_windows_apart(size):
    """Equal for equal windows only, wherever they stand; also beyond one slice, and the wrapped way round."""
    r = np.random.default_rng(3)
    kinds = r.integers(0, 2**64, 3, dtype=np.uint64)
    of = r.integers(0, 3, 150_000)
    h = rolling_hashes(kinds[of], size)
    code = np.zeros(len(of) - size + 1, dtype=np.int64)
    for k in range(size):
        code = code * 3 + of[k : len(of) - size + 1 + k]
    assert len(h) == len(code)
    assert len(set(zip(h.tolist(), code.tolist(), strict=True))) == len(np.unique(code)) == len(np.unique(h))
    assert (rolling_hashes(kinds[of][70_000:70_050], size) == h[70_000 : 70_051 - size]).all()
    assert len(rolling_hashes(kinds[:0], size)) == 0 and len(rolling_hashes(kinds[of][: size - 1], size)) == 0


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, texts):
    rows = run(spark, "op1_quality_classifier")
    assert {r.doc_id for r in rows} == set(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) > 0.95


def brute_ftrl(rows, size, epochs, alpha, beta, l1, l2):
    """Coordinate by coordinate, each with its own sums; coordinate ``size`` is the bias, which every row has."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for index, value, label in rows:
            x = defaultdict(float)
            for i, v in [*zip(index, value, strict=True), (size, 1.0)]:
                x[i] += v
            w = {i: weight(i) for i in x}
            error = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - label
            for i in x:
                g = error * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


@pytest.mark.parametrize("l1", [0.0, 0.02, 0.5])
def test_training_follows_the_regularised_leader(l1):
    """Against sums kept one by one, with features that stand twice in a row; and l1 leaves weights at zero."""
    r = np.random.default_rng(4)
    rows = [(r.integers(0, 30, 8), r.random(8), int(r.random() < 0.4)) for _ in range(120)]
    rows.append((np.empty(0, np.int64), np.empty(0), 1))
    got = quality_classifier.ftrl(rows, 40, epochs=3, alpha=0.7, beta=0.3, l1=l1, l2=0.05)
    want = brute_ftrl(rows, 40, 3, 0.7, 0.3, l1, 0.05)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert (got[30:40] == 0).all() and (got[:30] != 0).any() and (l1 < 0.5 or (got[:30] == 0).any())


def test_training_settles_where_the_loss_does():
    """Without l1, many passes over separable rows put each on its side."""
    rows = [(np.array([k]), np.array([1.0]), k % 2) for k in range(10)]
    w = quality_classifier.ftrl(rows, 10, epochs=50, l1=0.0)
    assert all((w[k] + w[10] > 0) == bool(k % 2) for k in range(10))


def test_scores_are_sparse_dot_products():
    r = np.random.default_rng(1)
    w = r.normal(size=1 << quality_classifier.BITS)
    sample = ["a b a b!!", "", "x", "same same same | y", "é " * 50]
    for got, (index, value) in zip(quality_classifier.dots(sample, w), quality_classifier.vectors(sample), strict=True):
        assert abs(got - w[index] @ value) < 1e-9


def test_a_score_does_not_depend_on_its_neighbours(texts):
    w = np.random.default_rng(2).normal(size=1 << quality_classifier.BITS)
    some = list(texts.values())[:300]
    assert quality_classifier.dots(some, w).tolist() == [quality_classifier.dots([t], w)[0] for t in some]


def test_classifier_never_sees_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality_classifier.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


# --- 2 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["plain", "ties", "clusters", "large"])
def test_search_is_exact(spark, kind):
    r = np.random.default_rng(3)
    n, dim = 900, 8
    x = {"plain": r.normal(size=(n, dim)), "ties": r.integers(-1, 2, size=(n, dim)) / 64, "clusters": r.normal(size=(9, dim))[r.integers(0, 9, n)] + 0.02 * r.normal(size=(n, dim)), "large": r.normal(size=(n, dim)) * 1e12}[kind]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    z = [[int(c) for c in np.floor(64 * v)] for v in x]
    got = defaultdict(list)
    for row in topk_search.top_k(df, k=7, shard=200).collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    assert set(got) == set(range(0, n, 20))
    for q, found in got.items():
        want = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(z[q], z[i], strict=True)))), i) for i in range(n) if i != q))[:7]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_more_shards_than_tasks(spark):
    """Shards stay apart when there are more of them than an input of this size has tasks."""
    r = np.random.default_rng(8)
    x = np.floor(64 * r.normal(size=(300, 4))) / 64
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(q.query_id, q.rank): q.score for q in topk_search.top_k(df, k=2, shard=5).collect()}
    for q in range(0, 300, 20):
        scores = sorted((int(64 * 64 * (x[q] @ x[i])) for i in range(300) if i != q), reverse=True)
        assert [got[(q, 1)], got[(q, 2)]] == scores[:2]


def test_whole_numbers_prune_too():
    """Products beyond a double: boxes and kth scores still leave most leaves out, and scores are exact."""
    r = np.random.default_rng(6)
    x = np.floor((r.normal(size=(6, 5))[r.integers(0, 6, 600)] * 100 + r.normal(size=(600, 5))) * 1e6)
    t = topk_search.Tree.build(np.arange(600), x, leaf=20)
    q, rows, s = t.search(t.vectors[:8], 3, np.full(8, topk_search.NO_SCORE))
    assert len(q) < 8 * 300
    z = [[int(c) for c in v] for v in t.vectors]
    for i in range(8):
        every = sorted((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(z[i], v, strict=True)))) for v in z), reverse=True)
        assert sorted(s[q == i].tolist(), reverse=True)[:3] == every[:3]


def test_later_shards_answer_less(spark):
    """With the kth score of all shards before, answers stay below a k for each query and shard."""
    r = np.random.default_rng(12)
    x = r.integers(-500, 500, size=(4000, 6)) / 64
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    known = {}
    for s in range(20):  # the shards one after another, as the rounds do with groups of them
        t = topk_search.Tree.build(np.arange(200 * s, 200 * s + 200), np.floor(64 * x[200 * s : 200 * s + 200]), leaf=16)
        hits = topk_search._cut(*t.search(np.floor(64 * x[:50]), 10, np.array([known.get(i, [topk_search.NO_SCORE])[-1] for i in range(50)])), t.ids, 10)
        for i in range(50):
            known[i] = sorted([*known.get(i, []), *hits[2][hits[0] == i].tolist()], reverse=True)[:10]
        if s == 19:
            assert len(hits[0]) < 50 * 3
    got = topk_search.top_k(df, k=10, shard=200).where("query_id < 50").collect()
    z = np.floor(64 * x)
    for q in (0, 20, 40):
        scores = z @ z[q]
        want = sorted(((-int(v), i) for i, v in enumerate(scores) if i != q))[:10]
        assert sorted((-a.score, a.vec_id) for a in got if a.query_id == q) == want


def test_boxes_are_tight_and_prune():
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(8, 16))[r.integers(0, 8, 4000)] * 640 + r.normal(size=(4000, 16)) * 8)
    t = topk_search.Tree.build(np.arange(4000), x, leaf=64)
    first = (1 << t.depth) - 1
    for i, (a, b) in enumerate(zip(t.cuts[:-1], t.cuts[1:], strict=True)):
        assert (t.lows[first + i] == t.vectors[a:b].min(axis=0)).all() and (t.highs[first + i] == t.vectors[a:b].max(axis=0)).all()
    q, _, _ = t.search(t.vectors[:50], 5, np.full(50, topk_search.NO_SCORE))
    assert len(q) < 50 * 1500


# --- 3 and 4 ----------------------------------------------------------------------------------------------------------


def article(source):
    """The text of the test pages, by their known form."""
    body = source[source.index("<article>") + 9 :].split("</article>")[0].split("<footer")[0]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*$", "", re.sub(r"<[^>]*>", " ", p))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_articles(spark):
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{BIG}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in run(spark, "op3_html_extraction")}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_templates_without_markers(spark):
    """No tag or class gives the site's parts away: only their return on many pages of the host does."""
    body = "<div><p>Home of all things</p></div><div><p>Story {i} begins</p><p>Shared words</p></div><div>Imprint of the site</div>"
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.com/{i}", body.format(i=i)) for i in range(20)] + [(99, "http://alone.com/", body.format(i=99))]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 begins" and got[99] == "Home of all things\nStory 99 begins\nShared words\nImprint of the site"


def words_of(text):
    return Counter(text.split())


def test_template_step_alone(spark, monkeypatch):
    """Without the lists of tags, classes and roles, and without regard to article elements: what the templates take away."""
    monkeypatch.setattr(html_extract, "_judge", lambda tag, attributes, inside: (2 if tag in ("script", "style", "head", "title") else 0, False, ""))
    monkeypatch.setattr(html_extract, "LONG", 1 << 60)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    host = lambda r: re.sub(r"^[^:]*://", "", r.url or "").split("/")[0]
    of, count = Counter(map(host, pages)), Counter()
    trees = {r.page_id: html_extract.parse(r.html) for r in pages}
    for r in pages:
        count.update((host(r), h) for h in {h for own in html_extract.subtree_hashes(trees[r.page_id]).values() for h in own})
    least = lambda h, n: max(html_extract.MIN_PAGES, min(html_extract.PLAIN_SHARE * n, html_extract.PLAIN_MANY) if h & 1 else min(html_extract.MIN_SHARE * n, html_extract.MANY_PAGES))
    found = defaultdict(set)
    for (name, h), n in count.items():
        if n >= least(h, of[name]):
            found[name].add(h)
    right, kept_words, article_words, before, after = 0, 0, 0, 0, 0
    for r in pages:
        want = words_of(article(r.html))
        plain, cut = (words_of(html_extract.extract(trees[r.page_id], t)) for t in (frozenset(), frozenset(found[host(r)])))
        right += sum((cut & want).values())
        kept_words += sum(cut.values())
        article_words += sum(want.values())
        before += sum((plain - want).values())
        after += sum((cut - want).values())
    print(f"precision {right / kept_words:.4f}, recall {right / article_words:.4f}; words outside of articles {before} before, {after} after")
    assert right >= 0.99 * article_words and after < 0.5 * before


def test_menus_with_other_links_recur(spark):
    page = "<div class=x><ul>{menu}</ul></div><div><p>Story {i} of many words</p><p><a href=/>link</a> and text around it</p></div><footer><span>Seen {i} times</span></footer>"
    menu = lambda i: "".join(f"<li><a href=/{i}{k}>go {i * k}</a>" for k in range(2 + i % 5))
    rows = [(i, "http://a.com/", page.format(menu=menu(i), i=i)) for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} of many words" for i in range(20)}


@pytest.mark.parametrize("kind", ["<b>{}</i>", "<i><div><b>{}</i>", "<p>{}</p>", "<li>{}<td>", "<ul><li>{}</b>", "<table>{}</td>"])
def test_parsing_is_linear_on_unbalanced_tags(kind):
    import time

    def took(n):
        start, end = kind.split("{}")
        source = start * n + "x" + end * n
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            html_extract.extract(html_extract.parse(source))
            best = min(best, time.perf_counter() - began)
        return best

    assert took(16_000) < 20 * max(took(2_000), 0.005)


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body class="page"><div id=masthead>Site</div><NAV><ul><li>Home</ul></NAV><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><main><header><h1>The &lt;Title&gt;</h1></header><p>One&nbsp;two\n  three<p>Four <i>fi</i>ve<script>"</p>"</script><div class="ad-banner">Buy</div><ul><li>x<li>y</ul><form>Mail <input></form><section class="comments"><p>First!</p></section></main><footer>&copy;"""


def test_noise():
    assert html_extract.extract(html_extract.parse(PAGE)) == "The <Title>\nOne two three\nFour five\nx\ny"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<form id=aspnet><div class='page has-sidebar'><div class=sidebar-layout><article><div class=entry-header><h1>T</h1></div><p>x</p></article></div></div></form>", "T\nx"),
        ("<article><p>x</p></article><section id=comments><article class=comment><p>y</p></article></section>", "x"),
        ("<div class=no-sidebar><p>x</p><div id=sidebar><p>y</p></div></div>", "x"),
        ("<div role=main><p>x</p></div><div>y</div>", "x"),
        ("<div class=header>s</div><p>x<div class=related>z</div>", "x"),
        ("<p hidden>n<p>x<p style='display: none'>m", "x"),
        ("<!-- a <p>b</p> --><p>x &lt;b&gt; &#233;&amp;amp; a<b>b</b>c<br>d</P>", "x <b> é&amp; abc d"),
        ("<article>a<p>b</p>c</article>", "a\nb\nc"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<textarea><p>t</p></textarea><p>x<select><option>o</select> y", "x y"),
    ],
)
def test_forms_of_pages(source, want):
    assert html_extract.extract(html_extract.parse(source)) == want


def test_urls(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{BIG}/pages.parquet").collect()}
    rows = run(spark, "op4_url_filter")
    assert len(rows) == len(urls)
    for r in rows:
        _, sep, rest = urls[r.page_id].partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups() if sep else ("", "")
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, kind) for kind, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None) and (not fits or r.verdict == max(fits)[2])


@pytest.mark.parametrize(("sf", "parts"), [("sf0.01", (0, 1, 2, 3)), ("sf0.1", (2,))])
def test_trees_agree_with_rules_on_urls_not_learned_from(spark, sf, parts):
    """A quarter of the URLs that a rule labels is left out of the statistics and of the fitting, then judged."""
    rows = url_filter.ruled(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet"))
    right = blocked = n = 0
    for part in parts:
        out = F.crc32(F.col("url").cast("binary")) % 4 == part
        labelled = url_filter.labelled_urls(rows.where(~out))
        table = url_filter.statistics(labelled).cache()
        judged = url_filter.scored(rows.where(out & F.col("by_rule").isNotNull()), url_filter.train(labelled, table), table, rows).collect()
        right += sum((r.score >= url_filter.THRESHOLD) == (r.by_rule == "block") for r in judged)
        blocked += sum(r.by_rule == "block" for r in judged)
        n += len(judged)
    print(f"{sf}: {right} of {n} right, {blocked} blocked by the rules")
    assert right >= 0.95 * n > max(blocked, n - blocked)


def test_counts_leave_a_fold_out(spark):
    r = random.Random(5)
    made = [(i, f"http://{r.choice('abc')}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de'])}/{r.randrange(900)}") for i in range(300)]
    rows = url_filter.ruled(spark.createDataFrame(made, "page_id long, url string"))
    labelled = url_filter.labelled_urls(rows)
    got = url_filter.with_counts(labelled, url_filter.statistics(labelled), "fold").collect()
    known = [(x.host, x.path, x.blocked, x.fold) for x in got]
    for x in got:
        same = [y for y in known if y[3] != x.fold and y[0].split(".")[-1] == x.host.split(".")[-1]]
        assert x.counts[:2] == [len(same), sum(y[2] for y in same)]
        same = [y for y in known if y[3] != x.fold and (y[0].split(".")[-1], y[1][:5]) == (x.host.split(".")[-1], x.path[:5])]
        assert x.counts[10:] == [len(same), sum(y[2] for y in same)]


def test_boosting_against_every_split():
    """Stumps: each is the best of all splits of the gradient, found by trying every value."""
    r = np.random.default_rng(2)
    x = r.integers(0, 12, size=(200, 3)).astype(float)
    y = (x[:, 1] + r.normal(size=200) > 6).astype(float)
    start, trees = url_filter.boost(x, y, trees=5, depth=1)
    score = np.full(200, np.log(y.mean() / (1 - y.mean())))
    for feature, cut, value in trees:
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        best = (-1.0, None)
        for j in range(3):
            for c in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= c
                if 10 <= left.sum() <= 190:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
                    best = max(best, (gain, (j, left)), key=lambda z: z[0])
        j, left = best[1]
        assert feature[0] == j and ((x[:, j] <= cut[0]) == left).all()
        step = np.where(left, *(0.2 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)))
        assert np.allclose(url_filter.predict_tree(x, (feature, cut, value)), step)
        score = score + step
    assert start == pytest.approx(np.log(y.mean() / (1 - y.mean())))


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_line_dedup_has_a_native_plan(spark):
    plan = line_dedup.drop_boilerplate(spark.read.parquet(f"{BIG}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_copies_of_a_page_count_once(spark):
    rows = [(i, "copied line\nand another", "s") for i in range(30)] + [(50 + i, f"line {i}\nfooter", "s") for i in range(30)]
    got = {r.row.doc_id: r.cleaned for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == "copied line\nand another" and got[57] == "line 7"


def test_lines_of_one_site_only(spark):
    rows = [(i, f"header {s}\nbody {i}\nfooter", s) for i in range(40) for s in [f"s{i % 4}"]] + [(100 + i, f"header s0\nrest {i}", "t") for i in range(2)]
    got = {r.row.doc_id: (r.cleaned, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[5] == ("body 5", 3, 2) and got[100] == ("header s0\nrest 0", 2, 0)


def test_line_dedup_sql_on_near_copies(spark):
    """A group of near copies, a frame, and a host whose pages are mostly frame: the SQL has both counts."""
    import duckdb

    r = random.Random(3)
    rows = [(i, "\n".join(["the frame", *[f"copied line {k}" if k != i % 9 else f"own {i}" for k in range(9)]]), "a") for i in range(30)]
    rows += [(100 + i, f"the frame\nnews {r.randrange(9**9)} and {r.randrange(9**9)}\n\nthe end", "a") for i in range(60)]
    rows += [(200 + i, f"menu of the site\n{i}\nlong footer of the site", "b") for i in range(20)] + [(300, None, "a"), (301, "", None), (302, "the frame", "a")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.sql(line_dedup.ORACLE_SQL["op5_line_dedup"]).fetchall()
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = [tuple(x) for x in got.select("row.doc_id", "cleaned", "n_lines", "n_dropped").collect()]
    key = lambda x: x[0]
    assert sorted(got, key=key) == sorted(want, key=key)
    by_id = {x[0]: x[1] for x in got}
    assert by_id[0].startswith("own 0\ncopied line 1") and by_id[100].startswith("news")


# --- 6 ----------------------------------------------------------------------------------------------------------------


def test_licenses_against_every_window(texts):
    known = license_scan.Templates(license_scan.TEMPLATES)
    words = lambda t: [m for m in re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.translate(LOWER))]
    need = {n: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for n, t in license_scan.TEMPLATES.items() for w in [words(t)]}
    sample = list(texts.values())[:400]
    r = random.Random(4)
    for name, notice in license_scan.TEMPLATES.items():  # whole, and with a word changed, in the middle of other words
        w = notice.split()
        sample.append("Some words before. " * r.randrange(9) + notice + " and words behind. " * r.randrange(9))
        if len(need[name]) >= 16:
            w[-1] = "other"
            sample.append("und davor " * 7 + " ".join(w) + " und danach" * 5)
    for at, part in blocks(sample):
        for text, found in zip(part, license_scan.scan(part, known), strict=True):
            have = words(text)
            shingles = {tuple(have[i : i + 3]) for i in range(len(have) - 2)}
            possible = {n for n, s in need.items() if len(s & shingles) >= 0.8 * len(s)}
            got = {known.names[i] for i, *_ in found}
            assert got <= possible
            for n, notice in license_scan.TEMPLATES.items():
                if " ".join(words(notice)) in " ".join(have):
                    assert n in got, (n, text[:80])
    assert all(license_scan.collision(len(known.sets[i]), w) > 0.999 for w, m in known.classes.items() for i in m)


def test_licenses_in_any_company(texts):
    """A text's matches are the same alone and among others."""
    known = license_scan.Templates(license_scan.TEMPLATES)
    r = random.Random(14)
    notices = list(license_scan.TEMPLATES.values())
    some = [f"{t[:2000]} {r.choice(notices)[: r.randrange(20, 4000)]}" for t in list(texts.values())[:60]] + ["", "a", "a b"]
    assert license_scan.scan(some, known) == [license_scan.scan([t], known)[0] for t in some]


def test_copies_with_changed_words_are_found():
    """Copies that keep 0.8 to 0.9 of a notice's shingles, in other text: recall."""
    known = license_scan.Templates(license_scan.TEMPLATES)
    words = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t.translate(LOWER))
    r = random.Random(15)
    planted = found = 0
    for number, (name, notice) in enumerate(license_scan.TEMPLATES.items()):
        own = words(notice)
        if len(own) < 40 or name in license_scan.PARTS:
            continue
        need = {tuple(own[i : i + 3]) for i in range(len(own) - 2)}
        for _ in range(4):
            copy = list(own)
            while True:
                new = list(copy)
                new[r.randrange(len(new))] = f"q{r.randrange(10**6)}"
                share = len(need & {tuple(new[i : i + 3]) for i in range(len(new) - 2)}) / len(need)
                if share < 0.8:
                    break
                copy = new
            around = [[f"z{r.randrange(10**6)}" for _ in range(r.randrange(300))] for _ in range(2)]
            planted += 1
            found += number in {i for i, *_ in license_scan.scan([" ".join([*around[0], *copy, *around[1]])], known)[0]}
    print(f"{found} of {planted} found")
    assert planted > 50 and found >= 0.99 * planted
    least = min(license_scan.collision(len(known.sets[i]), w, 0.8) for w, m in known.classes.items() for i in m)
    assert least > 0.99


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_bpe_digests(spark, texts):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    for r in run(spark, "op7_bpe"):
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


# --- 8 ----------------------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = SPACES.findall(text.translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up, posts = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        seen = Counter(j for s in sets[i] for j in posts[s])
        for s in sets[i]:
            posts[s].append(i)
        for j, both in seen.items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components(spark, texts):
    want = brute_components(texts, 4)
    rows = run(spark, "op8_near_dedup")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_of_near_copies_over_many_cells(spark, monkeypatch):
    """Neighbours are linked, ends are not; small cells make a bucket span many of them."""
    monkeypatch.setattr(near_dedup, "CELL", 16)
    r = random.Random(9)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = {}
    for c in range(4):
        words = list(base)
        for i in range(60):
            words[r.randrange(120)] = f"n{c}x{i}"
            texts[c * 100 + i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: (x._n, x._component) for x in near_dedup.groups(df, 4).collect()} == brute_components(texts, 4)


@pytest.mark.parametrize("represent", [2, 30, 10**9])
def test_representatives_lose_no_link(spark, monkeypatch, represent):
    """Groups of near copies, chains whose ends differ, and strangers that share long passages, with small cells."""
    monkeypatch.setattr(near_dedup, "CELL", 8)
    monkeypatch.setattr(near_dedup, "REPRESENT", represent)
    r = random.Random(17)
    texts = {}
    for g in range(3):
        base = [f"g{g}w{r.randrange(5000)}" for _ in range(90)]
        for i in range(50):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(90)] = f"x{r.randrange(10**6)}"
            texts[1000 * g + i] = " ".join(words)
        for i in range(40):
            base[r.randrange(90)] = f"y{i}"
            texts[1000 * g + 100 + i] = " ".join(base)
    shared = [f"s{i}" for i in range(60)]
    for i in range(60):
        texts[5000 + i] = " ".join([f"t{r.randrange(10**6)}" for _ in range(r.randrange(10, 40))] + shared)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: (x._n, x._component) for x in near_dedup.groups(df, 4).collect()} == brute_components(texts, 4)


def test_bitmap_holds_what_is_needed(spark):
    r = np.random.default_rng(4)
    a, b = (r.integers(-(2**63), 2**63 - 1, 20_000) for _ in range(2))
    need = spark.createDataFrame(list(zip(a[:5000].tolist(), b[:5000].tolist(), strict=True)), "_a long, _b long")
    held = near_dedup._in_bitmap(near_dedup.class_bitmap(need), a, b)
    assert held[:5000].all() and held[5000:].mean() < 0.01
    assert not near_dedup._in_bitmap(near_dedup.class_bitmap(need.limit(0)), a, b).any()


def test_of_equal_sets_and_ids_the_smallest_row_stays(spark):
    body = " ".join(f"w{i}" for i in range(30))
    rows = [(7, body.upper(), "b"), (7, body, "c"), (7, body.upper(), "a"), (9, body, "a"), (8, "other words " * 9, "z")]
    for _ in range(2):
        got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
        assert sorted((x.doc_id, x.text, x.source) for x in got) == [(7, body.upper(), "a"), (8, "other words " * 9, "z")]
        rows.reverse()


def test_pruning_keeps_its_promise():
    least = near_dedup.fewest_matches(0.8, near_dedup.MISS)
    r = np.random.default_rng(1)
    hits = np.cumsum((r.random((20_000, near_dedup.CHECKS)) < 0.8).reshape(20_000, -1, near_dedup.BATCH).sum(axis=2), axis=1)
    assert (hits < np.array(least)).any(axis=1).mean() < 1e-3
    assert least == sorted(least) and least[-1] > 0.6 * near_dedup.CHECKS


# --- 9 ----------------------------------------------------------------------------------------------------------------


def test_packing(spark, texts):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    rows = run(spark, "op9_packing")
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at
    assert padding < 1024  # only the last sequence is not full
    for i, t in texts.items():
        ids, at = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_least_squares_meet_the_optimality_conditions():
    r = np.random.default_rng(7)
    true = packing.combinations(np.ones(65, dtype=int), 64)
    x = r.integers(0, 30, len(true)) * (r.random(len(true)) < 0.1)
    fits = np.bincount(np.repeat(true, x, axis=0).ravel(), minlength=65)
    fits[0] = 0
    odd = np.where(r.random(65) < 0.7, r.integers(0, 500, 65), 0)  # no combination of these lengths uses up all
    odd[0] = odd[64] = 0
    for counts in (fits, odd):
        columns = packing.combinations(counts, 64)
        fitted = packing.repeat_counts(counts, columns)
        miss, least, steepest = packing.optimality(counts, columns, fitted)
        assert fitted.min() >= 0 and max(-least, steepest) < 1e-4 * counts.max()
        if counts is fits:
            assert miss < 1e-3 * counts.sum()
        whole = packing.rounded(counts, columns, fitted)
        used = np.bincount(np.repeat(columns, whole, axis=0).ravel(), minlength=65)
        assert (used[1:] <= counts[1:]).all() and (counts is odd or used[1:].sum() > 0.95 * counts.sum())


# --- 10 ---------------------------------------------------------------------------------------------------------------


def brute_rules(text):
    words = SPACES.findall(text)
    chars = max(1, sum(map(len, words)))

    def covered(n):
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

    lines, again = set(), []
    for line in text.split("\n"):
        if SPACES.search(line):
            if line in lines:
                again.append(line)
            lines.add(line)
    repeated = len(covered(3))
    base = len(words) < 50 or 100 * repeated > 50 * len(words)
    kept = not base and sum(len(w) for line in again for w in SPACES.findall(line)) <= quality_rules.MAX_LINE_COVERAGE * chars
    kept = kept and all(sum(len(words[j]) for j in covered(n)) <= most * chars for n, most in quality_rules.MAX_COVERAGE.items())
    # Words outside of short runs of repeated lines.
    body, run, at = set(), [], 0
    for line in [x for x in text.split("\n") if SPACES.search(x)] + [None]:
        own = [] if line is None else list(range(at, at := at + len(SPACES.findall(line))))
        if line is not None and line in again:
            run += own
            continue
        if len(run) > quality_rules.RUN_WORDS:
            body.update(run)
        run = []
        body.update(own)
    size = sum(len(words[j]) for j in body)
    kept = kept and all(sum(len(words[j]) for j in covered(n) & body) <= most * size for n, most in quality_rules.MAX_PASSAGES.items())
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(again), repeated, base, kept


def test_rules(spark, texts):
    rows = run(spark, "op10_quality_rules")
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute_rules(texts[r.doc_id])


def test_rules_on_made_texts():
    r = random.Random(6)
    made = [" ".join(r.choice("ab cd é\n| # x\t\n").strip(" ") + str(r.randrange(k)) for _ in range(r.randrange(300))) for k in (2, 20, 2000) for _ in range(40)]
    made += ["\n".join([" ".join(f"w{i}" for i in range(60))] * k) for k in (1, 2, 5)] + ["\n".join(["same line here"] * 9 + [" ".join(f"u{i}" for i in range(90))])]
    for size, times in ((5, 12), (8, 6), (12, 2), (60, 2)):  # passages among other words and lines, some of these twice
        for tail in ("", "\nhead line\nfoot line here", "\n" + "\n".join(f"line {i} of a block" for i in range(15))):
            passage = " ".join(f"p{i}" for i in range(size))
            made.append(" ".join(f"{passage} x{r.randrange(9**9)} y{r.randrange(9**9)}" for _ in range(times)) + " " + " ".join(f"v{r.randrange(9**9)}" for _ in range(r.randrange(150, 500))) + 2 * tail)
    for at, part in blocks(made):
        m = quality_rules.measure(part)
        base, kept = quality_rules.verdicts(m)
        for i, t in enumerate(part):
            got = (m["n_words"][i], m["word_chars"][i], m["n_symbols"][i], m["n_dup_lines"][i], m["repeat_words_3"][i], base[i], kept[i])
            assert got == brute_rules(t)


def test_rules_sql_on_made_texts(spark):
    """The SQL on texts that the passages' limits and the line limit reject."""
    import duckdb

    r = random.Random(16)
    made = []
    for size, times in ((5, 12), (8, 6), (12, 3), (60, 2), (3, 2)):
        for tail in ("", "\nhead line\nfoot line here", "\n" + "\n".join(f"line {i} of a block" for i in range(15))):
            passage = " ".join(f"p{i}" for i in range(size))
            made.append(" ".join(f"{passage} x{r.randrange(9**9)}" for _ in range(times)) + " " + " ".join(f"v{r.randrange(9**9)}" for _ in range(r.randrange(60, 400))) + 2 * tail)
    made += ["", None, "a\n\n \nb", "\n".join(["x y"] * 60)]
    rows = [(i, t) for i, t in enumerate(made)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(quality_rules.ORACLE_SQL["op10_quality_rules"])
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).select(*want.columns).collect()
    assert sorted(map(tuple, out)) == sorted(want.fetchall())
    assert {r.kept for r in out if not r.base_failed} == {True, False}
