"""HTML extraction by removal of site templates.

1. Each page is parsed once into a tree (tags in any case, optional end tags, unclosed and cut-off markup), in time linear
   in its length. Subtrees of block elements are hashed over tag and normalised text; a page counts each hash once.
   Landmarks (``LANDMARKS``) outside of articles, and subtrees there whose text is mostly links, are hashed by their
   skeleton as well: tags and classes, with equal neighbours as one. So menus and footers recur whose words change.
2. Spark counts the hashes per host, with partial sums before the shuffle. A subtree is a site template if it is on
   ``MIN_PAGES`` pages, and on ``MIN_SHARE`` of the host's pages or on ``MANY_PAGES``, however many more the host has.
3. Pages are parsed again with the hashes of their templates: those subtrees go, and so do elements that are never
   article text (by tag, role, or words of class and id; layout elements around an article stay). What is left inside
   article or main elements is the text, or all that is left if a page has none of these.

Plain text blocks inside an article (paragraphs, headings, list items and so on) may be passages that articles of a host
share, and equal skeletons say less than equal texts. Both are templates only on ``PLAIN_SHARE`` of the host's pages or on
``PLAIN_MANY``; other elements inside an article are held to the same limits as those outside.

Character references are decoded after parsing; white space inside a block becomes one space; blocks that have text are
joined by one line feed, in page order.

A host has at most (subtrees per page) / ``MIN_SHARE`` templates, or its subtrees / ``MANY_PAGES`` if that is more. Their table is written, and Spark broadcasts
it if its measured size is under the session's threshold, so that html is not shuffled at all; beyond that it joins on
the host and splits hosts that hold many pages.

Defined results: null or empty html gives an empty text. A null url has the empty host. Repeated rows are extracted one
by one. Pages of any length are parsed whole. An empty table gives no row. Columns other than the named ones are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import gathered, kept
from .text import map_batches
from .url_filter import host_and_path

MIN_PAGES = 5
MIN_SHARE = 0.1
#: So many pages of a host are enough, whatever their share.
MANY_PAGES = 100
#: The same for plain text blocks inside articles, which articles may share, and for skeletons.
PLAIN_SHARE, PLAIN_MANY = 0.5, 1000
#: Characters of attributes from which a verdict is not kept for the next such tag.
LONG = 2000

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style title template noscript iframe object embed svg math canvas audio video map nav menu aside footer form button select textarea input option datalist dialog noembed noframes".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot table caption figcaption figure ul ol dl address article main".split())
#: Elements that are hashed by their skeleton, and the share of a subtree's characters in links from which it is, too.
LANDMARKS = frozenset("nav header footer aside form menu".split())
LINK_SHARE = 0.6
#: Start tags that end an open element of the second group, unless one of the third lies between.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_WALLS = frozenset("article main section div body html td th table ul ol dl aside nav header footer form blockquote".split())
#: What may stand within a line, and doesn't end it.
WITHIN = INLINE | frozenset("script style template noscript iframe object embed svg math canvas audio video map button select textarea input datalist".split())
#: Elements that may wrap a whole page.
LAYOUT = frozenset("aside form header footer menu".split())
#: Words in class, id or role that name what is not an article's text; those of the second kind may name a layout.
STRONG = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisement|advertising|adbox|adsbygoogle|sponsor(?:ed)?|comments?|commentlist|disqus|replies|respond|reactions|cookies?|consent|gdpr|newsletter|navbar|nav|breadcrumbs?|menubar|pagination|pager|skip-link)(?=$|[_-])",
    re.IGNORECASE,
)
WEAK = re.compile(
    r"(?:^|[_-])(?:promo(?:tion)?|banner|notices?|alert|popup|modal|overlay|subscribe|subscription|signup|sign-up|login|navigation|menu|sidebar|side-bar|aside|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|widget|search|searchform|complementary|contentinfo|toc)(?=$|[_-])",
    re.IGNORECASE,
)
HEADER = re.compile(r"(?:^|[_-])(?:header|head)(?=$|[_-])", re.IGNORECASE)
NOT_A_NAME = re.compile(r"(?:has|no|with|without|is)-", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """noise: 0 none, 1 unless an article lies inside, 2 always. inside: in an article. holds: an article lies inside."""

    __slots__ = ("tag", "kids", "noise", "inside", "holds", "main", "names")

    def __init__(self, tag: str, noise: int, inside: bool, main: bool, names: str) -> None:
        self.tag, self.kids, self.noise, self.inside, self.holds, self.main, self.names = tag, [], noise, inside, False, main, names

    def dropped(self) -> bool:
        return self.noise == 2 or (self.noise == 1 and not self.holds)


@lru_cache(maxsize=4096)
def _judge(tag: str, attributes: str, inside: bool) -> tuple[int, bool, str]:
    """How far an element is noise, whether it is an article, and its classes and role. An article's own header is kept."""
    main = tag in ("article", "main")
    names: list[str] = []
    noise = 0
    if tag in NEVER:
        noise = 1 if tag in LAYOUT else 2
    elif tag == "header" and not inside:
        noise = 1
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and HIDDEN.search(value)) or (name == "aria-hidden" and value.lower() == "true"):
            noise = 2
        elif name in ("class", "id", "role") and tag not in ("html", "body"):
            if name != "id":
                names += value.lower().split()
            if name == "role" and value.lower() in ("main", "article"):
                main = True
                continue
            for word in value.split():
                if NOT_A_NAME.match(word):
                    continue
                if STRONG.search(word):
                    noise = 2
                elif not main and (WEAK.search(word) or (not inside and HEADER.search(word))):
                    noise = max(noise, 1)
        elif name == "itemprop" and value == "articleBody":
            main = True
    return noise, main and noise < 2, " ".join(sorted(names))


def parse(source: str) -> Node:
    root = Node("#root", 0, False, False, "")
    path = [root]
    #: Depths of the open elements by tag, and of those that are walls.
    opened: dict[str, list[int]] = {}
    walls = [0]

    def nearest(tag: str) -> int:
        depths = opened.get(tag)
        return depths[-1] if depths else 0

    def close(depth: int) -> None:
        while len(path) > depth:
            opened[path.pop().tag].pop()
        while walls[-1] >= depth:
            walls.pop()

    at, n = 0, len(source)
    while at < n:
        node = path[-1]
        m = TOKEN.search(source, at)
        if m is None:
            node.kids.append(source[at:])
            break
        if m.start() > at:
            node.kids.append(source[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            depth = nearest(tag)
            if depth and (tag in _WALLS or depth > walls[-1]):
                close(depth)
            elif tag == "br":
                node.kids.append(" ")
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag or (m[4] and not m[0].endswith(">")):  # a comment, or a tag that the page's end cuts off
            continue
        if tag in CLOSES_P and nearest("p") > max(walls[-1], nearest("li")):
            close(nearest("p"))
        if tag in IMPLIED:
            ends, between = IMPLIED[tag]
            wall = max(map(nearest, between))
            found = [depths[i] for x in ends if (depths := opened.get(x)) and (i := bisect_right(depths, wall)) < len(depths)]
            if found:
                close(min(found))
        node = path[-1]
        attributes = m[3] or m[5] or ""
        judge = _judge if len(attributes) < LONG else _judge.__wrapped__  # long ones, such as data: URIs, don't recur
        noise, main, names = judge(tag, attributes, node.inside)
        new = Node(tag, noise, node.inside or main, main, names)
        if main:
            for x in reversed(path):
                if x.holds or x.inside:
                    break
                x.holds = True
        node.kids.append(new)
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            at = end.end() if end else n
        elif tag not in VOID:
            opened.setdefault(tag, []).append(len(path))
            if tag in _WALLS:
                walls.append(len(path))
            path.append(new)
    return root


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE)


def _normal(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _walk(root: Node):
    """Nodes, children before parents, without recursion: pages may nest deeply."""
    stack, out = [root], []
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [k for k in x.kids if isinstance(k, Node)]
    return reversed(out)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def subtree_hashes(root: Node) -> dict[Node, list[int]]:
    """Signed 64-bit hashes for each block element that may be a template: of its text, and of its skeleton if that counts.

    The lowest bit tells those that need many pages from the others.
    """
    sums: dict[Node, tuple[int, int, int, int]] = {}  # hash, skeleton, characters, characters in links
    out: dict[Node, list[int]] = {}
    for x in _walk(root):
        h = xxhash.xxh64(x.tag)
        shape = xxhash.xxh64(f"{x.tag} {x.names}")
        text, size, linked, last = "", 0, 0, None

        def flush():
            nonlocal text, size
            normal = _normal(text)
            h.update(normal)
            size += len(normal)
            text = ""

        for k in x.kids:
            if isinstance(k, Node):
                if text:
                    flush()
                own = sums[k]
                h.update(own[0].to_bytes(8, "little"))
                if own[1] != last:
                    last = own[1]
                    shape.update(last.to_bytes(8, "little"))
                size += own[2]
                linked += own[3]
            else:
                text += k
        if text:
            flush()
        if x.tag == "a":
            linked = size
        if x.tag in RAW or x.tag in ("noscript", "template"):
            size = linked = 0
        v = h.intdigest()
        sums[x] = v, shape.intdigest(), size, linked
        if x.tag not in INLINE and x.tag not in ("#root", "html", "body", "head", "hr"):
            plain = x.inside and x.tag in PLAIN
            if plain and (x.main or x.tag in ("article", "main")):
                continue
            out[x] = [_signed(v & ~1 | plain)]
            if not x.inside and not x.holds and (x.tag in LANDMARKS or linked > LINK_SHARE * size):
                out[x].append(_signed(shape.intdigest() ^ 0x5EED | 1))
    return out


def extract(root: Node, templates: frozenset[int] = frozenset()) -> str:
    """The text that is left without templates and noise."""
    dropped = {x for x, hashes in subtree_hashes(root).items() if not templates.isdisjoint(hashes)} if templates else set()
    blocks: list[tuple[bool, str]] = []
    parts: list[str] = []
    where = False

    def flush():
        text = _normal("".join(parts)) if parts else ""
        parts.clear()
        if text:
            blocks.append((where, text))

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x is None:
            flush()
            continue
        if isinstance(x, tuple):
            flush()
            where = x[0]
            continue
        if x.dropped() or x in dropped:
            if x.tag not in WITHIN:
                flush()
            continue
        if x.tag == "br":
            parts.append(" ")
            continue
        inner = reversed(x.kids)
        if x.main:
            flush()
            stack.append((where,))
            where = True
            stack += inner
        elif x.tag in INLINE:
            stack += inner
        else:
            flush()
            stack.append(None)
            stack += inner
    flush()
    main = [t for w, t in blocks if w]
    return "\n".join(main or [t for _, t in blocks])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host and hashes: the template subtrees of each host that has any."""
    rows = pages.select(host_and_path(F.col("url"))[0].alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    schema = T.StructType().add("host", "string").add("hashes", T.ArrayType(T.LongType()))

    def read(batch):
        hashes = [list({h for own in subtree_hashes(parse(s)).values() for h in own}) for s in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "hashes"])

    counted = map_batches(rows, ["host", "html"], schema, read).select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("of"))
    plain = F.col("hash").bitwiseAND(F.lit(1)) == 1
    least = F.when(plain, F.least(F.lit(PLAIN_SHARE) * F.col("of"), F.lit(float(PLAIN_MANY)))).otherwise(F.least(F.lit(min_share) * F.col("of"), F.lit(float(MANY_PAGES))))
    often = counted.where(F.col("n") >= min_pages).join(hosts, "host").where(F.col("n") >= least)
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    templates = kept(site_templates(pages, min_pages, min_share), "templates", pages)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_and_path(F.col("url"))[0].alias("host"))
    met = gathered(rows, pages).join(templates, "host", "left")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def cut(batch):
        texts = [extract(parse(s), frozenset(t or ())) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(met, ["page_id", "url", "html", "hashes"], schema, cut)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE_SQL: dict[str, str] = {}
