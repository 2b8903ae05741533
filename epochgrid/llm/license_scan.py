"""License scans: MinHash over overlapping text windows retrieves templates, shingle containment verifies them.

Templates are license notices: short ones, standard headers and full texts (``license_templates``). Their words (letters and
digits in lower case) make shingles of ``SHINGLE`` words. Templates are put into classes by length; for each class a text is
cut, from its own start, into overlapping windows of ``STRIDES`` + 1 strides, so that any stretch as long as the longest
template of the class lies whole in some window. A window whose MinHash signature shares a band with a template is a
candidate for it.

Bands have one row. A window is mostly other text, so that its similarity to a template is about s / w for s shingles in a
window of w, often 0.4 or less, even if it holds the template whole: bands of r rows would need (w / s) ** (r - 1) times as
many hashes for the same probability. With one row an exact notice shares one of ``HASHES`` bands with probability
1 - (1 - s / w) ** HASHES, and a copy that keeps a share c of the shingles with 1 - (1 - c s / w) ** HASHES (see
``collision``; the least, for a notice of one shingle in a window of five, is 0.9992). Windows that overlap it raise that.

A candidate is verified on its full shingles: it matches where at least ``CONTAINED`` of the template's shingles are in the
window. Neighbouring windows that match a template are one match; its span is from the first to the last shared shingle.

A notice may have words that name its license (``PARTS``): a match must hold them unbroken, so that a notice of another
license or version is none. A notice of at most ``SHORT`` words is also looked for around these words, with one word
changed, left out or put in elsewhere; its containment is then the share of its words that are left.

Templates and their bands are about 1 MB and go to every task; texts are scanned whole, once, without a shuffle.

Defined results: a null or empty text has no match. Rows are scanned one by one, so ids may be null or repeat, and a text's
matches do not depend on its neighbours. A text shorter than a shingle has no match. An empty table gives no row. Columns
other than the named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .license_templates import PARTS, TEMPLATES
from .storage import gathered
from .text import Block, blocks, map_batches, mix, span_hashes, window_hashes

SHINGLE, HASHES, CONTAINED, STRIDES = 3, 32, 0.8, 4
SHORT = 24
_SEEDS = mix(np.arange(7001, 7001 + HASHES, dtype=np.uint64))
_TIMES = (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_XOR = (_SEEDS >> np.uint64(32)).astype(np.uint32)

def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-case words, their byte spans, and the first word of each text."""
    block = Block(texts)
    block.data = block.lowered()
    starts, ends = block.tokens()
    wordy = np.isin(block.data[starts], _WORDY)
    starts, ends = starts[wordy], ends[wordy]
    return span_hashes(block.data, starts, ends), starts, ends, block.firsts(starts)


_WORDY = np.array([b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128], dtype=np.uint8)


class Templates:
    def __init__(self, templates: dict[str, str], shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        self.names = list(templates)
        self.sets, lengths = [], []
        #: Of a notice with words that name its license: the words before, these, and the words behind.
        self.parts: dict[int, tuple[list[int], list[int], list[int]]] = {}
        #: Short ones of these by the hash of the naming words' first two.
        self.heads: dict[int, list[int]] = {}
        for i, (name, text) in enumerate(templates.items()):
            words = _words([text])[0]
            lengths.append(len(words) - shingle + 1)
            self.sets.append(np.unique(window_hashes(words, shingle)) if lengths[-1] > 0 else np.empty(0, np.uint64))
            parts = tuple(_words([x])[0].tolist() for x in PARTS.get(name, ()))
            if parts and sum(parts, []) == words.tolist():
                self.parts[i] = parts
                if len(words) <= SHORT:
                    self.heads.setdefault(int(window_hashes(np.array(parts[1][:2], np.uint64), 2)[0]), []).append(i)
        #: Classes by the power of two that holds a template's shingles: window width in shingles, and members.
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                self.classes.setdefault(1 << max(2, int(np.ceil(np.log2(lengths[i])))), []).append(i)
        self.classes = dict(sorted(self.classes.items()))
        self.bands = {}
        for width, members in self.classes.items():
            rows = np.array([[((self.sets[i].astype(np.uint32) ^ _XOR[j]) * _TIMES[j]).min() for j in range(HASHES)] for i in members])
            self.bands[width] = rows


def _with_an_edit(have: list[int], want: list[int]) -> tuple[int, int]:
    """Least edits (2 for more than one) that turn the start of have into want, and the words of have that this takes."""
    n = len(want)
    if have[:n] == want:
        return 0, n
    i = next(i for i in range(n) if i >= len(have) or have[i] != want[i])
    for skip, to in ((1, 1), (0, 1), (1, 0)):  # a word changed, left out, put in
        rest = want[i + to :]
        if have[i + skip : i + skip + len(rest)] == rest and i + skip <= len(have):
            return 1, i + skip + len(rest)
    return 2, 0


def _holds(words: list[int], part: list[int]) -> bool:
    return any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1))


def _named(words: np.ndarray, firsts: np.ndarray, templates: Templates):
    """Text, template, first and last word, and containment of short notices around the words that name a license."""
    pairs = window_hashes(words, 2)
    for p in np.flatnonzero(np.isin(pairs, np.array(list(templates.heads), np.uint64))).tolist():
        t = int(np.searchsorted(firsts, p, side="right")) - 1
        lo, hi = int(firsts[t]), int(firsts[t + 1])
        have = words[max(lo, p - SHORT - 1) : min(hi, p + 2 * SHORT + 1)].tolist()
        at = p - max(lo, p - SHORT - 1)
        for i in templates.heads[int(pairs[p])]:
            before, name, behind = templates.parts[i]
            if have[at : at + len(name)] != name:
                continue
            left, n_left = _with_an_edit(have[:at][::-1], before[::-1])
            right, n_right = _with_an_edit(have[at + len(name) :], behind)
            if left + right <= 1:
                n = len(before) + len(name) + len(behind)
                yield t, i, p - n_left, p + len(name) + n_right - 1, (n - left - right) / n


def collision(shingles: int, width: int, contained: float = 1.0) -> float:
    """Least probability that a window around a copy that keeps this share of a notice's shingles shares a band with it."""
    return 1 - (1 - contained * shingles / (width + max(1, width // STRIDES))) ** HASHES


def _segments(firsts: np.ndarray, stride: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, texts, and the number of the last one of its text, of segments of stride shingles of each text."""
    n = np.maximum(0, np.diff(firsts) - k + 1)
    many = -(-n // stride)
    text = np.repeat(np.arange(len(n)), many)
    ends = np.cumsum(many)
    within = np.arange(len(text)) - np.repeat(ends - many, many)
    return firsts[:-1][text] + within * stride, text, np.repeat(ends - 1, many)


def scan(texts: list[str], templates: Templates, contained: float = CONTAINED) -> list[list[tuple[int, int, int, float]]]:
    """For each text its matches: template, first and end byte, best containment; in order of place."""
    words, starts, ends, firsts = _words(texts)
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    k = templates.shingle
    shingles = window_hashes(words, k)
    if not len(shingles):
        return out
    text_of = np.repeat(np.arange(len(texts)), np.diff(firsts))
    real = text_of[: len(shingles)] == text_of[k - 1 :]
    bounds = np.cumsum([0, *(len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts)])
    hit: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    short, unreal = shingles.astype(np.uint32), np.flatnonzero(~real)
    if not real.any():
        return out
    span = STRIDES + 1
    # For each class: its segments, those of the class before that make these up, and the segments that a window adds.
    laid, finer = {}, None
    for width in templates.classes:
        begin, text, last = _segments(firsts, max(1, width // STRIDES), k)
        made_of = begin if finer is None else np.searchsorted(finer, begin)
        # Near a text's end windows are shorter: the segments that these have are listed.
        tail = np.flatnonzero(last - np.arange(len(begin)) < span - 1)
        laid[width] = begin, text, made_of, tail, [np.minimum(tail + s, last[tail]) for s in range(1, span)]
        finer = begin
    same = {width: np.zeros((len(members), len(laid[width][0])), dtype=bool) for width, members in templates.classes.items()}
    for j in range(HASHES):
        low = (short ^ _XOR[j]) * _TIMES[j]
        low[unreal] = np.uint32(0xFFFFFFFF)
        for width in templates.classes:
            _, _, made_of, tail, more = laid[width]
            low = np.minimum.reduceat(low, made_of)
            window, short_ones = low.copy(), low[tail]
            for s, at in enumerate(more, 1):
                np.minimum(window[:-s], low[s:], out=window[:-s])
                np.minimum(short_ones, low[at], out=short_ones)
            window[tail] = short_ones
            same[width] |= window[None, :] == templates.bands[width][:, j, None]
    for width, members in templates.classes.items():
        begin, text, _, _, _ = laid[width]
        for m, i in enumerate(members):
            need = templates.sets[i]
            for w in np.flatnonzero(same[width][m]).tolist():
                a, t = int(begin[w]), int(text[w])
                b = min(int(firsts[t + 1]) - k + 1, a + span * max(1, width // STRIDES))
                at = a + np.flatnonzero(np.isin(shingles[a:b], need))
                if not len(at):
                    continue
                share = len(np.unique(shingles[at])) / len(need)
                if share >= contained and (i not in templates.parts or _holds(words[at[0] : at[-1] + k].tolist(), templates.parts[i][1])):
                    hit.setdefault((t, i), []).append((int(starts[at[0]]), int(ends[at[-1] + k - 1]), share))
    for t, i, first, last, share in _named(words, firsts, templates):
        hit.setdefault((t, i), []).append((int(starts[first]), int(ends[last]), share))
    for (t, i), spans in hit.items():
        spans.sort()
        joined: list[list] = []
        for a, b, share in spans:
            if joined and a < joined[-1][1]:
                joined[-1][1], joined[-1][2] = max(b, joined[-1][1]), max(share, joined[-1][2])
            else:
                joined.append([a, b, share])
        out[t] += [(i, int(a - bounds[t]), int(b - bounds[t]), share) for a, b, share in joined]
    for matches in out:
        matches.sort(key=lambda x: (x[1], x[0]))
    return out


MATCH = "array<struct<license:string,first_byte:bigint,end_byte:bigint,containment:double>>"


def licenses(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_matches, licenses (names, sorted) and matches (with byte spans) for every row of documents."""
    known = Templates(templates or TEMPLATES)
    schema = documents.select("doc_id").schema
    fields = f"doc_id {schema['doc_id'].dataType.simpleString()}, n_matches bigint, licenses array<string>, matches {MATCH}"
    struct = pa.struct([("license", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("containment", pa.float64())])

    def work(batch):
        found: list[list] = []
        for _, texts in blocks(batch.column(1).to_pylist()):
            found += scan(texts, known)
        named = [[{"license": known.names[i], "first_byte": a, "end_byte": b, "containment": c} for i, a, b, c in matches] for matches in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(m) for m in named], pa.int64()), pa.array([sorted({x["license"] for x in m}) for m in named], pa.list_(pa.string())), pa.array(named, pa.list_(struct))],
            names=["doc_id", "n_matches", "licenses", "matches"],
        )

    return map_batches(gathered(documents, documents), ["doc_id", "text"], fields, work)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL: dict[str, str] = {}
