"""BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding. A merge at one place can depend on text to its right only through a chain of merges of rising rank, each
touching the left symbol or the product of the one before. ``lookahead`` computes, over the merge list, the longest
reach of such a chain in bytes: a token that ends that far before the end of the text known so far can never change.
A piece of a pre-tokeniser is therefore merged in windows of bounded size, and its tokens are emitted as soon as they
are stable. The pre-tokeniser itself streams too: a match is stable when it ends ``margin`` characters before the end
of what is known, and a run that fills the whole buffer is passed on class by class. So neither a very long text nor a
very long word needs more than constant memory. Short pieces repeat, and a bounded table remembers their tokens.

Decoding. Tokens are turned into bytes and fed to an incremental UTF-8 state machine, which keeps an unfinished
character until its next bytes come and puts U+FFFD for impossible ones.

Texts that spell an added token of the vocabulary file get that token, as the public library does.

Defined results: a null text is an empty text; it has no tokens, and the digests of no bytes. Rows are encoded one by
one, so ids may be null or repeat. An empty table gives no row. Columns other than the named ones are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .storage import gathered
from .text import map_batches

VOCABULARY = "byte_bpe_50k.json"
#: Characters that the encoder takes at a time, and the length from which one run is streamed.
SLICE = 1 << 16
#: Remembered pieces.
REMEMBERED = 300_000
_NONE = 1 << 60


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeList:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        signs = byte_signs()
        vocab: dict[str, int] = file["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(signs[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.byte_ids = [0] * 256
        for sign, b in signs.items():
            self.byte_ids[b] = vocab[sign]
        self.pairs: dict[int, int] = {}
        self.products: list[int] = []
        self.rules: list[tuple[int, int, int]] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]):
            self.pairs.setdefault(vocab[a] * self.size + vocab[b], rank)
            self.products.append(vocab[a + b])
            self.rules.append((vocab[a], vocab[b], vocab[a + b]))
        #: Whether a merge's rank follows from its product's number, so that a list of ranked byte strings says it all.
        self.ranked = all(x < y for x, y in zip(self.products, self.products[1:], strict=False)) and max(self.byte_ids) < min(self.products, default=_NONE)

    def lookahead(self) -> int:
        """Bytes after a token's end that fix the token: the longest reach of a chain of dependent merges."""
        reach = [0] * self.size
        most = 1
        for a, b, c in self.rules:
            far = max(reach[a], len(self.bytes[a]) + max(len(self.bytes[b]), reach[b]))
            reach[a] = max(reach[a], far)
            reach[c] = max(reach[c], far)
            most = max(most, far)
        return most

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of a whole piece: the lowest rank first, and of equal ones the leftmost."""
        ids = [self.byte_ids[b] for b in piece]
        if len(ids) > 256:
            return self._merge_long(ids)
        size, get, products = self.size, self.pairs.get, self.products
        ranks = [get(a * size + b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == _NONE:
                break
            i = ranks.index(r)
            ids[i] = products[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] * size + ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + ids[i], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in n log n."""
        n, size, get, products = len(ids), self.size, self.pairs.get, self.products
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] * size + ids[j], _NONE) != r:
                continue
            ids[i], ids[j] = products[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (x := get(ids[i] * size + ids[after[i]], _NONE)) != _NONE:
                    heapq.heappush(heap, (x, i))
            if (k := before[i]) >= 0 and (x := get(ids[k] * size + ids[i], _NONE)) != _NONE:
                heapq.heappush(heap, (x, k))
        return [x for x in ids if x >= 0]


class Pieces:
    """Streams one piece of any length: tokens come out once ``lookahead`` more bytes are known."""

    def __init__(self, merges: MergeList, lookahead: int) -> None:
        self.merges, self.lookahead, self.held = merges, lookahead, b""
        self.window = max(4096, 4 * lookahead)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        self.held += data
        at = 0
        while len(self.held) - at >= self.window:
            part = self.held[at : at + self.window]
            stable = self.window - self.lookahead
            for token in self.merges.merge(part):
                stable -= len(self.merges.bytes[token])
                if stable < 0:
                    break
                out.append(token)
                at += len(self.merges.bytes[token])
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class _Table(dict):
    """Tokens of short pieces as little-endian 32-bit integers."""

    def __init__(self, merges: MergeList) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.merges.merge(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


#: The pre-tokeniser's public pattern, and the classes of its runs.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CLASSES = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+"))
#: The same for text in ASCII and common Latin letters only, for the faster engine.
_LATIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ‐-‧]*\Z")
_LATIN_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Encoder:
    """encode(text), or feed(slice) again and again and finish(): tokens as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.merges = MergeList(path)
        self.lookahead = self.merges.lookahead()
        self.table = _Table(self.merges)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.merges.specials, key=len, reverse=True)) or r"(?!)")
        self.margin = max([3, *(len(s) - 1 for s in self.merges.specials)])
        self.buffer, self.run, self.kind = "", None, None

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream(text))

    def stream(self, text: str) -> Iterator[bytes]:
        """The tokens of a text, some for each slice."""
        if len(text) <= SLICE:
            yield self.feed(text, last=True)
            return
        for i in range(0, len(text), SLICE):
            yield self.feed(text[i : i + SLICE])
        yield self.finish()

    def finish(self) -> bytes:
        return self.feed("", last=True)

    def feed(self, text: str, last: bool = False) -> bytes:
        self.buffer += text
        out: list[bytes] = []
        while m := self.special.search(self.buffer):
            head, rest = self.buffer[: m.start()], self.buffer[m.end() :]
            self.buffer = head
            out += [self._ordinary(0), self._pack([self.merges.specials[m[0]]])]
            self.buffer = rest
        out.append(self._ordinary(0 if last else self.margin))
        return b"".join(out)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _ordinary(self, margin: int) -> bytes:
        """Tokens of what is stable in the buffer; with no margin, of all of it."""
        out: list[bytes] = []
        if self.run is not None:
            out.append(self._go_on(margin))
            if self.run is not None:
                return b"".join(out)
        text = self.buffer
        find = _LATIN_PATTERN if _LATIN.match(text) else PATTERN
        pieces = find.findall(text)
        self.buffer = ""
        if margin:
            known, end, n = len(text), 0, 0
            for piece in pieces:
                if end + len(piece) > known - margin:
                    break
                end += len(piece)
                n += 1
            if known - end > SLICE:  # the next piece fills the buffer
                rest = pieces[n]
                self.kind = next(c for c in _CLASSES if c.match(rest[-1]))
                self.run = Pieces(self.merges, self.lookahead)
                keep = max(margin, known - end - len(rest) + 1)
                out += [b"".join(map(self.table.__getitem__, pieces[:n])), self._pack(self.run.feed(text[end : known - keep].encode()))]
                self.buffer = text[known - keep :]
                return b"".join(out)
            pieces = pieces[:n]
            self.buffer = text[end:]
        long = [i for i, p in enumerate(pieces) if len(p) > 4096] if len(text) > 4096 else []
        at = 0
        for i in long:
            out.append(b"".join(map(self.table.__getitem__, pieces[at:i])))
            run = Pieces(self.merges, self.lookahead)
            out.append(self._pack(run.feed(pieces[i].encode()) + run.finish()))
            at = i + 1
        out.append(b"".join(map(self.table.__getitem__, pieces[at:])))
        return b"".join(out)

    def _go_on(self, margin: int) -> bytes:
        """More of the run that is being streamed. White space before other text gives its last character back."""
        text = self.buffer
        m = self.kind.match(text)
        n = m.end() if m else 0
        if n == len(text) and margin:
            keep = min(margin, n)
            ids = self.run.feed(text[: n - keep].encode())
            self.buffer = text[n - keep :]
            return self._pack(ids)
        if self.kind is _CLASSES[3] and n < len(text):
            n -= 1
        ids = self.run.feed(text[:n].encode()) + self.run.finish()
        self.buffer, self.run = text[n:], None
        return self._pack(ids)


class Decoder:
    """feed(ids) gives the text that is complete so far; finish() the rest."""

    def __init__(self, merges: MergeList) -> None:
        self.bytes = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)

    def texts(self, ids: bytes) -> Iterator[str]:
        """The text of packed ids, slice by slice."""
        for i in range(0, len(ids), 4 * SLICE):
            yield self.feed(np.frombuffer(ids[i : i + 4 * SLICE], "<u4").tolist())
        yield self.finish()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary, since loading takes longer than many texts."""
    return Encoder(path)


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, for every row of documents."""
    path = path or vocabulary_path()

    def work(batch):
        enc = encoder(path)
        n, first, second = [], [], []
        for text in batch.column(1):
            count, ids_digest, text_digest, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(enc.merges)
            for ids in enc.stream(text.as_py() or ""):  # tokens are digested, decoded and forgotten as they come
                count += len(ids) // 4
                ids_digest.update(ids)
                text_digest.update(back.feed(np.frombuffer(ids, "<u4").tolist()).encode())
            text_digest.update(back.finish().encode())
            n.append(count)
            first.append(ids_digest.hexdigest())
            second.append(text_digest.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = documents.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_batches(gathered(documents, documents), ["doc_id", "text"], schema, work)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict[str, str] = {}
