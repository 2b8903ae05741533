"""The streaming transducer against the public library."""

import random

import pytest
from tokenizers import Tokenizer

from epochgrid.llm import bpe

np = pytest.importorskip("numpy")
PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def pair():
    return bpe.Encoder(PATH), Tokenizer.from_file(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def texts(seed, n=400):
    r = random.Random(seed)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "'re", "l", "r", "e", "1", "23", "½", "é", "ß", "中", "😀", " ", " ", "\x1c", "_", "...", "!", "<|endoftext|>", "<|end", "#" * 7, "Tion", "ing", "\x00", "́", "ª", "²"]
    for _ in range(n):
        yield "".join(r.choice(signs) for _ in range(r.randrange(0, 60)))


def test_same_as_library(pair):
    enc, lib = pair
    for t in texts(1):
        got = enc.encode(t)
        assert ids(got) == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert "".join(bpe.Decoder(enc.merges).texts(got)) == lib.decode(ids(got), skip_special_tokens=False)


def test_slices_do_not_matter(pair):
    enc, lib = pair
    r = random.Random(2)
    for t in texts(3, 300):
        out, i = b"", 0
        while i < len(t):
            k = r.randrange(1, 9)
            out += enc.feed(t[i : i + k])
            i += k
        assert ids(out + enc.finish()) == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("unit", ["a", "ab", " ", "=", "the", "ation", "1", "é", "\n", "zqxj", "中"])
def test_long_runs(pair, unit, monkeypatch):
    enc, lib = pair
    monkeypatch.setattr(bpe, "SLICE", 3000)
    r = random.Random(unit)
    for text in (unit * 9000, unit * 8000 + " end", "x " + unit * 7000 + "'re", "".join(r.choice([unit, unit + "e", "in"]) for _ in range(6000))):
        assert ids(enc.encode(text)) == lib.encode(text, add_special_tokens=False).ids


def test_stable_tokens_survive_any_continuation(pair):
    enc, _ = pair
    r = random.Random(5)
    letters = "etaoinshrdlu"
    for _ in range(60):
        head = "".join(r.choice(letters) for _ in range(enc.lookahead + 300)).encode()
        p = bpe.Pieces(enc.merges, enc.lookahead)
        p.window = enc.lookahead + 200
        first = p.feed(head)
        for _ in range(3):
            tail = "".join(r.choice(letters) for _ in range(40)).encode()
            assert enc.merges.merge(head + tail)[: len(first)] == first


def test_decoder_keeps_unfinished_characters(pair):
    enc, _ = pair
    d = bpe.Decoder(enc.merges)
    text = "né 中 😀"
    one_by_one = [enc.merges.byte_ids[b] for b in text.encode()]
    assert "".join(d.feed([i]) for i in one_by_one) + d.finish() == text
    d = bpe.Decoder(enc.merges)
    assert d.feed([enc.merges.byte_ids[0xE4], enc.merges.byte_ids[0xB8]]) == ""
    assert d.finish() == "�"


def test_empty(pair):
    assert pair[0].encode("") == b""
