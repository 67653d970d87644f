import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.llm import bpe
from tests.llm.conftest import odd_rows

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def blob():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(blob):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(blob):
    return bpe.Encoder(blob, P.PATTERN)


def same(encoder, library, texts):
    ids, at = encoder.encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(t), repr(t[:80])


def test_white_space_and_scripts(encoder, library):
    same(encoder, library, ["", " ", "  ", "\n", "a\n ", "foo   bar", "foo\n \nbar", "foo  ", "x\x1cy \x1f z", "  x  y", "ÄÖ 日本語 123४५", "x́ y", "\x85 \x85", "a \n  b \t", "'s 't don't"])


def test_long_pretokens(encoder, library):
    r = random.Random(1)
    same(encoder, library, ["a" * 20_000, "ab" * 700 + "c" * 300, *["".join(r.choice("etaoinsh") for _ in range(r.randint(200, 900))) for _ in range(20)]])


@given(st.lists(st.text(alphabet=" \n\tabcdeABé日1'!\x1c\x85_", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_equals_the_library(encoder, library, texts):
    same(encoder, library, texts)


def test_cache_may_shrink(blob, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20_000)
    monkeypatch.setattr(bpe, "SEGMENT", 64)
    monkeypatch.setattr(bpe, "GROUP", 256)
    monkeypatch.setattr(bpe, "MERGE_BYTES", 100)
    own = bpe.Encoder(blob, P.PATTERN)
    r = random.Random(2)
    for _ in range(5):
        same(own, library, [" ".join("".join(r.choice("abcdeé\n日\u3000\xa0 ") for _ in range(r.randint(1, 6))) for _ in range(80)) for _ in range(3)])
        assert own.chunks.size < 20_000 and own.pieces.size < 20_000


def test_both_queues_agree(encoder):
    r = random.Random(3)
    pieces = ["".join(r.choice("theinr") for _ in range(r.randint(2, 40))).encode() for _ in range(200)]
    ids, at = bpe.merge_many(encoder.vocabulary, pieces)
    for k, p in enumerate(pieces):
        assert ids[at[k] : at[k + 1]].tolist() == bpe.merge_long(encoder.vocabulary, p)


def test_odd_rows(odd, none, library):
    got = bpe.encode(odd, PATH, P.PATTERN, carry=["doc_id"], ids=False, digests=True).collect()
    want = sorted((i if i is not None else -99, len(e := library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in odd_rows())
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(odd, PATH, P.PATTERN), PATH).collect()}
    assert all(back[i] == (t or "").encode() for i, t, *_ in odd_rows() if i is not None)
    assert bpe.encode(none, PATH, P.PATTERN).count() == 0 and bpe.decode(bpe.encode(none, PATH, P.PATTERN), PATH).count() == 0
    assert bpe.encode(odd, PATH, P.PATTERN).columns == [*[c for c in odd.columns if c != "ids"], "ids"]


def test_digests_by_blocks(blob, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    texts = ["", "one two three four five six seven eight nine ten eleven " * 3, "x", "", "a b c d e f g h i", "日本語"]
    ids, at = encoder.encode(texts)
    found = bpe.Decoder(blob).digests(ids, at)
    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]].tolist()
        assert (found[0][k], found[1][k]) == (hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_memory_is_bounded(blob):
    """Texts of runs of spaces, and long words that are all distinct, leave little behind; nothing is left after a partition."""
    own = bpe.Encoder(blob, P.PATTERN)
    for k in range(10):
        own.encode([f"{k}x{j}   y{j * 7919 % 100003}z" * 3 for j in range(20_000)])
        assert own.chunks.size <= bpe.CACHE and own.pieces.size <= bpe.CACHE
        assert all(len(c) <= bpe.KEPT for c in own.chunks) and all(len(c) <= bpe.KEPT for c in own.pieces)
    own.forget()
    assert not own.chunks and not own.pieces
