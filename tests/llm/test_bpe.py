from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from regionflow.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
CODER = bpe.coder(PATH, P.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODER.bpe.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80) | st.text(alphabet="aeinorst 'sdlm\n\t1é—", max_size=120))
def test_same_ids_as_the_library(text):
    ids = CODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert CODER.bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, " " * 500, "don't they'll we've", "<|endoftext|>", "日本語テキスト", "a\r\n\r\n  b"])
def test_edges(text):
    assert CODER.encode(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(max_size=30))
def test_appends_extend_the_table(head, tail):
    table = CODER.bpe.table(head)
    assert CODER.bpe.table(head + tail, list(table)) == CODER.bpe.table(head + tail)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdefgh ", min_size=5, max_size=200), st.data())
def test_edits_give_the_table_of_the_changed_text(text, data):
    piece = text.encode()
    a = data.draw(st.integers(0, len(piece)))
    b = data.draw(st.integers(a, min(len(piece), a + 5)))
    new = data.draw(st.binary(max_size=4))
    changed, table, _ = CODER.bpe.edit(piece, CODER.bpe.table(piece), a, b, new)
    assert changed == piece[:a] + new + piece[b:]
    assert table == CODER.bpe.table(changed)


def test_an_edit_stops_early():
    piece = ("the thing " * 400).encode()
    _, _, computed = CODER.bpe.edit(piece, CODER.bpe.table(piece), 10, 11, b"q")
    assert computed < len(piece) / 2


def test_digests_and_round_trip(hard):
    rows = bpe.digests(hard, PATH, P.PATTERN).collect()
    want = sorted(_digest(r["doc_id"], r["text"]) for r in hard.collect())
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want
    back = bpe.decode(bpe.encode(hard, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((r["text"] or "").encode() for r in hard.collect())


def _digest(doc_id, text):
    ids = REFERENCE.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (str(doc_id), len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))


def test_empty_table_and_clashing_columns(empty, clashing):
    assert bpe.digests(empty, PATH, P.PATTERN).count() == 0
    assert bpe.digests(clashing, PATH, P.PATTERN).count() == clashing.count()


def neighbours(bpe_, left, right):
    return bpe_.merged(bpe_.tokens[left] + bpe_.tokens[right]) == [left, right]


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 50_255), st.integers(0, 50_255))
def test_pairs_agree_with_the_merges(left, right):
    assert CODER.bpe.pair(left, right) == neighbours(CODER.bpe, left, right)


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False))
def test_vocabularies_whose_ranks_fall(random):
    """Ranks in any order: tokens that the merges never give, and merges that make a better one possible."""
    tokens = {bytes([x]) for x in b"abc"} | {bytes(random.choices(b"abc", k=random.randint(2, 5))) for _ in range(25)}
    order = sorted(tokens)
    random.shuffle(order)
    own = bpe.PrefixBpe({t: i for i, t in enumerate(order)})
    for left in own.tokens:
        for right in own.tokens:
            if own.stable(left) and own.stable(right):
                assert own.pair(left, right) == neighbours(own, left, right)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_BYTES_KEPT", 2000)
    small = bpe.TextBpe(CODER.bpe, P.PATTERN)
    text = " ".join(f"word{i} qzx{i * 7}" for i in range(200)) + " " + "x" * 500
    assert small.encode(text) == REFERENCE.encode_ordinary(text) and small.pieces.held <= 2000
