"""Merges of many words at once against one word at a time, and their use by both encoders."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sortfolio.llm import bpe, merging, pieces


def plain(word: list[int], joins: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    word = list(word)
    while hits := [(joins[pair][0], k) for k, pair in enumerate(zip(word, word[1:])) if pair in joins]:
        k = min(hits)[1]
        word[k : k + 2] = [joins[word[k], word[k + 1]][1]]
    return word


@pytest.mark.parametrize("tied", [False, True])
def test_many_words_are_merged_like_each_alone(tied):
    r = random.Random(5)
    for _ in range(20):
        pairs = sorted({(r.randrange(12), r.randrange(12)) for _ in range(60)})
        r.shuffle(pairs)
        joins = {p: (k // 3 if tied else k, r.randrange(4, 12)) for k, p in enumerate(pairs)}
        words = [[r.randrange(4) for _ in range(r.choice([1, 2, 3, 8, 40]))] for _ in range(50)]
        table = merging.Merges((*p, *hit) for p, hit in joins.items())
        got = table.packed(np.array(sum(words, []), np.int32), np.array([len(w) for w in words]))
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == [plain(w, joins) for w in words]


def test_no_joins():
    assert merging.Merges([]).packed(np.array([3, 1], np.int32), np.array([2])) == [np.array([3, 1], "<i4").tobytes()]


def test_spans_hold_each_text_once():
    texts = ["ab", None, "", "abcdefgh", "c"]
    assert [*merging.spans(pa.array(texts), 3)] == [(0, ["ab", "", "", "abcdefgh"]), (4, ["c"])]
    assert [*merging.spans(pa.array([], pa.string()))] == []


def odd_texts() -> list[str]:
    r = random.Random(3)
    letters = "aeiouthersn" * 3 + "éßÑ'-.,!?0123 \n\t日😀́"
    return ["", " ", "x" * 200, "aaaa aaa aa a", "don't STOP", "a<|endoftext|>b"] + ["".join(r.choice(letters) for _ in range(r.randint(1, 400))) for _ in range(150)]


def test_words_of_a_text_file_are_merged_together(monkeypatch):
    """None is scanned alone, no block of characters is probed before it is met, and a small memory changes no ids."""
    with open(bpe.MODEL, "rb") as f:
        v = bpe.Vocabulary(f.read())
    assert not v.doubt
    monkeypatch.setattr(bpe.Vocabulary, "fragment", lambda *_: pytest.fail("a word was scanned alone"))
    short = [t for t in odd_texts() if max(map(len, t.split()), default=0) <= bpe.CACHED]
    library = Tokenizer.from_file(bpe.MODEL)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in short]
    assert v.encode_all(short) == want
    monkeypatch.setattr(bpe, "CACHE", 50)
    assert [v.encode(t) for t in short] == want
    monkeypatch.undo()
    assert np.frombuffer(v.encode("x" * 200), "<u4").tolist() == library.encode("x" * 200, add_special_tokens=False).ids


def test_units_of_a_merge_order_file_are_merged_together(monkeypatch):
    with open(pieces.MODEL, "rb") as f:
        v = pieces.Vocabulary(f.read(), own=True)
    alone: list[str] = []
    parts = v.parts
    monkeypatch.setattr(v, "parts", lambda u: alone.append(u) or parts(u))
    library = SentencePieceProcessor(model_file=pieces.MODEL)
    texts = odd_texts()
    want = [np.array(library.encode(t), "<i4").tobytes() for t in texts]
    assert v.encode_all(texts) == want
    assert all(len(u) > pieces.CACHED_CHARS or not v.single.issuperset(u) for u in alone)
    monkeypatch.setattr(pieces, "UNITS", 50)
    assert [v.encode(t) for t in texts] == want


def test_the_driver_builds_no_tables_of_pieces_for_giant_texts(spark):
    text = "the quick brown fox " * 300
    pieces.vocabulary.cache_clear()
    got = pieces.encode(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), giant=1000, chunk=500, own=True).collect()
    assert pieces.vocabulary.cache_info().currsize == 0
    assert list(got[0].ids) == SentencePieceProcessor(model_file=pieces.MODEL).encode(text)
