from __future__ import annotations

import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from sortfolio.llm import pieces
from tests.llm.conftest import documents


@pytest.fixture(scope="module")
def model() -> bytes:
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def texts(n: int, size: int) -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(["ab", "c", "the", "日", "é", "😀", " ", "in", "ation", "\n", "xq", "  "]) for _ in range(r.randint(1, size))) for _ in range(n)]


def test_ids_are_the_best_segmentation(model):
    """The library's lattice solves the same pieces and scores once the file's kind is set to unigram (its fast path, ``encode``,
    does not always find the best path over such scores)."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    library, v = SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.vocabulary(model)
    total = lambda ids: sum(proto.pieces[i].score for i in ids)
    for t in ["Hello world", *(" ".join(x.replace("\n", "").replace("😀", "").replace("日", "").split()) for x in texts(200, 30))]:
        ids = np.frombuffer(v.encode(t), np.int32).tolist()
        assert not t or total(ids) == total(max(library.nbest_encode_as_ids(t, 3), key=total))
        assert v.decode(ids) == t


def test_round_trip_and_byte_pieces(model):
    v = pieces.vocabulary(model)
    for t in ["", " ", "  two  spaces ", "\n", "😀\x00", *texts(200, 30)]:
        assert v.decode(np.frombuffer(v.encode(t), np.int32).tolist()) == t
    assert np.frombuffer(v.encode("\n"), np.int32).tolist()[-1] == v.byte_ids[10]


def test_chunked_texts_equal_whole_ones(spark, model, odd):
    v = pieces.vocabulary(model)
    rows = [(1000 + i, t) for i, t in enumerate(texts(30, 200))] + [(2000, "abcdefgh" * 60)] + [r for r in odd if r[0] != 7]
    got = pieces.encode(documents(spark, rows), giant=12, chunk=37).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted(
        (i or -1, tuple(np.frombuffer(v.encode(t or ""), np.int32).tolist())) for i, t in rows)
    assert all(r.exact for r in got)


def test_decode_inverts_encode(spark, odd):
    docs = documents(spark, odd)
    back = pieces.decode(pieces.encode(docs)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in odd)


def test_prefix_products_are_products_in_order():
    r = np.random.default_rng(1)
    m = r.random((9, 4, 4))
    want = m[0]
    for i, got in enumerate(pieces.prefix_products(m)):
        if i:
            want = pieces.product(want[None], m[i : i + 1])[0]
        assert np.allclose(got, want)


def test_empty_table(spark):
    assert pieces.encode(documents(spark, [])).collect() == []


@pytest.mark.parametrize("own", [False, True])
def test_exactness_is_that_of_decoding(model, own):
    """Told from the units, without decoding each text; pieces that don't spell their unit are found out."""
    v = pieces.Vocabulary(model, own)
    odd = ["", " ", "▁", "a▁b", "\x00", "x" * 100, *texts(200, 30)]

    def agree() -> list[bool]:
        got = [v.exact(t, v.encode(t)) for t in odd]
        assert got == [v.decode(np.frombuffer(v.encode(t), np.int32).tolist()) == t for t in odd]
        return got

    assert [t for t, e in zip(odd, agree()) if not e] == ["▁", "a▁b"] and not v.lossy
    v.byte_ids = [v.byte_ids[0]] * 256
    v.known.clear()
    assert not all(agree()[5:]) and v.lossy
