"""Ids of the registered query and of the merge order, against the library on the unaltered model file."""

from __future__ import annotations

import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from sortfolio.llm import pieces, queries
from tests.llm.conftest import documents


@pytest.fixture(scope="module")
def library() -> SentencePieceProcessor:
    return SentencePieceProcessor(model_file=pieces.MODEL)


def texts(n: int, size: int) -> list[str]:
    r = random.Random(6)
    parts = ["ab", "c", "the", "日本", "é", "😀", " ", "in", "ation", "\n", "xq", "  ", "...", "1984", "-", "aaaa", "▁"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, size))) for _ in range(n)]


def test_ids_are_the_librarys(library):
    with open(pieces.MODEL, "rb") as f:
        v = pieces.vocabulary(f.read(), own=True)
    for t in ["", " ", "Hello world", "a" * 3000, "ab" * 1501, *texts(500, 40), *texts(5, 4000)]:
        assert np.frombuffer(v.encode(t), np.int32).tolist() == library.encode(t)


def test_giants_are_cut_where_no_piece_runs_over(spark, library, odd):
    rows = [(1000 + i, t) for i, t in enumerate(texts(40, 200))] + [(2000, "abcdefgh" * 60)] + odd
    got = pieces.encode(documents(spark, rows), giant=12, chunk=37, own=True).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted((i or -1, tuple(library.encode(t or ""))) for i, t in rows)
    assert all(r.exact for r in got if not any("▁" in (t or "") for i, t in rows if i == r.doc_id))


def test_query_gives_the_librarys_ids(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = queries.op2_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts) > 0
    assert all(list(r.ids) == library.encode(texts[r.doc_id] or "") and r.n_pieces == len(r.ids) for r in got)
