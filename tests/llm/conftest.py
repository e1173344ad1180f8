from __future__ import annotations

import random

import pytest

NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, n_words bigint, fp bigint"


def documents(spark, texts: list[tuple[int | None, str | None]]):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src0", len(t) if t else None, 1, -1, 7) for i, t in texts]
    return spark.createDataFrame(rows, NAMES)


@pytest.fixture(scope="session")
def words() -> list[str]:
    r = random.Random(7)
    return ["".join(r.choice(["th", "er", "on", "an", "re", "é", "ß", "st"]) for _ in range(r.randint(1, 4))) for _ in range(300)]


@pytest.fixture(scope="session")
def odd() -> list[tuple[int | None, str | None]]:
    """Null, empty, blank, repeated, very long and null-key texts."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same words here and there"), (6, "same words here and there"),
            (6, "same words here and there"), (7, "long " * 20000), (None, "no key at all"), (8, "日本語 テキスト 😀")]
