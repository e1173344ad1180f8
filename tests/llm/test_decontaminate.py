from __future__ import annotations

import random

import pytest

from sortfolio.llm import decontaminate
from tests.llm.conftest import documents


def items(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, words string")


@pytest.fixture(scope="module")
def bench(words):
    r = random.Random(8)
    long = [(i, " ".join(r.choices(words, k=r.randint(9, 40)))) for i in range(12)]
    return long + [(50, None), (51, "..."), (52, "One"), (53, "same WORDS"), (54, long[0][1]), (54, long[0][1]), (55, " ".join(long[1][1].split()[3:20]))]


def test_agrees_with_brute_force(spark, words, odd, bench):
    r = random.Random(1)
    rows = list(odd)
    for i in range(80):
        w = r.choices(words, k=r.randint(0, 60))
        if i % 3:
            cut = (bench[r.randrange(12)][1]).split()
            a = r.randrange(len(cut))
            at = r.randint(0, len(w))
            w[at:at] = cut[a : a + r.randint(1, 25)]
        rows.append((100 + i, ", ".join(w).title() if i % 2 else " ".join(w)))
    got = decontaminate.contaminated_words(documents(spark, rows), items(spark, bench)).collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted(decontaminate.brute_force(rows, bench), key=str)
    assert 10 < sum(x.contaminated for x in got) < len(rows)


def test_empty_tables(spark, odd, bench):
    assert decontaminate.contaminated_words(documents(spark, []), items(spark, bench)).collect() == []
    got = decontaminate.contaminated_words(documents(spark, odd), items(spark, [])).collect()
    assert len(got) == len(odd) and not any(r.contaminated for r in got)
