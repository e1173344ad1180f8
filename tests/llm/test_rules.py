from __future__ import annotations

import re
from collections import Counter

from sortfolio.llm import rules
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


CASES = ["a b c a b c a b", "x\nx\ny\n \n\n", "😀😀 é #*$%&|<>", "w " * 60, " lead and trail ", "a b c d", "the cat sat\nthe cat sat\nthe dog"]


def test_counts(spark, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(CASES)]
    got = rules.quality_rules(documents(spark, rows)).collect()
    want = {t: base(t) for _, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in rules.BASE) == want[r.text]
        n, repeat = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_verdicts(spark):
    clean = "The men of the town went to see what it was and then came back with some of the news that others had told them on " * 1
    clean += "a road by which they had gone out in days long past, for it is said that no one ever comes home the way they left at first"
    rows = [(1, clean), (2, " ".join(w + "***" for w in clean.split())), (3, clean.upper()), (4, " | ".join(clean.split()))]
    got = {r.doc_id: r for r in rules.quality_rules(documents(spark, rows)).collect()}
    assert got[1].kept and "too_many_symbols" in got[2].failed_rules and "shouting" in got[3].failed_rules and "bars" in got[4].failed_rules


def test_one_projection_without_user_functions(spark, odd):
    plan = rules.quality_rules(documents(spark, odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)


def test_empty_table(spark):
    assert rules.quality_rules(documents(spark, [])).collect() == []
