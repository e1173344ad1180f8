from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from sortfolio.llm import simhash
from sortfolio.llm.graph import components
from tests.llm.conftest import documents


def plain_fingerprint(text: str | None, k: int) -> int:
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints: list[int], radius: int) -> list[set[int]]:
    left, out = set(range(len(prints))), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if bin(prints[i] ^ prints[j]).count("1") <= radius}
            left -= near
            todo += near
        out.append(group)
    return out


@pytest.mark.parametrize("text", [None, "", "A", "a b", "The cat\tsat ON the mat", "x " * 50])
@pytest.mark.parametrize("k", [3, 5])
def test_fingerprint(text, k):
    assert simhash.fingerprint(text, k) == plain_fingerprint(text, k)


def expected(rows, k, radius):
    prints = [plain_fingerprint(t, k) for _, t in rows]
    out = []
    for group in plain_classes(prints, radius):
        keys = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], f"{prints[i]:016x}", min(keys, default=None), len(group)) for i in group]
    return sorted(out, key=str)


def near_copies(words, n):
    r = random.Random(3)
    base = [r.choice(words) for _ in range(400)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((100 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("radius,crowd", [(2, 256), (2, 1), (4, 256), (4, 2)])
def test_classes_agree_with_brute_force(spark, words, odd, radius, crowd, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.PARTITIONS, crowd))
    rows = odd + near_copies(words, 60)
    got = simhash.near_duplicates(documents(spark, rows), 3, radius).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 3, radius)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, []), 3, 2).collect() == []


def test_thresholds_are_the_cheapest():
    r = np.random.default_rng(0)
    costs = r.random((3, 5, 40))
    costs[:, 0] = 0
    units = simhash.allocate(costs, 4)
    assert (units.sum(0) == 4).all()
    ways = [(a, b, 4 - a - b) for a in range(5) for b in range(5 - a)]
    for i in range(40):
        cost = lambda w: sum(costs[p, u, i] for p, u in enumerate(w))  # noqa: E731, B023
        assert cost(units[:, i]) == pytest.approx(min(map(cost, ways)))


def test_components_of_a_chain_a_star_and_a_pair(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(50)} | {299: 299, 300: 299}
