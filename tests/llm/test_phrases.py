"""Automata against dictionaries, and phrases against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from sortfolio.llm import automata, phrases
from sortfolio.llm.automata import Depth, Paths

SCHEMA = "doc_id bigint, text string, lang string, n bigint, range int, phrase string, rank int"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows: list[tuple], longest: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> list[tuple]:
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + k] for g, a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= share * counts[g[i : i + k]]}
        scored = []
        for g, a in found.items():
            if g not in gone:
                cuts = [(1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
                value, k = min(cuts)
                scored.append((-value, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (value, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -value))
    return sorted(out)


def taken(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "É", "日本", "a\x00b", "-", "x y", "in", "state"]
    out = []
    for i in range(n):
        parts = [r.choice(words + ["new york", "New York city"]) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "; "]) for _ in range(r.randint(0, 60))]
        out.append((i, "".join(parts), r.choice(["en", "en", "en", "fr", None, "und", ""])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2, "p", 3) for x in rows], SCHEMA)


def test_phrases_equal_brute_force(spark):
    rows = corpus(300) + [(1, None, "en"), (1, "", None), (2, " . \n", "fr"), (3, "word " * 30000, "de"), (None, "no key " * 20, "xx"), *[(9, "same words again", "en")] * 40]
    df = frame(spark, rows)
    for options in ({}, {"range_bytes": 500, "range_grams": 20, "shard": 2000}, {"top": 5, "share": 20, "least": 2}, {"longest": 4, "range_bytes": 900, "range_grams": 30, "shard": 900}):
        own = {k: v for k, v in options.items() if k in ("top", "share", "least", "longest")}
        got = taken(phrases.phrases(df.repartition(7), **options))
        assert got == brute_force(rows, **own) and len(got) > 5


def test_first_of_each_language_by_parts(spark):
    rows = [("en" if i % 3 else "fr", f"p {i:03}", 10 + i % 4, 20, 20, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")
    got = sorted((r.lang, r.rank, r.phrase) for r in phrases._first(df, 7, 300).collect())
    want = []
    for lang in ("en", "fr"):
        best = sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[5], -x[2], x[1]))[:7]
        want += [(lang, k, x[1]) for k, x in enumerate(best, 1)]
    assert got == want


def test_no_rows_and_rows_without_words(spark):
    assert taken(phrases.phrases(frame(spark, []))) == []
    assert taken(phrases.phrases(frame(spark, [(1, None, None), (2, "...", "en")]))) == []


def test_scores_beyond_64_bits():
    a, left, right = np.array([3 << 40, 5]), np.array([7 << 41, 9]), np.array([5 << 42, 6])
    assert phrases.score(a, left, right).tolist() == [1000000 * (3 << 40) ** 2 // ((7 << 41) * (5 << 42)), 1000000 * 25 // 54]


def paths(counts: dict, depth: int = 3) -> Paths:
    words, _ = automata.ordered(pa.array(sorted({w for g in counts for w in g}), pa.large_binary()))
    number, depths, before = {w: i for i, w in enumerate(words.to_pylist())}, [], {(): 0}
    for k in range(1, depth + 1):
        found = sorted({tuple(number[w] for w in g[:k]) for g in counts if len(g) >= k})
        weight = [counts.get(tuple(words[i].as_py() for i in p), 0) for p in found]
        depths.append(Depth(*(np.array(x, np.int64) for x in ([before[p[:-1]] for p in found], [p[-1] for p in found], weight))))
        before = {p: i for i, p in enumerate(found)}
    return Paths(words, depths)


def read(p: Paths) -> dict:
    out = {}
    for k, d in enumerate(p.depths):
        for *gram, n in zip(*p.word_of(k, np.arange(len(d.word))), d.weight.tolist()):
            if n:
                out[tuple(p.words[int(w)].as_py() for w in gram)] = n
    return out


def test_automata_equal_dictionaries():
    r = random.Random(2)
    words = [b"a", b"ab", b"b", "é".encode(), b"z", b""]

    def counts(n: int) -> dict:
        c = Counter(tuple(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n))
        return {g: r.choice([1 << 19, 1 << 21, 1 << 40]) if r.random() < 0.1 else v for g, v in c.items()}

    for _ in range(250):
        c = counts(r.randint(1, 60))
        p = paths(c)
        assert read(p) == c == read(automata.from_bytes(automata.to_bytes(p)))
        bounds = sorted({tuple(r.choice([*words, b"aa", b"q"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 5))})
        parts = p.split(bounds)
        for i, part in parts:
            assert all((i == 0 or bounds[i - 1] <= g) and (i == len(bounds) or g < bounds[i]) for g in read(part))
        assert read(automata.union([automata.from_bytes(automata.to_bytes(part)) for _, part in parts])) == c
        others = [counts(r.randint(1, 30)) for _ in range(3)]
        whole, total = automata.union([paths(x) for x in others]), Counter()
        for x in others:
            total.update(x)
        assert read(whole) == dict(total)
        for k, (d, found) in enumerate(zip(p.depths, automata.composed(p, whole))):
            grams = [tuple(p.words[int(w)].as_py() for w in g) for g in zip(*p.word_of(k, np.arange(len(d.word))))]
            assert found.tolist() == [total.get(g, 0) for g in grams]
        assert read(p.kept([d.weight >= 2 for d in p.depths])) == {g: n for g, n in c.items() if n >= 2}


def test_states_with_the_same_only_arc_are_one():
    """A thousand different phrases with one end need hardly more room than their first words."""
    same = automata.to_bytes(paths({(f"w{i:04}".encode(), b"the", b"end"): 1 for i in range(1000)}))
    apart = automata.to_bytes(paths({(f"w{i:04}".encode(), b"the", f"e{i * 7919 % 1000:04}".encode()): 1 for i in range(1000)}))
    assert len(same) < 0.6 * len(apart)
