from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from sortfolio.llm import pii
from tests.llm.conftest import documents

TEXTS = [
    (20, "Call +1 (499) 555-6503 or +1 499 555 6503, mail Bob.Lee@Mail.example.com!"),
    (21, "Mr. John Smith met Mrs. Smith and Dr. Anna Smith. г-жа Ольга Петрова"),
    (22, "card 4111 1111 1111 1111 and 4785380592391139$$$ ip 152.143.123.131!! DE89370400440532013000 ssn 123-45-6789"),
    (23, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###'),
    (24, "bob.lee@mail.example.com x bob2@mail.example.com, twice bob2@mail.example.com"),
    (25, "clean text 1234 and v1.2.3, 5 * 6 = 30"),
]


def luhn(x: str) -> bool:
    d = [int(c) for c in x if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * c, 10)) for c in d[1::2]]) % 10 == 0


@pytest.fixture(scope="module")
def done(spark, odd):
    return {r.doc_id: r for r in pii.replace_pii(documents(spark, TEXTS + odd)).collect()}


def test_clean_and_odd_texts_stay(done, odd):
    for i, t in [*odd, TEXTS[-1]]:
        assert (done[i].text, done[i].n_entities) == (t, 0)


def test_formats_and_coreference(done):
    a = re.match(r"^Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4}), mail ([\w.]+@\w+\.\w+\.com)!$", done[20].text)
    assert a and a.groups()[:3] == a.groups()[3:6] and "4995556503" != "".join(a.groups()[:3])
    assert done[24].text.split()[0] == a[7].lower() and done[24].text.split()[2].rstrip(",") == done[24].text.split()[4]
    names = re.match(r"^Mr\. (\w+) (\w+) met Mrs\. (\w+) and Dr\. (\w+) (\w+)\. г-жа (\w+) (\w+)$", done[21].text)
    assert names and names[2] == names[3] == names[5] != "Smith"
    assert names[1] in pii.GIVEN["latin", "m"] and names[4] in pii.GIVEN["latin", "f"] and names[6] in pii.GIVEN["cyrillic", "f"]
    card, other, iban = re.match(r"^card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})\$\$\$ ip [\d.]+!! (DE\d{20}) ssn \d{3}-\d\d-\d{4}$", done[22].text).groups()
    assert luhn(card) and luhn(other) == luhn("4785380592391139") and card[0] == "4"
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert re.match(r'^token = "[0-9a-f]{40}"###$', done[23].text) and "24be" not in done[23].text


def test_surrogates_are_distinct_and_no_real_values(spark):
    """26 one-letter mailboxes leave no room: surrogates grow until all differ."""
    values = [("mailbox", c) for c in "abcdefghijklmnopqrstuvwxyz"] + [("ip", f"1.1.1.{i}") for i in range(1, 10)]
    values += [(f"given:latin:{g}", n) for g in "mf" for n in pii.GIVEN["latin", "m"]]
    got = pii.distinct_surrogates(spark.createDataFrame(values, "type string, value string"), "k").collect()
    assert len({(r.type, r.surrogate) for r in got}) == len(values) == len(got)
    real = set(values)
    assert not [r for r in got if (r.type, r.surrogate) in real]


def test_no_python_in_the_plan(spark):
    plan = pii.replace_pii(documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_another_key_gives_other_surrogates(spark):
    docs = documents(spark, TEXTS)
    a, b = (pii.replace_pii(docs, key=k).where(F.col("doc_id") == 23).first().text for k in ("a", "b"))
    assert a != b


def test_empty_table(spark):
    assert pii.replace_pii(documents(spark, [])).collect() == []


# --- the whole operator in plain Python -------------------------------------------------------

def byte(seed: str, i: int) -> int:
    return hashlib.sha256(f"{seed}|{i // 32}".encode()).digest()[i % 32]


def drawn(value: str, seed: str, hexed: str = "") -> str:
    """``hexed``: the letters of a hexadecimal number's case."""
    out = ""
    for i, c in enumerate(value):
        b = byte(seed, i)
        if c in "0123456789":
            of = "123456789" if i == 0 and c != "0" else "0123456789" + hexed
        elif "a" <= c <= "z":
            of = "0123456789" + hexed if hexed and hexed.islower() else "abcdefghijklmnopqrstuvwxyz"
        elif "A" <= c <= "Z":
            of = "0123456789" + hexed if hexed and hexed.isupper() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        else:
            of = c
        out += of[b % len(of)]
    return out


def luhn_sum(x: str) -> int:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(x[::-1])) % 10


def plain_surrogate(kind: str, value: str, tries: int, key: str) -> str:
    seed, more = hashlib.sha256("|".join([key, kind, value, str(tries)]).encode()).hexdigest(), max(0, tries - 7)
    if kind.startswith("given:"):
        names = pii.GIVEN[tuple(kind.split(":")[1:])]
        return "-".join(names[byte(seed, i) % len(names)] for i in range(more + 1))
    if kind.startswith("surname:"):
        parts = pii.SYLLABLES[kind.split(":")[1]]
        return "".join(parts[byte(seed, i) % len(parts)] for i in range(1, 3 + byte(seed, 0) % 2 + more)).capitalize()
    if kind == "ip":
        numbers = []
        for i, x in enumerate(value.split(".")):
            b = byte(seed, 2 * i) * 256 + byte(seed, 2 * i + 1)
            numbers.append(b % 254 + 1 if more else b % 9 + 1 if len(x) == 1 else b % 90 + 10 if len(x) == 2 else b % 155 + 100)
        return ".".join(map(str, numbers))
    if kind == "domain":
        host, top = value.rsplit(".", 1)
        return drawn(host + "x" * more, seed) + "." + top
    hexed = ("abcdef" if re.fullmatch("[a-f0-9]+", value) else "ABCDEF" if re.fullmatch("[A-F0-9]+", value) else "") if kind == "secret" else ""
    longer = value + "0" * more
    new = drawn(longer, seed, hexed)
    if kind == "card":
        body = longer[0] + new[1:-1]
        check = (10 - luhn_sum(body + "0")) % 10
        return body + str(check if luhn_sum(longer) == 0 else (check + 1 + int(new[-1]) % 9) % 10)
    if kind == "iban":
        rest = 0
        for c in new[4:] + value[:2] + "00":
            rest = (rest * 10 + int(c)) % 97 if c.isdigit() else (rest * 100 + ord(c) - 55) % 97
        return value[:2] + f"{98 - rest:02}" + new[4:]
    return value[0] + new[1:] if kind == "phone" else new


TITLES = rf"(?:{pii._MALE}|{pii._FEMALE}|Dr|Prof)"


def kind(found: str) -> str:
    return next((k for k, p in pii.PATTERNS.items() if k != "person" and regex.fullmatch(p, found)), "person")


def entities(found: str) -> list[tuple[str, str]]:
    k = kind(found)
    if k == "email":
        return [("mailbox", found.split("@")[0].lower()), ("domain", found.split("@")[1].lower())]
    if k in ("ip", "secret"):
        return [(k, found)]
    if k != "person":
        return [(k, re.sub("[^A-Za-z0-9]", "", found))]
    *given, last = found.split(" ")[1:]
    script = lambda x: "cyrillic" if regex.search(r"\p{Cyrillic}", x) else "greek" if regex.search(r"\p{Greek}", x) else "latin"

    def gender(x: str) -> str:
        for g, titles in (("f", pii._FEMALE), ("m", pii._MALE)):
            if re.match(rf"(?:{titles})\.? ", found):
                return g
        own = [g for g in "fm" if any(x in names for (_, of), names in pii.GIVEN.items() if of == g)]
        return own[0] if own else "f" if x[-1] in "aаα" else "m"

    return [(f"given:{script(x)}:{gender(x)}", x) for x in given] + [(f"surname:{script(last)}", last)]


def written(found: str, parts: list[str]) -> str:
    k = kind(found)
    if k == "person":
        return " ".join([found.split(" ")[0], *parts])
    if k == "email":
        box = found.split("@")[0]
        return (parts[0] if box == box.lower() else parts[0].upper() if box == box.upper() else parts[0].capitalize()) + "@" + parts[1]
    if k in ("ip", "secret"):
        return parts[0]
    left = list(parts[0])
    out = "".join(c if not re.match("[A-Za-z0-9]", c) else left.pop(0).upper() if c.isupper() else left.pop(0) for c in found)
    return out + "".join(left)


def plain_replace(texts: list[str], key: str = pii.KEY) -> list[str]:
    found = [[m[0] for m in regex.finditer(pii.PATTERN, t)] for t in texts]
    by_type = defaultdict(set)
    for f in {x for fs in found for x in fs}:
        for k, v in entities(f):
            by_type[k].add(v)
    table = {}
    for k, values in by_type.items():
        tries = dict.fromkeys(values, 0)
        now = {v: plain_surrogate(k, v, 0, key) for v in values}
        while True:
            first = {}
            for v, s in now.items():
                first[s] = min(first.get(s, v), v)
            again = [v for v, s in now.items() if s in values or first[s] != v]
            if not again:
                break
            for v in again:
                tries[v] += 1
                now[v] = plain_surrogate(k, v, tries[v], key)
        table |= {(k, v): s for v, s in now.items()}
    out = []
    for t, fs in zip(texts, found):
        new = {f: written(f, [table[e] for e in entities(f)]) for f in fs}
        bare: dict[str, str] = {}
        for f in fs:
            if kind(f) == "person":
                a, b = f.split(" ")[1:], new[f].split(" ")[1:]
                for x, y in ((a, b), (a[:2], b[:2]), (a[-1:], b[-1:])):
                    name = " ".join(x)
                    if name not in new and not regex.search(rf"(?<!\p{{L}}){TITLES}(?!\p{{L}})", name):
                        bare[name] = min(bare.get(name, " ".join(y)), " ".join(y))
        pattern = pii.PATTERN
        if bare:
            pattern += r"|(?<!\p{L})(?:" + "|".join(sorted(bare, key=lambda n: (-len(n), n))) + r")(?!\p{L})"
        out.append(regex.sub(pattern, lambda m: (new | bare).get(m[0], m[0]), t))
    return out


def test_plain_version_agrees(spark):
    r = random.Random(12)
    names = ["John Smith", "Anna Smith", "Kim O'Neil", "Ольга Петрова", "Ελένη Παππά", "Jean-Luc Martin", "Li"]
    hexed = lambda n, of: "".join(r.choice(of) for _ in range(n))

    def piece() -> str:
        n = r.choice(names)
        return r.choice([
            f"{r.choice(['Mr.', 'Mrs.', 'Dr.', 'Frau', 'Sir'])} {n}", n, n.split(" ")[-1], f"{r.choice('abc')}{r.randint(0, 9)}@Mail{r.randint(0, 3)}.example.com",
            f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 1099)}", f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}",
            f"10.{r.randint(0, 255)}.3.{r.randint(0, 99)}", "4111 1111 1111 1111", f"{r.randint(4 * 10 ** 15, 5 * 10 ** 15)}", "DE89370400440532013000",
            f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", hexed(40, "0123456789abcdef"), hexed(32, "0123456789ABCDEF"),
            hexed(150, "0123456789abcdef"), "sk_live_" + hexed(120, "abcXYZ019"), "AKIA" + hexed(16, "ABC019"), "came home.", "in v1.2.3,", "x@b..", "the"])

    texts = [" ".join(piece() for _ in range(r.randint(1, 25))) for _ in range(200)]
    got = {x.doc_id: x.text for x in pii.replace_pii(documents(spark, list(enumerate(texts)))).collect()}
    want = plain_replace(texts)
    assert [got[i] for i in range(200)] == want
    assert sum(a != b for a, b in zip(texts, want)) > 150


def test_untitled_mentions_of_a_found_name_go_too(spark):
    rows = [(1, "Mr. John Smith came. Smith left with John Smith. Smithson and Goldsmith stayed."), (2, "Mr. John Paul Smith and John Paul."), (3, "John Smith alone")]
    got = {x.doc_id: x.text for x in pii.replace_pii(documents(spark, rows)).collect()}
    new = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) left with (\w+) (\w+)\. Smithson and Goldsmith stayed\.", got[1])
    assert new and new[2] == new[3] == new[5] and new[1] == new[4] and "John" not in got[1] and not re.search(r"\bSmith\b", got[1])
    assert not re.search("John|Paul|Smith", got[2]) and got[3] == "John Smith alone"


def test_repeated_parts_of_any_length(spark):
    """Each repeated part of the patterns 200,000 times; a recursive match would end the whole JVM."""
    n = 200_000
    rows = [(1, "Mr. " + "A-" * n + "A."), (2, "x@" + "b." * n + "com"), (3, "a" * n + "1" + "b" * n), (4, "A1" * n), (5, "sk_" + "a_" * n + "b"), (6, "x." * n + "y@mail.com"),
            (7, "Mrs. B" + "a'" * n), (8, "Dr. " + "Ж" * n), (9, "1." * n), (10, "+1 " + "23 " * n), (11, "12-" * n), (12, "Mr. " * n), (13, "a@" * n), (14, "DE12 " + "ABCD " * n)]
    got = {x.doc_id: x for x in pii.replace_pii(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 7, 8):
        assert got[i].n_entities == 1 and got[i].text != rows[i - 1][1]
    assert re.fullmatch("[0-9A-F]+", got[4].text) and re.fullmatch("[0-9a-f]+", got[3].text) and len(got[4].text) == 2 * n


def test_secrets_of_any_length_and_case(spark):
    rows = [(1, "key " + "0F" * 20 + "."), (2, "key " + "ab1" * 60), (3, "ghp_" + "Ab_9" * 80)]
    for x in pii.replace_pii(documents(spark, rows)).collect():
        assert x.n_entities == 1 and len(x.text) == len(rows[x.doc_id - 1][1]) and x.text[:3] == rows[x.doc_id - 1][1][:3] or x.doc_id == 3
