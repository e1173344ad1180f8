"""Personal data: detection and keyed, type-consistent surrogates, in DataFrame functions only.

1. Detection is one pattern (``PATTERN``): e-mail addresses, secrets, IBANs, IPv4 addresses, card and social security numbers,
   telephone numbers, and names after a title. A document's own names are then looked for without a title too: the full name, and the surname.
2. Each distinct finding is cut into entities: an address has its mailbox and its domain, a name its given names and surname. An
   entity is known by its type and its canonical value (digits, lower case), so that spellings of one number are one entity.
3. An entity's surrogate follows from a secret key, its type, its value and a number of tries: digits become digits, letters
   letters, hexadecimal stays so; a card keeps its network digit and its Luhn status, an IBAN its country and valid check digits, a
   telephone number its country code, a domain its top level; given names keep gender and script, surnames the script.
4. Collision checks: while two entities of a type have one surrogate, or a surrogate is a real value of that type, all but the
   smallest try again; from the eighth try on surrogates grow longer, so that this ends. Distinct entities stay distinct, and the
   same entity has the same surrogate in every document.
5. Each occurrence is written in its own format: the surrogate's characters fill its places, punctuation and case stay.

Only distinct findings are joined with entities; documents meet their replacements by the hash of the text, and texts without
findings are never shuffled. Everything of unbounded length is matched by one character class or by a possessive group, which Java's
matcher goes through in a loop; other repeated groups would recurse.

Defined cases: a null text stays null, an empty one empty; repeated rows are replaced alike; very long texts and findings are one row; an empty
table stays empty; other columns pass through untouched, and ``n_entities`` replaces a column of that name. Where a text gives one
full name two titles of different gender, its untitled mentions take the first surrogate in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.llm.rules import let
from sortfolio.llm.storage import land

KEY = "surrogate-key"
_MALE = r"Mr|Mister|Sir|Herrn?|Monsieur|Señor|Sr|Господин|г-н|Κύριος"
_FEMALE = r"Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Srta|Госпожа|г-жа|Κυρία"
_NAME = r"\p{Lu}[\p{L}'’]*+(?:-\p{Lu}[\p{L}'’]*+)*+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=[A-Za-z0-9-])\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?=[a-f]*+[0-9])[a-f0-9]{32,}+|(?=[A-F]*+[0-9])[A-F0-9]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho)_[A-Za-z0-9_]{16,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z+])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
             r"|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "person": rf"(?=[MSHDPFГгΚ])(?<![\p{{L}}])(?:{_MALE}|{_FEMALE}|Dr|Prof)\.? {_NAME}(?: {_NAME}){{0,2}}(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLED = rf"(?=[MSHDPFГгΚ])(?<!\p{{L}})(?:{_MALE}|{_FEMALE}|Dr|Prof)\.? \p{{Lu}}"

#: Given names of surrogates by script and gender (fixed values).
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carlos Daniel Emil Felix Gustav Henri Ivan Jonas Karl Lucas Martin Noel Oscar Paul".split(),
    ("latin", "f"): "Alice Bianca Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olivia Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина Раиса София".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λάμπρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Θεοδώρα Κατερίνα Μαρία".split(),
}
#: Syllables of surrogate surnames by script (fixed values).
SYLLABLES = {
    "latin": "ba be bo da de di fa fe ga go ha ka ke la le li lo ma me mo na ne no pa pe ra re ri ro sa se so ta te to va ve wa we".split(),
    "cyrillic": "ба бо ва ве га го да де жа за ка ко ла ле ли ма ме мо на но па пе ра ро са се та то".split(),
    "greek": "βα γα γο δα δε ζα κα κο λα λε μα με να νο πα πε ρα ρο σα σε τα το φα φι".split(),
}


def has_findings(text: Column) -> Column:
    """Whether a text holds a finding; a null text holds none.

    Every pattern needs a digit, an ``@``, a key's mark or a title, which is tested first: most texts have none of them.
    """
    may = text.rlike("[0-9@]") | text.contains("_") | text.contains("AKIA") | text.rlike(_TITLED)
    return F.coalesce(may & text.rlike(PATTERN), F.lit(False))


def detected(text: Column) -> Column:
    """All findings of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind_of(found: Column) -> Column:
    """A finding's type."""
    out = F.lit("person")
    for name in reversed([k for k in PATTERNS if k != "person"]):
        out = F.when(found.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(found: Column, given: Column) -> Column:
    """From the title, else from a known given name, else from its ending."""
    known = {g: [n for (_, x), names in GIVEN.items() if x == g for n in names] for g in "mf"}
    return (F.when(found.rlike(rf"^(?:{_FEMALE})\.? "), "f").when(found.rlike(rf"^(?:{_MALE})\.? "), "m")
            .when(given.isin(known["f"]), "f").when(given.isin(known["m"]), "m")
            .when(given.rlike("[aаα]$"), "f").otherwise("m"))


def entities_of(found: Column, kind: Column) -> Column:
    """The finding's entities in order: ``(type, value)``; a type may carry gender and script."""
    one = lambda t, v: F.struct(t.alias("type"), v.alias("value"))
    alnum = F.regexp_replace(found, "[^A-Za-z0-9]", "")
    names = F.slice(F.split(found, " "), 2, 9)  # after the title

    def person(n: Column) -> Column:
        return F.transform(n, lambda x, i: F.when(i == F.size(n) - 1, one(F.concat(F.lit("surname:"), _script(x)), x)).otherwise(
            one(F.concat(F.lit("given:"), _script(x), F.lit(":"), _gender(found, x)), x)))

    return (F.when(kind == "person", let(names, person))
            .when(kind == "email", F.array(one(F.lit("mailbox"), F.lower(F.substring_index(found, "@", 1))),
                                           one(F.lit("domain"), F.lower(F.substring_index(found, "@", -1)))))
            .when(kind.isin("ip", "secret"), F.array(one(kind, found)))
            .otherwise(F.array(one(kind, alnum))))


def _byte(seed: Column, i: Column) -> Column:
    """Byte ``i`` of the keyed stream of a seed."""
    block = F.sha2(F.concat_ws("|", seed, (i / 32).cast("int").cast("string")), 256)
    return F.conv(F.substring(block, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _from(text: str, i: Column) -> Column:
    return F.substring(F.lit(text), (i % len(text) + 1).cast("int"), F.lit(1))


def _drawn(value: Column, seed: Column, lower_hex: Column, upper_hex: Column) -> Column:
    """Each digit and letter replaced by one of its class; a leading digit other than 0 stays other than 0."""
    def char(c: Column, i: Column) -> Column:
        b = _byte(seed, i)
        return (F.when(c.rlike("[0-9]"), F.when((i == 0) & (c != "0"), _from("123456789", b)).when(lower_hex, _from("0123456789abcdef", b))
                       .when(upper_hex, _from("0123456789ABCDEF", b)).otherwise(_from("0123456789", b)))
                .when(c.rlike("[a-z]"), F.when(lower_hex, _from("0123456789abcdef", b)).otherwise(_from("abcdefghijklmnopqrstuvwxyz", b)))
                .when(c.rlike("[A-Z]"), F.when(upper_hex, _from("0123456789ABCDEF", b)).otherwise(_from("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))).otherwise(c))

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), char), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    reversed_ = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(reversed_, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10)), F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, drawn: Column) -> Column:
    body = F.concat(F.substring(value, 1, 1), F.substring(drawn, F.lit(2), F.length(drawn) - 2))
    check = lambda b: (F.lit(10) - _luhn(F.concat(b, F.lit("0")))) % 10
    valid = _luhn(value) == 0
    wrong = (check(body) + 1 + F.substring(drawn, -1, 1).cast("int") % 9) % 10
    return F.concat(body, F.when(valid, check(body)).otherwise(wrong).cast("int").cast("string"))


def _iban(value: Column, drawn: Column) -> Column:
    country, body = F.substring(value, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    digits = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    rest = F.aggregate(digits, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise(
        (a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _picker(names: list[str], seed: Column):
    """Function from a place in the seed's keyed stream to one of the names."""
    return lambda i: F.element_at(F.array(*[F.lit(n) for n in names]), (_byte(seed, i) % len(names) + 1).cast("int"))


def surrogate(kind: Column, value: Column, tries: Column, key: str) -> Column:
    """The surrogate of an entity at its ``tries``-th try; what looks at the whole value is bound once, not for each character."""
    secret = kind == "secret"
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, tries.cast("string")), 256)  # short, however long the value
    bound = F.struct(seed.alias("seed"), (secret & value.rlike("^[a-f0-9]+$")).alias("lower"), (secret & value.rlike("^[A-F0-9]+$")).alias("upper"))
    return let(bound, lambda b: _surrogate(kind, value, tries, b["seed"], b["lower"], b["upper"]))


def _surrogate(kind: Column, value: Column, tries: Column, seed: Column, lower_hex: Column, upper_hex: Column) -> Column:
    more = F.greatest(F.lit(0), tries - 7)  # longer from the eighth try on
    longer = F.concat(value, F.repeat(F.lit("0"), more))
    drawn = _drawn(longer, seed, lower_hex, upper_hex)
    octet = lambda x, i: let(_byte(seed, 2 * i) * 256 + _byte(seed, 2 * i + 1), lambda b: (
        F.when((F.length(x) == 1) & (more == 0), b % 9 + 1).when((F.length(x) == 2) & (more == 0), b % 90 + 10)
        .when(more == 0, b % 155 + 100).otherwise(b % 254 + 1)).cast("int").cast("string"))
    ip = F.array_join(F.transform(F.split(value, r"\."), octet), ".")
    domain = F.concat(_drawn(F.concat(F.regexp_extract(value, r"^(.*)\.[^.]+$", 1), F.repeat(F.lit("x"), more)), seed, F.lit(False), F.lit(False)),
                      F.lit("."), F.substring_index(value, ".", -1))
    # the country code's digits (one or the "+" group) can't be told from bare digits: the first one stays
    phone = F.concat(F.substring(value, 1, 1), F.substring(drawn, F.lit(2), F.length(drawn)))
    out = (F.when(kind == "ip", ip).when(kind == "domain", domain).when(kind == "card", _card(longer, drawn))
           .when(kind == "iban", _iban(value, drawn)).when(kind == "phone", phone).otherwise(drawn))
    for (script, gender), names in GIVEN.items():
        parts = F.transform(F.sequence(F.lit(0), more), _picker(names, seed))
        out = F.when(kind == f"given:{script}:{gender}", F.array_join(parts, "-")).otherwise(out)
    for script, parts in SYLLABLES.items():
        count = 2 + _byte(seed, F.lit(0)) % 2 + more
        name = F.array_join(F.transform(F.sequence(F.lit(1), count), _picker(parts, seed)), "")
        out = F.when(kind == f"surname:{script}", F.initcap(name)).otherwise(out)
    return out


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``(type, value, surrogate)`` of the distinct entities, all surrogates of a type distinct and none a real value."""
    now = land(entities.select("type", "value", F.lit(0).alias("tries"))
               .withColumn("surrogate", surrogate(F.col("type"), F.col("value"), F.col("tries"), key)), "surrogates")
    real = now.select("type", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    while True:
        first = now.groupBy("type", "surrogate").agg(F.min("value").alias("first"), F.count("*").alias("n"))
        clash = land(first.join(real, ["type", "surrogate"], "left").where((F.col("n") > 1) | F.col("real"))
                     .select("type", "surrogate", "first", F.coalesce("real", F.lit(False)).alias("real")), "clashes")
        if clash.isEmpty():
            return now.drop("tries")
        again = now.join(clash, ["type", "surrogate"], "left")
        retry = F.coalesce(F.col("real") | (F.col("first") != F.col("value")), F.lit(False))
        tries = F.when(retry, F.col("tries") + 1).otherwise(F.col("tries"))
        now = land(again.select("type", "value", tries.alias("tries"), "surrogate", retry.alias("retry"))
                   .withColumn("surrogate", F.when(F.col("retry"), surrogate(F.col("type"), F.col("value"), F.col("tries"), key))
                               .otherwise(F.col("surrogate"))).drop("retry"), "surrogates")


def written_as(found: Column, kind: Column, parts: Column) -> Column:
    """A finding's replacement: the surrogates' characters at its places, in its punctuation and case."""
    def filled(shape: Column, value: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            place = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
            new = F.substring(value, place, F.lit(1))
            return F.when(~c.rlike("[A-Za-z0-9]"), c).when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)

        rest = F.substring(value, F.length(F.regexp_replace(shape, "[^A-Za-z0-9]", "")) + 1, F.length(value))
        return F.concat(F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), char), ""), rest)

    def mailbox(value: Column) -> Column:
        local = F.substring_index(found, "@", 1)
        return F.when(local == F.lower(local), value).when(local == F.upper(local), F.upper(value)).otherwise(F.initcap(value))

    return (F.when(kind == "person", F.concat_ws(" ", F.substring_index(found, " ", 1), F.array_join(parts, " ")))
            .when(kind == "email", F.concat(mailbox(parts[0]), F.lit("@"), parts[1]))
            .when(kind.isin("ip", "secret"), parts[0]).otherwise(filled(found, parts[0])))


def replacements(findings: DataFrame, key: str = KEY) -> DataFrame:
    """``(found, kind, new)`` of distinct findings ``(found)``."""
    typed = land(findings.withColumn("kind", kind_of(F.col("found"))), "findings")
    parts = land(typed.select("found", F.posexplode(entities_of(F.col("found"), F.col("kind"))).alias("place", "e"))
                 .select("found", "place", "e.type", "e.value"), "parts")
    table = distinct_surrogates(parts.select("type", "value").distinct(), key)
    gathered = parts.join(table, ["type", "value"]).groupBy("found").agg(
        F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("p"))
    return land(typed.join(gathered, "found").select("found", "kind", written_as(
        F.col("found"), F.col("kind"), F.transform("p", lambda x: x["surrogate"])).alias("new")), "replacements")


def _untitled(found: Column, new: Column) -> Column:
    """What a titled name's document may call it without the title, with the replacements: the full name, its first two parts, the surname.

    A name that holds a title's word is left out, as that word may begin another finding.
    """
    rest = lambda x: F.substring(x, F.length(F.substring_index(x, " ", 1)) + 2, F.length(x))
    parts = [rest, lambda x: F.substring_index(rest(x), " ", 2), lambda x: F.substring_index(x, " ", -1)]
    pairs = F.array(*[F.struct(part(found).alias("found"), part(new).alias("new"), F.lit(True).alias("bare")) for part in parts])
    return F.filter(pairs, lambda x: ~x["found"].rlike(rf"(?<!\p{{L}})(?:{_MALE}|{_FEMALE}|Dr|Prof)(?!\p{{L}})"))


def replace_pii(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with every finding in the text replaced, and ``n_entities``, the number of findings."""
    names = [c for c in docs.columns if c != "n_entities"]
    found = has_findings(F.col(text))
    hit = land(docs.select(*[F.col(f"`{c}`") for c in names]).where(found)
               .withColumn("__found", detected(F.col(text))).withColumn("__key", F.sha2(text, 256)), "hits")
    each = hit.select("__key", F.explode("__found").alias("found")).distinct()
    table = replacements(hit.select(F.explode("__found").alias("found")).distinct(), key)
    whole = F.array(F.struct("found", "new", F.lit(False).alias("bare")))
    named = F.when(F.col("kind") == "person", F.concat(whole, _untitled(F.col("found"), F.col("new")))).otherwise(whole)
    known = each.join(table, "found").select("__key", F.explode(named).alias("x")).groupBy("__key", "x.found").agg(
        F.min(F.struct("x.bare", "x.new")).alias("x")).select("__key", "found", "x.*")
    longest = F.sort_array(F.collect_list(F.when(F.col("bare"), F.struct(-F.length("found"), F.col("found").alias("name")))))
    maps = land(known.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("found", "new"))).alias("__new"),
                                           F.transform(longest, lambda x: x["name"]).alias("__bare")), "maps")
    joined = hit.join(maps, "__key")
    own = F.concat(F.lit(rf"{PATTERN}|(?=\p{{Lu}})(?<!\p{{L}})(?:"), F.array_join("__bare", "|"), F.lit(r")(?!\p{L})"))

    def changed(rows: DataFrame, all_found: Column, plain: Column) -> DataFrame:
        new = F.transform(all_found, lambda x: F.coalesce(F.element_at("__new", x), x))
        whole = let(plain, lambda p: F.concat(p[0], F.array_join(F.zip_with(
            new, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.concat(a, b)), "")))
        return rows.select(*[whole.alias(c) if c == text else F.col(f"`{c}`") for c in names], F.size(all_found).alias("n_entities"))

    titled = F.size("__bare") > 0
    nameless = changed(joined.where(~titled), F.col("__found"), F.split(F.col(text), PATTERN, -1))
    named = changed(joined.where(titled), F.regexp_extract_all(F.col(text), own, F.lit(0)), F.split(F.col(text), own, -1))
    rest = docs.select(*[F.col(f"`{c}`") for c in names]).where(~found).withColumn("n_entities", F.lit(0))
    return rest.unionByName(nameless).unionByName(named)
