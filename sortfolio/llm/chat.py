"""Chat formatting by schema fingerprints: heterogeneous records become canonical turns, then marked text with a loss mask.

A record's layout is the set of nested field paths that it has (``messages[].role``, for example): columns that hold a value, and all
paths inside an array that is there, whatever its elements hold. The sorted paths of a mapping's own fields are hashed; the
hash selects the declarative mapping (``MAPPINGS``, the first one first) from fields to turns. Paths foreign to it are listed as ``extra`` and change
nothing. All of it is one projection compiled from the table's schema and the mappings, so records of many layouts in one table
(as Spark reads mixed JSON, with the union of all fields) are converted in one pass.

Text form: every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts and roles are made harmless by
an escape after their first character, and escapes are doubled, so that the form can be read back exactly.

Defined cases: a null text is empty; a null role is empty, a newline in a role becomes a space; a record without any mapped layout has null turns and the layout
``unknown``; an empty array is no turns, which format as empty text; turns keep their order, equal turn numbers are ordered by role and
text; repeated rows are repeated turns; an empty table stays empty; other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of the template, and control strings of other templates that texts may hold (fixed values).
START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: either a list of ``(role, field)`` or an array with its role and text fields.

    ``optional`` fields may be absent; each combination has a fingerprint of its own.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    array: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()

    def layouts(self) -> list[frozenset[str]]:
        if self.array:
            name, role, text = self.array
            always = {f"{name}[].{role}", f"{name}[].{text}"}
        else:
            always = {path for _, path in self.turns if path not in self.optional}
        free = [p for p in self.optional if p not in always]
        return [frozenset(always | set(c)) for k in range(len(free) + 1) for c in combinations(free, k)]


MAPPINGS = (
    Mapping("messages", array=("messages", "role", "content"), optional=("system",)),
    Mapping("conversations", array=("conversations", "from", "value"), optional=("system",)),
    Mapping("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
            optional=("system", "input")),
    Mapping("prompt", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question", turns=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _paths(kind: T.StructType, skip: tuple[str, ...]) -> list[tuple[str, Column]]:
    """Each leaf path of the schema with the condition that a record has it: a value, or the outermost array around it."""
    out = []

    def walk(name: str, kind: T.DataType, value: Column | None, there: Column | None) -> None:
        if isinstance(kind, T.ArrayType):
            walk(f"{name}[]", kind.elementType, None, value.isNotNull() if there is None else there)
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{name}.{f.name}", f.dataType, value[f.name] if there is None else None, there)
        else:
            out.append((name, value.isNotNull() if there is None else there))

    for f in kind.fields:
        if f.name not in skip:
            walk(f.name, f.dataType, F.col(f"`{f.name}`"), None)
    return out


def _listed(paths: list[tuple[str, Column]]) -> Column:
    """The paths that a record has, in order."""
    return F.array_compact(F.array(*[F.when(there, F.lit(p)) for p, there in sorted(paths, key=lambda x: x[0])], F.lit(None).cast("string")))


def layout_hash(paths: list[tuple[str, Column]]) -> Column:
    """SHA-256 of the sorted paths that a record has."""
    return F.sha2(F.array_join(_listed(paths), "\n"), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.replace(F.coalesce(role, F.lit("")), F.lit("\n"), F.lit(" ")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(records: DataFrame, mapping: Mapping, layout: frozenset[str]) -> Column:
    alias = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    parts = []
    if mapping.array:
        name, role, text = mapping.array
        parts.append(F.transform(F.col(name), lambda m: _turn(
            F.coalesce(F.try_element_at(alias, m[role].cast("string")), m[role].cast("string")), m[text].cast("string"))))
        if "system" in layout:
            parts.insert(0, F.array(_turn(F.lit("system"), F.col("system"))))
        return F.concat(*parts)
    present = [(role, path) for role, path in mapping.turns if path in layout]
    by_role: list[tuple[str, list[str]]] = []
    for role, path in present:
        if by_role and by_role[-1][0] == role:
            by_role[-1][1].append(path)
        else:
            by_role.append((role, [path]))
    return F.array(*[_turn(F.lit(role), F.concat_ws("\n", *[F.col(p).cast("string") for p in paths])) for role, paths in by_role])


def canonical_turns(records: DataFrame, keep: tuple[str, ...], mappings=MAPPINGS) -> DataFrame:
    """``keep`` columns, ``layout`` (mapping's name or ``unknown``), ``layout_hash`` over all paths, ``extra`` paths and ``turns``."""
    paths = _paths(records.schema, keep)
    known = {p for p, _ in paths}
    names, turns, extra = F.lit("unknown"), F.lit(None).cast("array<struct<role:string,text:string>>"), _listed(paths)
    for m in reversed(mappings):
        own = frozenset().union(*m.layouts())
        print_, foreign = layout_hash([x for x in paths if x[0] in own]), _listed([x for x in paths if x[0] not in own])
        for layout in m.layouts():
            if layout <= known:
                hit = print_ == fingerprint(layout)
                names, turns = F.when(hit, m.name).otherwise(names), F.when(hit, _turns(records, m, layout)).otherwise(turns)
                extra = F.when(hit, foreign).otherwise(extra)
    return records.select(*keep, names.alias("layout"), layout_hash(paths).alias("layout_hash"), extra.alias("extra"), turns.alias("turns"))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def escape(text: Column) -> Column:
    tails = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROLS)
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), tails, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """The text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), escape(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END), F.lit("\n"))), "")


def loss_mask(turns: Column) -> Column:
    """The loss mask over ``formatted(turns)`` as runs of code points: for each turn ``skip`` unmasked ones, ``length`` ones that
    are learnt or not, then the end mark and its newline."""
    return F.transform(turns, lambda t: F.struct(
        (F.length(escape(t["role"])) + len(START) + 1).cast("bigint").alias("skip"),
        F.length(escape(t["text"])).cast("bigint").alias("length"), (t["role"] == "assistant").alias("learn")))


def format_chats(canonical: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``."""
    return canonical.withColumns({"formatted": formatted(F.col("turns")), "loss_mask": loss_mask(F.col("turns"))})


def _pieces(text: Column) -> Column:
    """A formatted text's turns, without their start marks."""
    return F.filter(F.split(text, _quoted(START)), lambda p: p != "")


def parsed(text: Column) -> Column:
    """Turns read back from the formatted text alone."""

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(_pieces(text), one)


def masked(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, read back from the formatted text."""
    return F.array_join(F.zip_with(_pieces(text), mask, lambda p, m: F.when(m["learn"], unescape(
        F.substring(p, (m["skip"] - len(START) + 1).cast("int"), m["length"].cast("int")))).otherwise("")), "")


def grouped_messages(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One record with a ``messages`` array per conversation of ``(key, turn, role, text)`` rows."""
    return (rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
        .select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
