"""Accounting items by a table of fallbacks, compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortfolio.functions.columns import nan_to_null

NONE = "none"


@dataclass(frozen=True)
class Branch:
    """A way to an item: the sum of ``plus`` less the sum of ``minus``, open if all of them are there."""

    name: str
    plus: tuple[str, ...]
    minus: tuple[str, ...] = ()


@dataclass(frozen=True)
class Item:
    """The first open branch; without any, ``otherwise`` (branch ``none``)."""

    name: str
    branches: tuple[Branch, ...]
    otherwise: float | None = None


#: fixed values: the fallbacks of book equity as the method's notes give them
BOOK_EQUITY = (
    Item("preferred", (Branch("redemption", ("pstkrv",)), Branch("liquidation", ("pstkl",)), Branch("par", ("pstk",))), 0.0),
    Item("deferred", (Branch("reported", ("txditc",)),), 0.0),
    Item("equity", (Branch("reported", ("seq",)), Branch("common", ("ceq", "pstk")), Branch("assets", ("at",), ("lt",)))),
    Item("be", (Branch("book", ("equity", "deferred"), ("preferred",)),)),
)


def _ordered(items: Sequence[Item]) -> list[Item]:
    """Items after those they use; a name used in a circle is an error."""
    by_name, done, path = {i.name: i for i in items}, [], []
    if len(by_name) < len(items):
        raise ValueError("an item is defined twice")

    def visit(name: str) -> None:
        if name not in by_name or by_name[name] in done:
            return
        if name in path:
            raise ValueError(f"items use each other in a circle: {[*path, name]}")
        path.append(name)
        for b in by_name[name].branches:
            for used in (*b.plus, *b.minus):
                visit(used)
        path.pop()
        done.append(by_name[name])

    for i in items:
        visit(i.name)
    return done


def compiled(items: Sequence[Item], schema: T.StructType) -> dict[str, Column]:
    """Value and branch (``<name>_branch``) of each item as expressions over the columns of the table alone."""
    values: dict[str, Column] = {}
    out: dict[str, Column] = {}
    floats = {f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    known = {i.name for i in items}

    def of(name: str) -> Column:
        if name in known:
            return values[name]
        if name not in schema.names:
            raise ValueError(f"no column or item {name}")
        return nan_to_null(F.col(name)).cast("double") if name in floats else F.col(name).cast("double")

    for item in _ordered(items):
        value, branch = F.lit(item.otherwise).cast("double"), F.lit(NONE)
        for b in reversed(item.branches):
            total = sum((of(c) for c in b.plus[1:]), start=of(b.plus[0]))
            for c in b.minus:
                total = total - of(c)
            is_open = total.isNotNull()  # a sum is missing as soon as one of its terms is
            value, branch = F.when(is_open, total).otherwise(value), F.when(is_open, F.lit(b.name)).otherwise(branch)
        values[item.name] = value
        out |= {item.name: value, f"{item.name}_branch": branch}
    return out


def with_items(df: DataFrame, items: Sequence[Item]) -> DataFrame:
    """``df`` with value and branch of each item, in one projection."""
    new = compiled(items, df.schema)
    both = set(new) & set(df.columns)
    if both:
        raise ValueError(f"columns are there already: {sorted(both)}")
    return df.select("*", *[c.alias(n) for n, c in new.items()])


def book_equity(accounts: DataFrame) -> DataFrame:
    return with_items(accounts, BOOK_EQUITY)


def operating_profitability(accounts: DataFrame, expenses: Sequence[str] = ("cogs", "xsga", "xint")) -> DataFrame:
    """``op``: revenues less expenses over book equity and minority interest.

    Needs revenues and at least one expense; missing expenses and a missing minority interest count as 0.
    """
    spent = F.lit(0.0)
    for c in expenses:
        spent = spent + F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0))
    known = F.coalesce(*[nan_to_null(F.col(c).cast("double")) for c in expenses]).isNotNull()
    base = F.col("be") + F.coalesce(nan_to_null(F.col("mib").cast("double")), F.lit(0.0))
    return accounts.withColumn("op", F.when(known, F.try_divide(nan_to_null(F.col("revt").cast("double")) - spent, base)))
