"""One account per security and one security per account on each date, out of links that overlap on either side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortfolio.landing import land

#: rules by which a row loses that are not in the caller's table
REPEATED, ORDER = "repeated", "order"


def resolve_links(links: DataFrame, rules: Mapping[str, Column], left: str = "gvkey", right: str = "permno", at: str = "date") -> DataFrame:
    """``links`` with ``rule`` (missing: kept, else what it lost by) and ``round``.

    ``rules`` maps names to orderable columns, the first one first; greater wins, missing is smallest. What they leave open the keys decide, so the
    order of rows never matters. Of rows of one (left, right, date) the greatest stays, the rest are ``repeated``. Then rounds: a row that is the
    greatest of its account's date and of its security's date is kept, and rows beside a kept one are dropped by the first rule in which they
    are behind it. Rows whose better rivals have all been dropped have another round, until none is left; that is the greedy matching in the
    order of the rules. A round keeps at least the greatest row of each date. Rows without a key or date never compete: ``missing``.
    """
    names = list(rules)
    rank = F.struct(*[rules[n].alias(f"r{i}") for i, n in enumerate(names)], F.col(left).alias("left"), F.col(right).alias("right"))
    whole = F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(at).isNotNull()
    rows = links.withColumn("__rank", rank)
    others = [c for c in links.columns if c not in (left, right, at)]
    first = F.row_number().over(Window.partitionBy(left, right, at).orderBy(F.desc("__rank"), *[F.col(c).desc_nulls_last() for c in others]))
    missing = rows.where(~whole).select(*links.columns, F.lit("missing").alias("rule"), F.lit(0).alias("round"))
    rows = land(rows.where(whole).withColumn("__first", first == 1), "links")
    done = [missing, rows.where(~F.col("__first")).select(*links.columns, F.lit(REPEATED).alias("rule"), F.lit(0).alias("round"))]
    open_rows, number = rows.where("__first").drop("__first"), 0
    sides = [Window.partitionBy(k, at) for k in (left, right)]
    while True:
        number += 1
        best = [F.max("__rank").over(w) for w in sides]
        kept = open_rows.withColumns({"__a": best[0], "__b": best[1]}).withColumn(
            "__kept", F.when((F.col("__rank") == F.col("__a")) & (F.col("__rank") == F.col("__b")), F.col("__rank"))).drop("__a", "__b")
        rivals = [F.max("__kept").over(w) for w in sides]
        judged = land(kept.withColumns({"__a": rivals[0], "__b": rivals[1]}).withColumn("__rival", F.greatest("__a", "__b")).drop("__a", "__b"), "judged")
        lost = F.lit(ORDER)
        for i, n in reversed(list(enumerate(names))):
            lost = F.when(~F.col(f"__rank.r{i}").eqNullSafe(F.col(f"__rival.r{i}")), F.lit(n)).otherwise(lost)
        over = judged.where(F.col("__rival").isNotNull())
        done.append(over.select(*links.columns, F.when(F.col("__kept").isNull(), lost).alias("rule"), F.lit(number).alias("round")))
        open_rows = judged.where(F.col("__rival").isNull()).drop("__kept", "__rival")
        if open_rows.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def kept_links(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("rule").isNull()).drop("rule", "round")


def link_drop_counts(judged: DataFrame) -> DataFrame:
    """Rows by the rule they lost by; kept rows as ``kept``."""
    return judged.groupBy(F.coalesce("rule", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))
