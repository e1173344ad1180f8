"""Reference universe, eligibility flags and row guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortfolio.functions.columns import all_not_null, any_not_null
from sortfolio.plans.config import COMMON_SHARE_CODES, REFERENCE_EXCHANGE

EXPENSES = ["cogs", "xsga", "xint"]


def _common() -> Column:
    return F.col("shrcd").isin(*COMMON_SHARE_CODES)


def universe_condition(var: str) -> Column:
    """Rows whose values set the breakpoints of a measure."""
    conds = {
        "size": [F.col("prc").isNotNull(), F.col("shrout").isNotNull()],
        "bm": [F.col("dec_me").isNotNull(), F.col("be") > 0],
        "inv": [F.col("inv").isNotNull()],
        "op": [F.col("be") > 0, F.col("revt").isNotNull(), F.coalesce(*EXPENSES).isNotNull()],
        "nf": [F.col("nf").isNotNull()],
    }[var]
    return reduce(lambda a, b: a & b, conds, (F.col("exchcd") == REFERENCE_EXCHANGE) & _common())


def nyse_universe_size(chars: DataFrame) -> DataFrame:
    return chars.filter(universe_condition("size"))


def nyse_universe_bm(chars: DataFrame) -> DataFrame:
    return chars.filter(universe_condition("bm"))


def nyse_universe_inv(chars: DataFrame) -> DataFrame:
    return chars.filter(universe_condition("inv"))


def nyse_universe_op(chars: DataFrame) -> DataFrame:
    return chars.filter(universe_condition("op"))


def nyse_universe_nf(panel: DataFrame) -> DataFrame:
    return panel.filter(universe_condition("nf"))


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def eligibility_flags(chars: DataFrame) -> DataFrame:
    sized = (F.col("me") > 0) & _common()
    return chars.withColumns({
        "is_size_ok": _flag(sized),
        "is_beme_ok": _flag((F.col("be") > 0) & F.col("dec_me").isNotNull() & sized),
        "is_inv_ok": _flag(F.col("inv").isNotNull() & sized),
        "is_op_ok": _flag((F.col("be") > 0) & F.col("revt").isNotNull()
                          & F.coalesce(*EXPENSES).isNotNull() & sized),
    })


def universe_flags(chars: DataFrame) -> DataFrame:
    """The universe conditions as columns ``u_<var>``, so that later steps need no raw inputs.

    ``u_nf`` still has to be combined with the presence of the candidate value.
    """
    flags = {f"u_{v}": F.coalesce(universe_condition(v), F.lit(False)) for v in ("size", "bm", "inv", "op")}
    flags["u_nf"] = F.coalesce((F.col("exchcd") == REFERENCE_EXCHANGE) & _common(), F.lit(False))
    return chars.withColumns(flags)


def nf_eligibility_flag(panel: DataFrame) -> DataFrame:
    """A candidate value on a common share with positive size (the size flag says the latter two)."""
    return panel.withColumn("is_nf_ok", _flag(F.col("nf").isNotNull() & (F.col("is_size_ok") == 1)))


def measure_totals(long: DataFrame) -> DataFrame:
    """Per series (source file, measure) its place and the sum of absolute values."""
    return long.groupBy("source_file", "measure", "index").agg(F.sum(F.abs("nf")).alias("total"))


def usable_measures(totals: DataFrame) -> DataFrame:
    """Series whose absolute values do not sum to zero."""
    return totals.filter(F.col("total") != 0).select("source_file", "measure")


def drop_degenerate_measures(long: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """Leave out measures that are all zero or all missing."""
    usable = usable_measures(measure_totals(long)) if usable is None else usable
    return long.join(usable, ["source_file", "measure"], "left_semi")


def groups_with_two_values(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Formation groups whose universe holds at least two distinct candidate values.

    Two distinct values exist exactly when the smallest is below the largest, which needs no
    set of distinct values and combines on the map side.
    """
    return (panel.filter(F.col("u_nf") & F.col("nf").isNotNull()).groupBy(*keys)
            .agg(F.min("nf").alias("lo"), F.max("nf").alias("hi"))
            .filter(F.col("lo") < F.col("hi")).select(*keys))


def min_distinct_guard(panel: DataFrame, keys: list[str]) -> DataFrame:
    return panel.join(groups_with_two_values(panel, keys), keys, "left_semi").filter(F.col("nf").isNotNull())


def drop_unassigned(df: DataFrame, buckets: list[str]) -> DataFrame:
    """Drop rows with every bucket missing."""
    return df.filter(any_not_null(buckets))


def require_all_assigned(df: DataFrame, buckets: list[str]) -> DataFrame:
    return df.filter(all_not_null(buckets))


def null_label_cleanup(df: DataFrame, buckets: list[str]) -> DataFrame:
    """The text label ``nan`` means missing."""
    return df.withColumns({b: F.nullif(F.col(b), F.lit("nan")) for b in buckets})


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Raise when a key occurs twice; a duplicate would multiply rows in every later join."""
    duplicate = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if duplicate:
        raise ValueError(f"{what}: key {keys} occurs more than once, e.g. {duplicate[0].asDict()}")
