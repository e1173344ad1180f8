"""Market equity of firms with several share classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.functions.columns import nan_to_null


def market_equity(securities: DataFrame) -> DataFrame:
    """``me``: price, whose sign only tells a quote from a trade, times shares outstanding."""
    return securities.withColumn("me", F.abs(nan_to_null(F.col("prc").cast("double"))) * nan_to_null(F.col("shrout").cast("double")))


def firm_market_equity(classes: DataFrame, firm: str = "permco", security: str = "permno", date: str = "date", years: str | None = None,
                       carry: Sequence[str] = (), key: str = "firm") -> DataFrame:
    """One row per firm and date: ``me`` is the sum over its share classes, the security is the one that stands for it.

    That is the class of largest equity, then the most years on file, then the greatest keyed hash of the security in place of chance, then the
    security's number; missing is smallest. ``carry`` are columns of that class; ``class_me`` is its own equity, ``n_classes`` their number. A security without a
    firm is a firm of its own. Totals and choice come from one aggregation with map-side combine, so a firm's classes never meet as rows.
    """
    draw = F.md5(F.concat_ws(":", F.lit(key), F.col(security).cast("string")).cast("binary"))
    order = F.struct(F.col("me").alias("m"), (F.col(years) if years else F.lit(0)).alias("y"), draw.alias("h"), F.col(security).alias("s"))
    chosen = F.struct(F.col(security), *[F.col(c) for c in carry], F.col("me").alias("class_me"))
    own = F.when(F.col(firm).isNull(), F.col(security)).alias("__own")
    out = classes.groupBy(firm, own, date).agg(F.max_by(chosen, order).alias("c"), F.sum("me").alias("me"), F.count("*").alias("n_classes"))
    return out.select(firm, date, "c.*", "me", "n_classes")
