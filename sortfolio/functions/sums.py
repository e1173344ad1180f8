"""Sums of doubles that do not depend on the order of rows or on how they are dealt.

A value is cut into four whole numbers of 32 bits (weights 2^32, 1, 2^-32 and 2^-64); these are summed as longs, which is exact
in any order and combines on the map side for up to 2^31 rows of a group, and put together at the end in one way. Digits below
2^-64 are cut off value by value. Values of 2^62 or more, infinities and NaN are added as doubles next to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 1 << 32


def exact_sum(x: Column) -> Column:
    """As ``F.sum`` of doubles: missing values are skipped, the sum of none is missing."""
    x = x.cast("double")
    fits = F.abs(x) < float(1 << 62)
    inside = F.when(fits, x)
    whole = inside.cast("bigint")
    high = (inside - whole) * float(LIMB)  # exact: the fraction of a double
    third = high.cast("bigint")
    fourth = ((high - third) * float(LIMB)).cast("bigint")
    parts = (F.shiftright(whole, 32), whole.bitwiseAND(F.lit(LIMB - 1)), third, fourth, F.when(~fits, x))
    # bound once, since each of the sums is read several times
    sums = F.struct(*[F.sum(c).alias(n) for c, n in zip(parts, "abcdo")])
    return F.transform(F.array(sums), _joined)[0]


def _joined(s: Column) -> Column:
    """One number out of the sums of the parts (``a`` to ``d``) and of what has none (``o``)."""
    a, b, c, d = (s[n] for n in "abcd")
    c, d = c + F.shiftright(d, 32), d.bitwiseAND(F.lit(LIMB - 1))  # carry, so that all but the first lie below 2^32
    b, c = b + F.shiftright(c, 32), c.bitwiseAND(F.lit(LIMB - 1))
    a, b = a + F.shiftright(b, 32), b.bitwiseAND(F.lit(LIMB - 1))
    small = F.abs(a) < 1 << 30
    units = F.shiftleft(a, 32) + b
    # parts of one sign are added, so that no digits cancel
    down = units < 0
    rest = (c - F.when(down, F.lit(LIMB)).otherwise(F.lit(0))).cast("double") / LIMB + d.cast("double") / float(LIMB) / LIMB
    near = (units + down.cast("bigint")).cast("double") + rest
    total = F.when(small, near).otherwise(a.cast("double") * float(LIMB) + b.cast("double"))
    return F.when(s["o"].isNull(), total).when(total.isNull(), s["o"]).otherwise(total + s["o"])
