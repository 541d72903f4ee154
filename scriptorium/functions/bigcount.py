"""Whole numbers of any size as columns: arrays of limbs, the lowest first, without zeros at the top.

Sums, products, order and text are column expressions, so such counts stay in the query plan.  Numbers below
10^18 (three limbs) go through plain 64-bit arithmetic, without a step per limb.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 1_000_000  # a product of two limbs times millions of terms fits 64 bits
TYPE = "array<bigint>"


def number(value: int | Column) -> Column:
    """A number below 10^18."""
    v = (F.lit(value) if isinstance(value, int) else value).cast("bigint")
    base, low, rest = F.lit(BASE).cast("bigint"), F.pmod(v, F.lit(BASE)), _over(v)
    three = F.array(low, F.pmod(rest, F.lit(BASE)), _over(rest))
    return F.when(v <= 0, F.array().cast(TYPE)).when(v < base, F.array(v)).when(rest < base, F.array(low, rest)).otherwise(three)


def _limb(a: Column, i: int) -> Column:
    return F.coalesce(F.get(a, F.lit(i)), F.lit(0).cast("bigint"))


def _short(a: Column) -> Column:
    """The value of three limbs at most."""
    return _limb(a, 0) + _limb(a, 1) * BASE + _limb(a, 2) * BASE**2


def _carried(limbs: Column) -> Column:
    """Limbs below the base again; sums of limbs of up to 9 x 10^18 may come in."""

    def step(acc: Column, x: Column) -> Column:
        total = acc["c"] + x
        rest = F.pmod(total, F.lit(BASE))
        # exact: the difference is a multiple of the base
        return F.struct(_over(total).alias("c"), F.concat(acc["out"], F.array(rest)).alias("out"))

    def last(acc: Column) -> Column:
        c = acc["c"]
        return F.concat(acc["out"], F.array(F.pmod(c, F.lit(BASE)), F.pmod(_over(c), F.lit(BASE)), _over(_over(c))))

    return F.aggregate(limbs, F.struct(F.lit(0).cast("bigint").alias("c"), F.array().cast(TYPE).alias("out")), step, last)


def _over(x: Column) -> Column:
    """``x`` divided by the base, whole."""
    return F.call_function("div", x, F.lit(BASE).cast("bigint"))


def _trimmed(limbs: Column) -> Column:
    top = F.array_max(F.transform(limbs, lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    return F.slice(limbs, F.lit(1), F.coalesce(top, F.lit(0)))


def summed(value: Column | str, width: int) -> Column:
    """Aggregate: the sum of numbers of at most ``width`` limbs; give the result to ``settled``."""
    v = F.col(value) if isinstance(value, str) else value
    return F.array(*[F.coalesce(F.sum(F.get(v, F.lit(i))), F.lit(0).cast("bigint")) for i in range(max(width, 1))])


def settled(limbs: Column) -> Column:
    """A number from limbs that may be too large or zero at the top."""
    few = (F.size(limbs) <= 3) & (_limb(limbs, 0) < 10**17) & (_limb(limbs, 1) < 10**11) & (_limb(limbs, 2) < 10**5)
    return F.when(few, number(_short(limbs))).otherwise(_trimmed(_carried(limbs)))


def added(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    few = (F.size(a) <= 2) & (F.size(b) <= 2)
    long = _trimmed(_carried(F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))))
    return F.when(few, number(_short(a) + _short(b))).otherwise(long)


def multiplied(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)

    def limb(k: Column) -> Column:
        terms = F.sequence(F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1))
        return F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(a, i) * F.get(b, k - i))

    product = _trimmed(_carried(F.transform(F.sequence(F.lit(0), F.greatest(both - 2, F.lit(0))), limb)))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some & (both <= 3), number(_short(a) * _short(b))).when(some, product).otherwise(F.array().cast(TYPE))


def text(a: Column) -> Column:
    """Decimal digits."""
    digits = F.array_join(F.transform(F.reverse(a), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 6, "0"))), "")
    return F.when(F.size(a) > 0, digits).otherwise("0")


def _top(a: Column) -> Column:
    """The first six limbs as a double."""
    first = F.reverse(F.slice(a, F.greatest(F.size(a) - 5, F.lit(1)), F.lit(6)))
    return F.aggregate(first, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc * BASE + x).cast("decimal(38,0)")).cast("double")


def as_double(a: Column) -> Column:
    """As a double, exact to its last digit but one, infinite beyond its range."""
    long = _top(a) * F.pow(F.lit(float(BASE)), F.greatest(F.size(a) - 6, F.lit(0)))
    return F.when(F.size(a) <= 3, _short(a).cast("double")).otherwise(long)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as a double, also where neither is one."""
    away = F.greatest(F.size(a) - 6, F.lit(0)) - F.greatest(F.size(b) - 6, F.lit(0))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    few = (F.size(a) <= 3) & (F.size(b) <= 3)
    short = _short(a).cast("double") / F.nullif(_short(b).cast("double"), F.lit(0.0))
    return F.when(some & few, short).when(some, _top(a) / _top(b) * F.pow(F.lit(float(BASE)), away)).otherwise(0.0)


def largest_first(a: Column) -> Column:
    """A sort key: smaller for larger numbers; ``from_key`` gives the number back."""
    return F.struct((-F.size(a)).alias("n"), F.transform(F.reverse(a), lambda x: -x).alias("l"))


def from_key(key: Column) -> Column:
    return F.reverse(F.transform(key["l"], lambda x: -x))
