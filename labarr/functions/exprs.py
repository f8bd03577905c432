"""Column builders for cell values, in which null and NaN are distinct states.

All stay in the JVM. A cell is *missing* if it is null or NaN; which operations skip
missing cells, which let NaN through and which refuse null is said at each of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

NAN = float("nan")
FLOATING = (S.FloatType, S.DoubleType)
NUMERIC = (S.ByteType, S.ShortType, S.IntegerType, S.LongType, *FLOATING, S.DecimalType)


def kind(t: S.DataType) -> str:
    """number, string or boolean."""
    return "number" if isinstance(t, NUMERIC) else "boolean" if isinstance(t, S.BooleanType) else "string"


def number(c: Column, t: S.DataType) -> Column:
    """The cell as a double; booleans are 1 and 0, strings are null."""
    if kind(t) == "string":
        return F.lit(None).cast("double")
    return (c.cast("int") if kind(t) == "boolean" else c).cast("double")


def present(c: Column) -> Column:
    """The double, or null where it is NaN."""
    return F.nullif(c, F.lit(NAN))


def is_nan(c: Column, t: S.DataType) -> Column:
    return F.coalesce(F.isnan(c), F.lit(False)) if isinstance(t, FLOATING) else F.lit(False)


def operand(c: Column, t: S.DataType, strict: bool, what: str) -> Column:
    """A number for arithmetic and ordering. Strict: null raises; else it stays null."""
    if kind(t) != "number":
        raise TypeError(f"{what} requires numeric operands")
    return F.when(c.isNull(), F.raise_error(F.lit(f"{what} requires numeric operands")).cast("double")).otherwise(c.cast("double")) if strict else c.cast("double")


def divide(a: Column, b: Column) -> Column:
    """IEEE division of doubles: x/0 is an infinity of the right sign, 0/0 is NaN."""
    # the sign of a zero divisor shows in its text only
    negative = (a < 0) != F.startswith(b.cast("string"), F.lit("-"))
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


ARITHMETIC = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide,
    "power": power,
}
_ORDER = {
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}


def compare(op: str, a: Column, ta: S.DataType, b: Column, tb: S.DataType, strict: bool = False) -> Column:
    """Order: false if a side is NaN, null if one is null (strict: raises). Equality: null
    equals null, NaN equals nothing, values of different kinds are never equal."""
    if op in _ORDER:
        x, y = operand(a, ta, strict, op), operand(b, tb, strict, op)
        return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).otherwise(~F.isnan(x) & ~F.isnan(y) & _ORDER[op](x, y))
    if op not in ("eq", "ne"):
        raise ValueError(f"unknown comparison {op}")
    if kind(ta) != kind(tb):
        same = a.isNull() & b.isNull()
    else:
        same = a.eqNullSafe(b) & ~is_nan(a, ta) & ~is_nan(b, tb)
    return ~same if op == "ne" else same


def truthy(c: Column, t: S.DataType) -> Column:
    """NaN and non-zero numbers, non-empty strings and true hold; null does not."""
    if kind(t) == "number":
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(c if kind(t) == "boolean" else c != "", F.lit(False))


def rounded(c: Column, precision: int) -> Column:
    """Half towards plus infinity."""
    f = float(10**precision)
    return F.floor(c * f + 0.5).cast("double") / f


def total(c: Column) -> Column:
    """Aggregate: sum of cells that are not missing; 0 of nothing."""
    return F.coalesce(F.sum(present(c)), F.lit(0.0))


def total_along(c: Column) -> Column:
    """Aggregate: sum along a dimension; null counts 0 and NaN is not skipped."""
    return F.coalesce(F.sum(F.coalesce(c, F.lit(0.0))), F.lit(0.0))


def average(c: Column) -> Column:
    """Aggregate: mean of cells that are not missing; NaN of nothing."""
    return F.coalesce(F.avg(present(c)), F.lit(NAN))


def valid(c: Column) -> Column:
    """Aggregate: number of cells that are not missing."""
    return F.count(present(c))
