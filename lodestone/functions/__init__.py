"""Columns, aggregates and scalar functions, all of them built-in Spark expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What select, filter, aggregate and sort take.
Expression = Column


def col(name: str) -> Column:
    return F.col(name)


def lit(value) -> Column:
    """A literal; numpy scalars count as their Python values."""
    return F.lit(value.item() if hasattr(value, "item") and not isinstance(value, Column) else value)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else lit(value)


sum, avg, min, max, count, count_distinct = F.sum, F.avg, F.min, F.max, F.count, F.count_distinct

sqrt, sin, cos, tan, asin, acos, atan = F.sqrt, F.sin, F.cos, F.tan, F.asin, F.acos, F.atan
exp, abs, signum, round = F.exp, F.abs, F.signum, F.round
lower, upper, trim, ltrim, rtrim, octet_length, md5 = F.lower, F.upper, F.trim, F.ltrim, F.rtrim, F.octet_length, F.md5
nullif, array, extract, substring, year = F.nullif, F.array, F.extract, F.substring, F.year


def _logarithm(fn, value: Column) -> Column:
    """As IEEE arithmetic has it: minus infinity at 0, NaN below."""
    value = value.cast("double")
    return F.when(value > 0, fn(value)).when(value == 0, F.lit(float("-inf"))).when(value < 0, F.lit(float("nan")))


def ln(value: Column) -> Column:
    return _logarithm(F.ln, value)


log = ln


def log2(value: Column) -> Column:
    return _logarithm(F.log2, value)


def log10(value: Column) -> Column:
    return _logarithm(F.log10, value)


#: From here on every double is a whole number; NaN is above it too, in Spark's order.
WHOLE = float(1 << 52)


def _whole(fn, value: Column) -> Column:
    """As double, like its argument; what has no digits behind the point, infinities and NaN stay as they are."""
    value = value.cast("double")
    return F.when(F.abs(value) >= WHOLE, value).otherwise(fn(value).cast("double"))


def floor(value: Column) -> Column:
    return _whole(F.floor, value)


def ceil(value: Column) -> Column:
    return _whole(F.ceil, value)


def trunc(value: Column) -> Column:
    """Towards zero, as double."""
    return F.when(value < 0, ceil(value)).otherwise(floor(value))


def concat(*values: Column) -> Column:
    """Null if any part is."""
    return F.concat(*values)


def to_timestamp(value: Column) -> Column:
    """Without a time zone."""
    return F.to_timestamp_ntz(value)


def date_trunc(unit: str, value: Column) -> Column:
    """Without a time zone, whatever the session's."""
    return F.date_trunc(unit, value).cast("timestamp_ntz")


def sha224(value: Column) -> Column:
    return F.sha2(value, 224)


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def sha384(value: Column) -> Column:
    return F.sha2(value, 384)


def sha512(value: Column) -> Column:
    return F.sha2(value, 512)


def between(value: Column, low, high, negated: bool = False) -> Column:
    inside = value.between(as_column(low), as_column(high))
    return ~inside if negated else inside


class CaseBuilder:
    """CASE with or without an operand: ``when`` as often as needed, then ``otherwise`` or ``build``. Once built it takes nothing more."""

    def __init__(self, operand: Column | None = None):
        self._operand, self._column, self._built = operand, None, False

    def when(self, condition, value) -> CaseBuilder:
        self._open()
        condition = as_column(condition)
        test = condition if self._operand is None else self._operand == condition
        self._column = (F if self._column is None else self._column).when(test, as_column(value))
        return self

    def otherwise(self, value) -> Column:
        self._open()
        if self._column is None:
            raise ValueError("CASE needs at least one WHEN")
        self._column = self._column.otherwise(as_column(value))
        self._built = True
        return self._column

    def build(self) -> Column:
        """Without ELSE: null where no WHEN holds."""
        self._open()
        if self._column is None:
            raise ValueError("CASE needs at least one WHEN")
        self._built = True
        return self._column

    @property
    def expr(self) -> Column | None:
        return self._operand

    def _open(self) -> None:
        if self._built:
            raise ValueError("this CASE has been built already")


def when(condition, value) -> CaseBuilder:
    return CaseBuilder().when(condition, value)


def case(operand) -> CaseBuilder:
    return CaseBuilder(as_column(operand))
