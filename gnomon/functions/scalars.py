"""The few scalar rules of the language: literal casts, patterns, rounding of averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatementError

LONG = (-(1 << 63), (1 << 63) - 1)
INT = (-(1 << 31), (1 << 31) - 1)

#: Names of the four types in the language (fixed values).
TYPE_NAMES = {T.IntegerType: "INT", T.LongType: "BIGINT", T.DoubleType: "DECIMAL", T.StringType: "VARCHAR"}


def type_name(t: T.DataType) -> str:
    return TYPE_NAMES.get(type(t), t.simpleString())


def literal(value: int | float | str, t: T.DataType, field: str) -> int | float | str:
    """``value`` as a literal of the field's type: its text must read as one, so 0.5 is no BIGINT."""
    text = str(value)
    try:
        if isinstance(t, T.StringType):
            return text
        if isinstance(t, T.DoubleType):
            return float(text)
        if isinstance(t, (T.LongType, T.IntegerType)):
            n = int(text)
            low, high = LONG if isinstance(t, T.LongType) else INT
            if low <= n <= high:
                return n
    except ValueError:
        pass
    raise StatementError(f"cannot use {text!r} as {type_name(t)} in the condition on {field}")


def like_pattern(pattern: str) -> str:
    """``$`` stands for any run of characters, all else for itself, as a SQL LIKE pattern."""
    return "".join("%" if c == "$" else "\\" + c if c in "%_\\" else c for c in pattern)


def round_average(x: Column) -> Column:
    """To 10 significant digits, half away from zero on the decimal digits that the double prints as."""
    return F.when(x.isNotNull(), F.format_string("%.9e", x)).cast("double")


def average(total: Column, count: Column) -> Column:
    return round_average(total.cast("double") / count)
