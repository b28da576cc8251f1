"""Terms as columns: 64-bit arithmetic that wraps, and division that fails by zero.

Spark's ANSI mode raises where the language wraps or drops a row, so expressions are built, and analysed, with it off.
A failing expression is null; whoever uses one that can fail must drop the nulls, as the language has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hornbeam.language import Bin, Neg, Num, Str, Term, Var

_ANSI = "spark.sql.ansi.enabled"


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """ANSI mode off inside; the session's own setting is back afterwards."""
    before = spark.conf.get(_ANSI, None)
    spark.conf.set(_ANSI, "false")
    try:
        yield
    finally:
        spark.conf.unset(_ANSI) if before is None else spark.conf.set(_ANSI, before)


def column(t: Term, of: dict[str, Column]) -> Column:
    """``of``: the column of each variable."""
    match t:
        case Var(name):
            return of[name]
        case Num(value):
            return F.lit(value).cast("long")
        case Str(value):
            return F.lit(value)
        case Neg(inner):
            return F.negate(column(inner, of))
        case Bin(op, left, right):
            a, b = column(left, of), column(right, of)
            match op:
                case "+":
                    return a + b
                case "-":
                    return a - b
                case "*":
                    return a * b
                case "/":
                    return F.call_function("div", a, b)
                case "%":
                    return a % b
    raise TypeError(t)


def fallible(t: Term) -> bool:
    return isinstance(t, Neg) and fallible(t.of) or isinstance(t, Bin) and (t.op in "/%" or fallible(t.left) or fallible(t.right))


COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
