"""Comparisons of the language as Columns and as tests of plain values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hornbeam.model import INVERSE, Comparison, Const, Term


def column(op: str, a: Column, b: Column) -> Column:
    """The seven operators; ``*=`` searches for a pattern anywhere."""
    if op == "*=":
        return F.rlike(a, b)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def literal(c: Comparison, negated: bool, value: Callable[[Term], Column]) -> Column:
    """The filter of a body comparison; negation is the complement, as there are no nulls."""
    if c.op == "*=":
        found = column("*=", value(c.left), value(c.right))
        return ~found if negated else found
    return column(INVERSE[c.op] if negated else c.op, value(c.left), value(c.right))


def constant(c: Const) -> Column:
    return F.lit(c.value).cast(c.kind.spark)
