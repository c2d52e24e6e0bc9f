"""Column expressions shared by all operators.  Everything stays in the JVM."""

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def clean_double(c: Column, from_text: bool = False) -> Column:
    """Cast to double; text that is no number, NaN and infinities become NULL.

    Spark orders NaN above every number, so a NaN would pass each ``x > k``
    rule.  ``from_text`` also refuses the Java literals ``1.5d`` and ``1.5f``.
    """
    d = c.try_cast("double")
    finite = ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    if from_text:
        finite = finite & ~c.rlike(r"[dDfF]\s*$")
    return F.when(finite, d)


def holds(cond: Column) -> Column:
    """A rule condition that is false, not NULL, when an input is missing."""
    return F.coalesce(cond, F.lit(False))


def points(*rules: tuple[Column, float]) -> Column:
    """Sum the points of the rules that hold, at most 100."""
    terms = [F.when(holds(cond), F.lit(float(p))).otherwise(F.lit(0.0)) for cond, p in rules]
    return F.least(reduce(add, terms), F.lit(100.0))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, [holds(c) for c in conds])


def round_even(c: Column, digits: int) -> Column:
    """Round half to even (``F.round`` rounds half away from zero)."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded down (also below zero)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def normal_text(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def ladder(score: Column, steps: list[tuple[float, str]], default) -> Column:
    """First label whose lower bound the score reaches."""
    out = None
    for bound, label in steps:
        cond = score >= F.lit(float(bound))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def percent_of(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part / whole`` in percent, 0 when the whole is 0 or missing."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(round_even(ratio * F.lit(100.0), digits), F.lit(0.0))


def not_blank(column: Column) -> Column:
    """``strip(column) != ""``, from the first character that is no white space."""
    return column.rlike(r"(?U)\S")


def strip(column) -> Column:
    """Without white space of any kind at both ends; ``F.trim`` knows the blank only."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
