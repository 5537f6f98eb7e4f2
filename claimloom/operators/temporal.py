"""Time expressions and constraints as Columns.

A constraint is a struct (lower_bound, lower_inclusive, upper_bound, upper_inclusive) of ISO
texts and booleans; an absent bound is null and inclusive. Both bounds have one precision: a
date, or a moment with an offset (the text holds a T).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DDL = "struct<lower_bound:string,lower_inclusive:boolean,upper_bound:string,upper_inclusive:boolean>"


def constraint(lower: Column, upper: Column, lower_inclusive: Column | bool = True, upper_inclusive: Column | bool = False) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lower.cast("string").alias("lower_bound"), as_column(lower_inclusive).alias("lower_inclusive"), upper.cast("string").alias("upper_bound"), as_column(upper_inclusive).alias("upper_inclusive"))


def exactly(moment: Column) -> Column:
    """The closed point."""
    return constraint(moment, moment, True, True)


def during(lower: Column, upper: Column) -> Column:
    """From lower, up to but not with upper."""
    return constraint(lower, upper)


def unresolved() -> Column:
    return F.lit(None).cast(DDL)


def resolve_calendar(expression: Column, reference: Column | None = None) -> Column:
    """The period that YYYY, YYYY-MM or YYYY-MM-DD names, or "next April" and "the following April" after reference (ISO text with an offset, whose own date counts). Null where unresolved.

    Years 0000, impossible dates and periods that would end beyond year 9999 stay unresolved."""
    digits = r"(?U)^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$"
    part = lambda k: F.regexp_extract(expression, digits, k)
    start = F.when(expression.rlike(digits), F.concat(part(1), F.lit("-"), F.when(part(2) == "", "01").otherwise(part(2)), F.lit("-"), F.when(part(3) == "", "01").otherwise(part(3))))
    low = start.try_cast("date")
    high = F.when(part(2) == "", F.add_months(low, 12)).when(part(3) == "", F.add_months(low, 1)).otherwise(F.date_add(low, 1))
    named = F.when(low.isNotNull() & (F.year(low) >= 1) & (F.year(high) <= 9999), during(low, high))
    if reference is None:
        return named
    local = F.substring(reference, 1, 10).try_cast("date")
    year = F.year(local) + F.when(F.month(local) < 4, 0).otherwise(1)
    text = lambda month: F.format_string(f"%04d-{month}-01", year)
    april = F.when(expression.isin("next April", "the following April") & local.isNotNull() & (year <= 9999), during(text("04"), text("05")))
    return F.coalesce(named, april)


def _is_moment(bound: Column) -> Column:
    return bound.contains("T")


#: An offset at the end of a moment.
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def _at(bound: Column) -> Column:
    """The moment of a bound, whatever the session's zone: a date's midnight, and a moment without an offset, are UTC."""
    seconds = F.regexp_replace(bound, r"T(\d{2}:\d{2})(?=Z|[+-]|$)", "T$1:00")  # a moment may tell minutes alone
    whole = F.when(_is_moment(bound), F.when(bound.rlike(ZONE), seconds).otherwise(F.concat(seconds, F.lit("Z")))).otherwise(F.concat(bound, F.lit("T00:00:00Z")))
    return whole.try_cast("timestamp")


def constraint_error(c: Column) -> Column:
    """Name of the first rule that a constraint breaks, null if it holds."""
    low, high = c["lower_bound"], c["upper_bound"]
    naive = lambda b: F.coalesce(_is_moment(b) & ~b.rlike(ZONE), F.lit(False))
    both = low.isNotNull() & high.isNotNull()
    rules = [
        (low.isNull() & high.isNull(), "bounds"),
        (naive(low) | naive(high), "timezone"),
        (both & (_is_moment(low) != _is_moment(high)), "precision"),
        ((low.isNull() & ~c["lower_inclusive"]) | (high.isNull() & ~c["upper_inclusive"]), "inclusivity"),
        (both & (_at(low) > _at(high)), "order"),
        (both & (_at(low) == _at(high)) & ~(c["lower_inclusive"] & c["upper_inclusive"]), "empty"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])


def ends(c: Column) -> Column:
    """A constraint's bounds as moments, for meet: read from the texts once for each row, where a join compares it with many."""
    return F.struct(_at(c["lower_bound"]).alias("low"), c["lower_inclusive"].alias("low_in"), _at(c["upper_bound"]).alias("high"), c["upper_inclusive"].alias("high_in"))


def meet(a: Column, b: Column) -> Column:
    """overlaps, of the ends of two constraints."""
    def starts_in_time(x: Column, y: Column) -> Column:
        low, high = x["low"], y["high"]
        return low.isNull() | high.isNull() | (low < high) | ((low == high) & x["low_in"] & y["high_in"])

    return starts_in_time(a, b) & starts_in_time(b, a)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two constraints share a moment; open ends reach on, touching ends count where both are inclusive. A null constraint overlaps all."""
    return meet(ends(a), ends(b))


def mixed_precision(a: Column, b: Column) -> Column:
    """Whether a date stands against a moment: overlaps takes the date's midnight, UTC, and says so here."""
    kind = lambda c: _is_moment(F.coalesce(c["lower_bound"], c["upper_bound"]))
    return F.coalesce(kind(a) != kind(b), F.lit(False))


def strictly_stronger(candidate: Column, selected: Column) -> Column:
    """Whether candidate lies within selected and is not the same; all four bounds must be there. Inclusivity alone makes two constraints differ."""
    names = ("lower_bound", "upper_bound")
    there = F.lit(True)
    for c in (candidate, selected):
        for name in names:
            there = there & c[name].isNotNull()
    inside = (_at(candidate["lower_bound"]) >= _at(selected["lower_bound"])) & (_at(candidate["upper_bound"]) <= _at(selected["upper_bound"]))
    return F.coalesce(there & inside & (candidate != selected), F.lit(False))


def claim_constraint(times: Column) -> Column:
    """The first resolved of applicability and event."""
    return F.coalesce(*[F.when(times[k]["kind"] == "resolved", times[k]["constraint"]) for k in ("applicability", "event")])
