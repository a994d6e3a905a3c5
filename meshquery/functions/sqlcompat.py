"""Expressions whose meaning follows the rules' SQL dialect where Spark's default differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def counted_as(name: str) -> Column:
    """The number of rows, under a name."""
    return F.count(F.lit(1)).alias(name)


def cc() -> Column:
    return F.col("cyclomatic_complexity")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like(c: str | Column, *patterns: str) -> Column:
    """Any of some LIKE patterns; letters match in either case."""
    out = F.lit(False)
    for p in patterns:
        out = out | col(c).ilike(p)
    return out


def exported(c: str | Column) -> Column:
    """Begins with a capital letter A-Z."""
    return col(c).rlike("^[A-Z]")


def number(c: str | Column) -> Column:
    """A text as a whole number; anything else is 0."""
    return F.coalesce(col(c).try_cast("long"), F.lit(0))


def at_least(c: str | Column, n: int = 1) -> Column:
    """max(c, n), null if c is null."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(n)))


def zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def tally(condition: Column) -> Column:
    """How many rows meet a condition; 0 for none."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def listed(c: str | Column) -> Column:
    """Distinct values, ascending, comma-joined; null without any."""
    found = F.collect_set(col(c))
    return F.when(F.size(found) > 0, F.array_join(F.array_sort(found), ","))


def rounded(c: str | Column, digits: int) -> Column:
    """To some decimal places, halves away from zero.

    The value is taken to twelve places before, so that the order in which it was summed can't show.
    """
    return F.round(col(c).cast("decimal(38,12)"), digits).cast("double")


def encoded(properties: str | Column) -> Column:
    """A map as JSON with its keys in order; an empty one is null."""
    entries = F.array_sort(F.map_entries(col(properties)))
    return F.when(F.size(col(properties)) > 0, F.to_json(F.map_from_entries(entries)))


def details(**fields: str | Column) -> Column:
    """A JSON object that keeps null fields."""
    return F.to_json(F.struct(*[col(c).alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def text(*parts: str | Column) -> Column:
    """Joined text; a null part counts as empty (messages are never null)."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
