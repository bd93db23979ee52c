"""Scalar building blocks as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """To [0, 1]; NaN, which Spark orders above all, becomes 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0))))


def iso_date(x: Column) -> Column:
    """The first ten characters as a date; also the basic (yyyymmdd) and week (yyyy-Www-d) forms of ISO 8601.
    Anything else, and one-digit months or days, are null."""
    head = F.substring(x, 1, 10)
    week = F.regexp_extract(head, r"^(\d{4})-W(\d{2})-(\d)$", 2)
    year = F.regexp_extract(head, r"^(\d{4})-W", 1)
    monday = F.date_trunc("week", F.make_date(year.try_cast("int"), F.lit(1), F.lit(4))).cast("date")
    by_week = F.date_add(monday, (week.try_cast("int") - 1) * 7 + F.regexp_extract(head, r"-(\d)$", 1).try_cast("int") - 1)
    return (
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))
        .when(head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd"))
        .when(head.rlike(r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])-[1-7]$"), by_week)
    )


def month_diff(a: Column, b: Column) -> Column:
    """Calendar months from a to b; the day does not count."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def joined(*parts: Column, sep: str = " ") -> Column:
    """Non-empty parts, joined; a part may be a string or an array of strings."""
    return F.trim(F.array_join(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull() & (x != "")), sep))


def one(x: Column) -> Column:
    return F.array(F.coalesce(x, F.lit("")))


def roles() -> Column:
    return F.coalesce(F.col("career_history"), F.array())


def narrative() -> Column:
    """Summary, headline, then title and description of each role; skills stay out."""
    each = F.flatten(F.transform(roles(), lambda r: F.array(F.coalesce(r["title"], F.lit("")), F.coalesce(r["description"], F.lit("")))))
    return joined(one(F.col("profile.summary")), one(F.col("profile.headline")), each)


def after_summary() -> tuple[Column, Column]:
    """What follows the summary in the narrative, and in what was built."""
    each = F.flatten(F.transform(roles(), lambda r: F.array(F.coalesce(r["title"], F.lit("")), F.coalesce(r["description"], F.lit("")))))
    return joined(one(F.col("profile.headline")), each), joined(F.transform(roles(), lambda r: r["title"]))


def evidence_texts() -> tuple[Column, Column]:
    """(summary and titles; descriptions): what was built and what supports it. Headlines are wishes and stay out."""
    return (
        joined(one(F.col("profile.summary")), F.transform(roles(), lambda r: r["title"])),
        joined(F.transform(roles(), lambda r: r["description"])),
    )


def band(x: Column, steps: list[tuple], otherwise) -> Column:
    """The value of the first condition that holds; conditions are functions of x."""
    return reduce(lambda c, s: c.when(s[0](x), F.lit(s[1])), steps[1:], F.when(steps[0][0](x), F.lit(steps[0][1]))).otherwise(F.lit(otherwise))


def mean(xs: Column) -> Column:
    """Mean of an array of doubles, null if empty."""
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))
