"""Rules that no consistent profile breaks; each gives a flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import iso_date, month_diff, roles

FLAGS = ("tenure_impossible", "phantom_expertise", "career_exceeds_life", "experience_exceeds_career_span", "edu_inversion")


def skills() -> Column:
    return F.coalesce(F.col("skills"), F.array())


def months_claimed(each: Column) -> Column:
    """Sum of the roles' durations, negative ones included."""
    return F.aggregate(each, F.lit(0.0), lambda a, r: a + F.coalesce(r["duration_months"], F.lit(0.0)))


def rules(profile) -> dict[str, Column]:
    today, yoe = F.lit(profile.today), F.col("profile.years_of_experience")
    known = F.coalesce(~F.isnan(yoe), F.lit(False))

    def impossible(r):
        start = iso_date(r["start_date"])
        end = F.coalesce(iso_date(r["end_date"]), F.when(r["is_current"], today))
        return F.coalesce(F.abs(r["duration_months"] - month_diff(start, end)) > 18, F.lit(False))

    phantom = F.filter(skills(), lambda s: s["proficiency"].isin("expert", "advanced") & (s["duration_months"] == 0))
    first = F.array_min(F.transform(roles(), lambda r: iso_date(r["start_date"])))
    education = F.coalesce(F.col("education"), F.array())
    return {
        "tenure_impossible": F.exists(roles(), impossible),
        "phantom_expertise": F.size(phantom) >= 3,
        "career_exceeds_life": known & F.coalesce(months_claimed(roles()) > yoe * 12 + 24, F.lit(False)),
        "experience_exceeds_career_span": known & F.coalesce(yoe * 12 > month_diff(first, today) + 48, F.lit(False)),
        "edu_inversion": F.exists(education, lambda e: F.coalesce(e["end_year"] < e["start_year"], F.lit(False))),
    }


def consistency_flags(profile) -> Column:
    """The broken rules' names, in order."""
    each = rules(profile)
    return F.filter(F.array(*[F.when(each[n], F.lit(n)) for n in FLAGS]), lambda x: x.isNotNull())
