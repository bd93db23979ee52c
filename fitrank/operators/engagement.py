"""How far a profile can be engaged: a multiplier between the floor and 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import has_any
from ..functions.scalar import clamp01, iso_date
from .consistency import skills
from .fit import tenures


def signal(name: str) -> Column:
    return F.col("signals")[name]


def yes(name: str) -> Column:
    return F.coalesce(signal(name), F.lit(False))


def notice_factor(days: Column, profile) -> Column:
    span = profile.notice_end - profile.notice_free
    return F.when(days <= profile.notice_free, 1.0).otherwise(F.pow(clamp01((profile.notice_end - days) / span), 2))


def availability(profile) -> Column:
    days = signal("notice_period_days")
    return F.when(yes("open_to_work_flag"), 0.5).otherwise(0.0) + F.when(days.isNotNull(), 0.4 * notice_factor(days, profile)).otherwise(0.0) + F.when(yes("willing_to_relocate"), 0.1).otherwise(0.0)


def responsiveness() -> Column:
    hours = signal("avg_response_time_hours")
    speed = F.when(hours.isNull(), 0.5).otherwise(clamp01((280 - hours) / 280))
    return clamp01(0.7 * F.coalesce(signal("recruiter_response_rate"), F.lit(0.0)) + 0.3 * speed)


def recency(profile) -> Column:
    days = F.datediff(F.lit(profile.today), iso_date(signal("last_active_date")))
    return F.when(days.isNull(), 0.3).otherwise(clamp01((180 - days) / 180))


def credibility(profile) -> Column:
    """Verified signals against claims: skills assessed below 40 that are claimed as expert or advanced (of a
    skill named twice the last claim counts), and skills older than the whole career. Where the profile grants a bonus,
    good assessments in a wanted domain add it."""
    scores = F.coalesce(F.map_entries(signal("skill_assessment_scores")), F.array())
    # claims are looked up for the few low scores; a table of all of them would cost the square of the skills
    claim = lambda name: F.try_element_at(F.filter(skills(), lambda s: F.coalesce(F.lower(s["name"]), F.lit("")) == name), F.lit(-1))["proficiency"]
    inflated = F.size(F.filter(scores, lambda e: F.when(e["value"] < 40, F.coalesce(claim(F.lower(e["key"])).isin("expert", "advanced"), F.lit(False)))))
    career = F.aggregate(tenures(), F.lit(0.0), lambda a, x: a + x)
    overlong = F.when(career > 0, F.size(F.filter(skills(), lambda s: s["duration_months"] > career))).otherwise(0)
    github = signal("github_activity_score")
    base = F.lit(0.2) + F.when(github > 0, 0.4 * clamp01(github / 60)).otherwise(0.0) + F.when(yes("verified_email"), 0.2).otherwise(0.0) + F.when(yes("verified_phone"), 0.1).otherwise(0.0) + F.when(yes("linkedin_connected"), 0.1).otherwise(0.0)
    found = clamp01(base - 0.1 * F.least(inflated, F.lit(2)) - 0.1 * F.least(overlong, F.lit(2)))
    if not profile.assessment_bonus:
        return found
    strong = F.size(F.filter(scores, lambda e: (e["value"] >= 70) & has_any(F.lower(e["key"]), profile.positive)))
    return F.least(F.lit(1.0), found + profile.assessment_bonus * F.least(strong, F.lit(2)))


def with_engagement(candidates: DataFrame, profile) -> DataFrame:
    """Adds `multiplier` and `engagement_trace`."""
    parts = {"availability": availability(profile), "responsiveness": responsiveness(), "recency": recency(profile), "credibility": credibility(profile)}
    rows = candidates.withColumns({f"_{n}": c for n, c in parts.items()})
    w, t = profile.engagement, lambda n: F.col(f"_{n}")
    blend = w["availability"] * t("availability") + w["responsiveness"] * t("responsiveness") + w["recency"] * t("recency") + w["credibility"] * t("credibility")
    rows = rows.withColumn("multiplier", profile.floor + (1 - profile.floor) * blend)
    return rows.withColumn("engagement_trace", F.struct(*[t(n).alias(n) for n in parts])).drop(*[f"_{n}" for n in parts])
