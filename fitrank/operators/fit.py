"""Fit of a profile to a job: banded features of a row, combined with a trace of every part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import concept_terms, concepts, found_any, found_terms, has_any
from ..functions.scalar import after_summary, band, evidence_texts, mean, narrative, roles
from .texts import found_name, lexicon_terms


def lower(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def titles() -> Column:
    """Current title and those of all roles, without empty ones."""
    every = F.concat(F.array(F.col("profile.current_title")), F.transform(roles(), lambda r: r["title"]))
    return F.filter(every, lambda t: t.isNotNull() & (t != ""))


def grade_evidence(found: Column, support: Column, generic: Column, disclaimed: Column, profile) -> Column:
    """By number of concepts; else supporting concepts; else generic terms; else 0, which no cap touches."""
    b = profile.bands
    graded = F.when(F.size(found) >= 3, F.lit(b["three"])).when(F.size(found) == 2, F.lit(b["two"])).when(F.size(found) == 1, F.lit(b["one"])).when(F.size(support) > 0, F.lit(b["support"])).when(generic, F.lit(b["generic"])).otherwise(F.lit(0.0))
    return F.when(disclaimed, F.least(graded, F.lit(b["disclaimer"]))).otherwise(graded)


def domain_gate(text: Column, profile) -> Column:
    """1 with a wanted domain; 0.2 with an unwanted one, or research without production; else 0.6."""
    return _gate(lambda terms: has_any(text, terms), profile)


def _gate(has, profile) -> Column:
    off = has(profile.negative) | (has(profile.research) & ~has(profile.production))
    return F.when(has(profile.positive), 1.0).when(off, 0.2).otherwise(0.6)


def title_gate(profile) -> Column:
    return F.when(F.size(titles()) == 0, 0.6).when(F.exists(titles(), lambda t: t.rlike("(?i)" + profile.tech_title)), 1.0).otherwise(0.2)


def rejected_title_gate(found: Column, profile) -> Column:
    """Concepts rescue; else a rejected current title, or nothing but rejected role titles, gives 0.2."""
    rejected = lambda t: t.rlike("(?i)" + profile.rejected_title)
    own = F.filter(F.transform(roles(), lambda r: r["title"]), lambda t: t.isNotNull() & (t != ""))
    current = rejected(F.coalesce(F.col("profile.current_title"), F.lit("")))
    return F.when(F.size(found) > 0, 1.0).when(current, 0.2).when((F.size(own) > 0) & F.forall(own, rejected), 0.2).otherwise(1.0)


def seniority_band(years: Column) -> Column:
    known = F.coalesce(years, F.lit(float("-inf")))
    return F.when(F.isnan(known), 0.25).otherwise(
        band(known, [(lambda y: y.between(5, 9), 1.0), (lambda y: y.between(4, 10), 0.8), (lambda y: y.between(3, 12), 0.5), (lambda y: y > 12, 0.35)], 0.25)
    )


def seniority(scope: Column, profile) -> Column:
    title, years = lower(F.col("profile.current_title")), F.col("profile.years_of_experience")
    junior = F.when(title.contains("junior") | title.contains("intern"), 0.5).otherwise(1.0)
    base = seniority_band(years) * junior
    return F.when(scope, F.least(F.lit(1.0), base + 0.1)).otherwise(base)


def tenures() -> Column:
    """Positive durations."""
    return F.filter(F.transform(roles(), lambda r: r["duration_months"]), lambda d: d > 0)


def stability_band(months: Column) -> Column:
    m, few = mean(months), F.size(months)
    graded = band(m, [(lambda x: x >= 30, 1.0), (lambda x: x >= 24, 0.85), (lambda x: x >= 18, 0.6), (lambda x: x >= 12, 0.4)], 0.25)
    return F.when(few < 2, 0.7).when((few >= 4) & (m < 18), F.least(graded, F.lit(0.3))).otherwise(graded)


def chaser_penalty(months: Column, profile) -> Column:
    return F.when((F.size(months) >= 4) & (mean(months) < 18), F.lit(profile.chaser)).otherwise(F.lit(1.0))


def product_score(profile) -> Column:
    """0.2 for a career in services firms (names contain), 1 for any product industry, 0.4 for services industries."""
    firms = F.filter(F.transform(roles(), lambda r: F.lower(r["company"])), lambda c: c.isNotNull() & (c != ""))
    served = F.lit(False)
    serves = lambda c: _any([c.contains(s) for s in profile.services]) if profile.services else served
    fields = F.filter(F.concat(F.transform(roles(), lambda r: r["industry"]), F.array(F.col("profile.current_industry"))), lambda i: i.isNotNull() & (i != ""))
    known = lambda names: F.array(*[F.lit(n) for n in names])
    return (
        F.when((F.size(firms) > 0) & F.forall(firms, serves), 0.2)
        .when(F.arrays_overlap(fields, known(profile.product_industries)), 1.0)
        .when((F.size(fields) > 0) & (F.size(F.array_except(fields, known(profile.services_industries))) == 0), 0.4)
        .otherwise(0.6)
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def location_score(profile) -> Column:
    place, moves = lower(F.col("profile.location")), F.coalesce(F.col("signals.willing_to_relocate"), F.lit(False))
    there = lambda cities: _any([place.contains(c) for c in cities])
    return (
        F.when(there(profile.cities), 1.0)
        .when(there(profile.second_cities), F.when(moves, 1.0).otherwise(0.8))
        .when(lower(F.col("profile.country")) == profile.home_country, 0.6)
        .when(moves, 0.5)
        .otherwise(0.2)
    )


def education_score() -> Column:
    tiers = F.transform(F.coalesce(F.col("education"), F.array()), lambda e: e["tier"])
    return F.when(F.array_contains(tiers, "tier_1"), 1.0).when(F.array_contains(tiers, "tier_2"), 0.7).otherwise(0.5)


def with_texts(candidates: DataFrame, profile) -> DataFrame:
    """Adds what the texts say once, for all features to share: the terms of lexicons and a disclaimer anywhere, concepts
    of what was built and of what supports it. Where candidates come with what their summaries say (texts.with_found),
    only a summary's end is read with the rest; else, and where that leaves a concept open, the whole text is."""
    every, name = concept_terms(profile), found_name(profile)
    built, support = evidence_texts()
    lowered = lambda c: F.lower(c)
    # few texts need their sentences, so they are not cut beforehand
    backed = concepts(F.col("_support"), profile)
    if name not in candidates.columns:
        texts = candidates.withColumns({"_narrative": lowered(narrative()), "_built": lowered(built), "_support": lowered(support)})
        said = {"_said": found_terms(F.col("_narrative"), lexicon_terms(profile)), "_disclaimed": F.col("_narrative").rlike(profile.disclaimer)}
        return texts.withColumns({**said, "_concepts": concepts(F.col("_built"), profile), "_supporting": backed}).drop("_narrative", "_built", "_support")
    own = F.col(name)
    rest, titles_after = after_summary()
    joint = lambda after: F.concat(own["end"], F.lit(" "), lowered(after))
    texts = candidates.withColumns({"_joint": joint(rest), "_titled": joint(titles_after), "_support": lowered(support)})
    texts = texts.withColumn("_mentioned", found_terms(F.col("_titled"), every))
    new = [~F.array_contains(own["sure"], n) & found_any(F.col("_mentioned"), every, terms) for n, terms in profile.concepts.items()]
    whole = F.get(F.transform(F.array(lowered(built)), lambda t: concepts(t, profile)), F.lit(0))
    said = {
        "_said": F.array_union(own["said"], found_terms(F.col("_joint"), lexicon_terms(profile))),
        "_disclaimed": own["disclaimed"] | F.col("_joint").rlike(profile.disclaimer),
        "_concepts": F.when(_any([own["open"], *new]), whole).otherwise(own["sure"]),
    }
    return texts.withColumns({**said, "_supporting": backed}).drop("_joint", "_titled", "_support", "_mentioned")


def said(terms, profile) -> Column:
    """Does with_texts find any of these terms of the profile's lexicons?"""
    return found_any(F.col("_said"), lexicon_terms(profile), terms)


def with_fit(candidates: DataFrame, profile, semantic: str = "semantic") -> DataFrame:
    """Adds `fit` and, as `fit_trace`, all that led to it. `semantic` names a nullable column."""
    rows = with_texts(candidates, profile)
    found, disclaimed = F.col("_concepts"), F.col("_disclaimed")
    parts = {
        "evidence": grade_evidence(found, F.col("_supporting"), said(profile.generic, profile), disclaimed, profile),
        "evidence_concepts": found,
        "domain_gate": _gate(lambda terms: said(terms, profile), profile),
        "title_gate": title_gate(profile),
        "domain_title_gate": rejected_title_gate(found, profile),
        "semantic": F.col(semantic).cast("double"),
        "has_disclaimer": disclaimed,
        "seniority": seniority(said(profile.scope, profile), profile),
        "product": product_score(profile),
        "location": location_score(profile),
        "education": education_score(),
        "stability": stability_band(tenures()),
        "chaser_penalty": chaser_penalty(tenures(), profile),
    }
    # plain columns: fields of a struct would be inlined wherever they are read
    rows = rows.withColumns({f"_{n}": c for n, c in parts.items()})
    t = lambda n: F.col(f"_{n}")
    share, w = profile.semantic_share, profile.weights
    blended = F.when(t("semantic").isNull(), t("evidence")).otherwise((1 - share) * t("evidence") + share * t("semantic"))
    rows = rows.withColumn("_technical", blended * F.least(t("domain_gate"), t("title_gate"), t("domain_title_gate")))
    total = w["technical"] * t("technical") + w["seniority"] * t("seniority") + w["product"] * t("product") + w["location"] * t("location") + w["education"] * t("education") + w["stability"] * t("stability")
    rows = rows.withColumn("fit", total * t("chaser_penalty"))
    trace = F.struct(*[t(n).alias(n) for n in [*parts, "technical"]], F.col("fit"))
    return rows.withColumn("fit_trace", trace).drop(*[f"_{n}" for n in [*parts, "technical"]])
