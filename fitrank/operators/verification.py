"""The independent report on a ranking: what it took in, what it left out, and in which order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .audit import dominance, exclusion_reason, spearman, stretch

GATES = ("honeypot", "services_only", "kw_stuffer", "cv_primary", "pure_research", "framework_dabbler")
ARCHETYPES = ("ELITE", "STRONG", "SENIOR_ENG", "GENERIC", "OTHER")
GRADES = ("STRONG", "MED", "WEAK", "NONE")
#: Ids in a ranking that a report is made for.
MOST_RANKED = 10_000


def members(classes: DataFrame, ranking: DataFrame) -> DataFrame:
    """Every class row with its rank, null for those that the ranking left out. The ranking is a few rows."""
    if ranking.count() > MOST_RANKED:
        raise ValueError(f"a report is made for at most {MOST_RANKED} ranks")
    return classes.join(F.broadcast(ranking.select("candidate_id", F.col("rank").cast("int").alias("rank"))), "candidate_id", "left")


def gate_counts(rows: DataFrame) -> DataFrame:
    """gate, pool (rows that it stops), top (those among the ranked) and their ids by rank."""
    sums = [x for g in GATES for x in (F.count_if(F.col(g)).alias(f"{g}_pool"), F.count_if(F.col(g) & F.col("rank").isNotNull()).alias(f"{g}_top"), _ids(F.col(g) & F.col("rank").isNotNull()).alias(f"{g}_ids"))]
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"{g}_pool").alias("pool"), F.col(f"{g}_top").alias("top"), F.col(f"{g}_ids").alias("ids")) for g in GATES]))
    return rows.agg(*sums).select(each.alias("g")).select("g.*")


def _ids(condition: Column) -> Column:
    """Ids of the ranked rows that a condition holds for, by rank; bounded by the ranking."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("rank", "candidate_id")))), lambda r: r["candidate_id"]), ",")


def cohorts(rows: DataFrame) -> DataFrame:
    """The two sides of the head-to-head: excluded rows fit in every respect, and weaker ones that were included; how many
    there are, and means and rates that pass over nulls."""
    return rows.where(cohort().isNotNull()).groupBy(cohort().alias("cohort")).agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in cohort_means().items()])


def cohort() -> Column:
    return F.when(F.col("rank").isNull() & F.col("coherent_fit"), "excluded fit").when(F.col("rank").isNotNull() & ~F.col("coherent"), "weaker included")


def cohort_means() -> dict[str, Column]:
    """What is averaged of a cohort."""
    return {"response": F.col("rr"), "active_days": F.col("active_days"), "open": F.col("otw").cast("double"), "notice": F.col("notice"), "in_target": F.col("in_target").cast("double")}


def placement_conditions() -> dict[str, Column]:
    """How coherent builders, the best archetype and rows of strong wording alone were placed."""
    inside, coherent, elite = F.col("rank").isNotNull(), F.col("coherent"), F.col("arch") == "ELITE"
    return {
        "pool": F.lit(True),
        "ranked": inside,
        "coherent in": coherent & inside,
        "coherent out": coherent & ~inside,
        "weaker in": ~coherent & inside,
        "fit": F.col("coherent_fit"),
        "fit in": F.col("coherent_fit") & inside,
        "fit out": F.col("coherent_fit") & ~inside,
        "elite": elite,
        "elite reachable": elite & F.col("reachable"),
        "elite in": elite & inside,
        "elite reachable out": elite & F.col("reachable") & ~inside,
        "elite unreachable out": elite & ~F.col("reachable") & ~inside,
        "strong wording in": ~coherent & (F.col("grade") == "STRONG") & inside,
        "strong wording out": ~coherent & (F.col("grade") == "STRONG") & ~inside,
    }


def placements(rows: DataFrame) -> DataFrame:
    """item, n of the placement conditions."""
    items = placement_conditions()
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in items.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(f"`{n}`").alias("n")) for n in items]))
    return counts.select(each.alias("i")).select("i.*")


def reasons(rows: DataFrame) -> DataFrame:
    """Why coherent rows were left out, by the first reason that holds."""
    return rows.where(F.col("coherent") & F.col("rank").isNull()).groupBy(exclusion_reason().alias("reason")).agg(F.count("*").alias("n"))


def unjustified_swaps(rows: DataFrame) -> DataFrame:
    """Pairs (excluded, included): a fit row was left out for a weaker one that is better on no axis."""
    return dominance(rows.where(F.col("rank").isNotNull() & ~F.col("coherent")), rows.where(F.col("rank").isNull() & F.col("coherent_fit")))


def strength_order(rows: DataFrame) -> DataFrame:
    """Correlation of rank with independent strength among the ranked, ties by rank."""
    ranked = rows.where(F.col("rank").isNotNull()).select("rank", "strength", F.lit(0).alias("all"))
    return spearman(ranked, [F.col("rank")], [F.desc("strength"), F.col("rank")], "all").select("rho")


def distinct_reasons(ranked: DataFrame) -> DataFrame:
    """rows and distinct explanations of a ranking."""
    return ranked.agg(F.count("*").alias("rows"), F.count_distinct("reasoning").alias("distinct_reasons"))


#: Groupings of the report's one pass, by what they group: a section and its item.
_SETS = ("arch", "grade", "reason", "stretch", "cohort")


def summed(rows: DataFrame) -> DataFrame:
    """All counts and means of the report as (section, item, value), from one pass over the members: each row goes to the
    groups of its archetype, grade, reason, stretch of ranks and cohort, and to the whole. Gates and placements are sums of
    the whole."""
    inside = F.col("rank").isNotNull()
    keys = {
        "arch": F.col("arch"),
        "grade": F.when(inside, F.col("grade")),
        "reason": F.when(F.col("coherent") & ~inside, exclusion_reason()),
        "stretch": stretch(),
        "cohort": cohort(),
    }
    gates = {f"{g} {part}": F.col(g) & (F.lit(True) if part == "pool" else inside) for g in GATES for part in ("pool", "top")}
    placed = placement_conditions()
    cuts = {f"top_{k}": F.col("rank") <= k for k in (10, 50, 100)}
    counts = {**{f"g{i}": c for i, c in enumerate(gates.values())}, **{f"p{i}": c for i, c in enumerate(placed.values())}, **cuts}
    means = cohort_means()
    sums = [F.count("*").alias("n"), *[F.count_if(n).alias(n) for n in counts], F.avg("strength").alias("mean"), *[F.avg(n).alias(n) for n in means]]
    narrow = rows.select(*[c.alias(n) for n, c in keys.items()], *[c.alias(n) for n, c in counts.items()], "strength", *[c.alias(n) for n, c in means.items()])
    found = narrow.groupingSets([[k] for k in _SETS] + [[]], *_SETS).agg(F.grouping_id().alias("level"), *sums)
    level = lambda key: F.lit((1 << len(_SETS)) - 1 - (1 << (len(_SETS) - 1 - _SETS.index(key)) if key else 0))

    def told(section: str, key: str | None, item: Column | None, values: dict[str, str]) -> Column:
        """The entries of a row of that grouping; rows that have no such key are in no group of it."""
        entries = F.array(*[F.struct(F.lit(section).alias("section"), (F.concat_ws(" ", item, F.lit(label)) if item is not None else F.lit(label)).alias("item"), F.col(n).cast("double").alias("value")) for label, n in values.items()])
        there = F.col("level") == level(key)
        return F.when(there & F.col(key).isNotNull() if key and key != "arch" else there, entries).otherwise(F.array().cast("array<struct<section:string,item:string,value:double>>"))

    entries = F.concat(
        told("archetypes", "arch", F.col("arch"), {"pool": "n", **{c: c for c in cuts}}),
        told("grades", "grade", F.col("grade"), {"n": "n"}),
        told("reasons", "reason", F.col("reason"), {"n": "n"}),
        told("strength", "stretch", F.col("stretch"), {"mean": "mean"}),
        told("cohorts", "cohort", F.col("cohort"), {"n": "n", **{m: m for m in means}}),
        told("gates", None, None, {g: f"g{i}" for i, g in enumerate(gates)}),
        told("placements", None, None, {f"{p} n": f"p{i}" for i, p in enumerate(placed)}),
    )
    return found.select(F.explode(entries).alias("e")).select("e.*")


def verification(classes: DataFrame, ranking: DataFrame) -> DataFrame:
    """The whole report as (section, item, value) rows: archetypes at the cuts, grades, gates, placements, reasons, mean
    strength by stretch, order, swaps and cohorts."""
    rows = written(members(classes, ranking), "members")
    tall = lambda df, section, item, *values: [df.select(F.lit(section).alias("section"), F.concat_ws(" ", item, F.lit(v)).alias("item"), F.col(v).cast("double").alias("value")) for v in values]
    swaps = written(unjustified_swaps(rows), "swaps").agg(F.count("*").alias("pairs"), F.count_distinct("excluded").alias("excluded"), F.count_distinct("included").alias("included"))
    parts = [*tall(strength_order(rows), "strength", F.lit("order"), "rho"), *tall(swaps, "swaps", F.lit("distinct"), "pairs", "excluded", "included")]
    return reduce(lambda a, b: a.unionByName(b), parts, summed(rows))


def verification_report(report: DataFrame, gates: DataFrame | None = None, title: str = "Independent verification") -> str:
    """Markdown of a report's rows, a table a section; `gates` adds the ids that a gate should have stopped."""
    found: dict[str, list] = {}
    for r in report.collect():
        found.setdefault(r["section"], []).append((r["item"], r["value"]))
    lines = [f"# {title}", ""]
    for section, items in sorted(found.items()):
        lines += [f"## {section.capitalize()}", "", "| item | value |", "|---|---|"]
        lines += [f"| {item} | {'' if value is None else format(value, 'g')} |" for item, value in sorted(items)] + [""]
    if gates is not None:
        lines += ["## Ranked rows at gates", "", "| gate | ids |", "|---|---|"] + [f"| {r['gate']} | {r['ids'] or '-'} |" for r in gates.collect()] + [""]
    return "\n".join(lines)


def verdict_lines(report: DataFrame) -> list[str]:
    """The short form: a line a section."""
    found: dict[str, list] = {}
    for r in report.orderBy("section", "item").collect():
        found.setdefault(r["section"], []).append(f"{r['item']}={'-' if r['value'] is None else format(r['value'], 'g')}")
    return [f"{section}: {'  '.join(items)}" for section, items in found.items()]
