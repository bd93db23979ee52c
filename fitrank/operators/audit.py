"""Independent checks of a ranking: own gates, own strength, dominance, overlaps and correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import concepts, has_any
from ..functions.scalar import evidence_texts, iso_date, mean, month_diff, roles
from ..storage import written
from .consistency import skills
from .fit import lower, seniority_band, stability_band
from .ordered import group_places
from .texts import found_name

# Fixed values of the independent check; deliberately apart from the profile's.
STRONG_EVIDENCE = ["recommendation system", "recommender", "ranking system", "ranking model", "learning to rank", "learning-to-rank", "search engine", "search system", "semantic search", "information retrieval", "retrieval system", "vector search", "re-rank", "rerank", "recsys", "relevance ranking", "candidate ranking", "personalization", "personalisation", "matching system", "match candidates"]
MEDIUM_EVIDENCE = ["machine learning model", "ml model", "ml models", "deployed", "production model", "trained a model", "trained models", "deep learning", "neural network", "embeddings", "embedding", "transformer", "fine-tun", "nlp", "llm", "rag", "a/b test", "ab test", "ctr", "click-through"]
WEAK_EVIDENCE = ["data pipeline", "feature pipeline", "etl", "spark", "airflow", "kafka", "data science", "analytics", "model", "algorithm"]
AUDIT_CITIES = ["pune", "noida", "hyderabad", "mumbai", "delhi", "bangalore", "bengaluru", "gurgaon", "gurugram", "ncr"]
ENGINEER_TITLES = ["engineer", "developer", "scientist", " ml", "ml ", " ai", "ai ", "machine learning", "data ", "research", "architect", "sde", "programmer", "devops", "mlops", "swe", "founding", "technical"]
AI_SKILLS = ["rag", "embeddings", "embedding", "vector search", "vector database", "llm", "llms", "fine-tuning llms", "fine-tuning", "lora", "qlora", "peft", "ndcg", "retrieval", "information retrieval", "sentence transformers", "sentence-transformers", "pinecone", "weaviate", "qdrant", "milvus", "faiss", "elasticsearch", "opensearch", "bge", "e5", "learning to rank", "learning-to-rank", "xgboost", "recommendation systems", "recommender", "semantic search", "nlp", "transformers", "bm25", "re-ranking", "reranking", "hybrid search"]
AI_PARTS = ["rag", "embedding", "vector", "llm", "retrieval", "rerank", "transformer", "recommend", "semantic", "fine-tun"]
DABBLING = ["online course", "side project", "experimenting with", "excited about how", "augment my work", "streamline workflows", "exploring how", "taking courses", "been learning", "hobby project", "tutorials"]
OTHER_TITLES = ["content writer", "marketing", "graphic design", "business analyst", "project manager", "program manager", "sales", "recruiter", "designer"]
OTHER_DOMAINS = ["computer vision", "opencv", "object detection", "image segmentation", "image classification", "speech recognition", " asr", "text-to-speech", " tts", "robotics", "slam", "lidar", "point cloud", "autonomous driving"]
LANGUAGE_DOMAINS = ["nlp", "natural language", "retrieval", "ranking", "search", "recommend", "embedding", "llm", "information retrieval", "rag", "semantic", "text"]
RESEARCH_TITLES = ["research scientist", "research engineer", "researcher", "postdoc", "post-doc", "phd ", "ph.d", "academic"]
PRODUCTION_CUES = ["production", "deployed", "deploy", "shipped", "in production", "serving", "real users", "at scale", "a/b", "latency", "throughput", "millions", "qps", "queries/"]
SCOPE_CUES = ["led", "owned", "architected", "designed", "scaled", "staff", "principal", "tech lead", "lead engineer", "end-to-end", "de-facto"]
HOME_CITIES = AUDIT_CITIES + ["chennai", "kolkata", "ahmedabad"]


def contains_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts], F.lit(False))


def evidence_grade(text: Column) -> Column:
    """By substrings, unlike the ranker's whole tokens."""
    return F.when(contains_any(text, STRONG_EVIDENCE), "STRONG").when(contains_any(text, MEDIUM_EVIDENCE), "MED").when(contains_any(text, WEAK_EVIDENCE), "WEAK").otherwise("NONE")


def archetype(text: Column, signatures: dict, other: str = "OTHER") -> Column:
    """The first signature that the text contains."""
    out = F
    for name, part in signatures.items():
        out = out.when(text.contains(part), name)
    return out.otherwise(other)


def audit_flags(profile) -> Column:
    """Five stricter rules; two broken ones make a profile impossible."""
    yoe, today = F.col("profile.years_of_experience"), F.lit(profile.today)
    known = F.coalesce(yoe != 0, F.lit(False)) & ~F.coalesce(F.isnan(yoe), F.lit(True))
    whole = lambda d: d.isNotNull() & (d == F.floor(d))
    span = lambda r: F.coalesce(whole(r["duration_months"]) & (F.abs(month_diff(iso_date(r["start_date"]), F.coalesce(iso_date(r["end_date"]), today)) - r["duration_months"]) > 4), F.lit(False))
    total = F.aggregate(roles(), F.lit(0.0), lambda a, r: a + F.when(whole(r["duration_months"]), r["duration_months"]).otherwise(0.0))
    rules = {
        "date_span_mismatch": F.exists(roles(), span),
        "expert_zero_months": F.size(F.filter(skills(), lambda s: s["proficiency"].isin("expert", "advanced") & (s["duration_months"] == 0))) >= 3,
        "skill_gt_career": known & F.exists(skills(), lambda s: F.coalesce(whole(s["duration_months"]) & (s["duration_months"] > yoe * 12 + 6), F.lit(False))),
        "career_gt_yoe": known & (total > yoe * 12 + 18),
        "edu_order": F.exists(F.coalesce(F.col("education"), F.array()), lambda e: F.coalesce(e["end_year"] < e["start_year"], F.lit(False))),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def summary_says(summary: Column, profile) -> Column:
    """What classify asks of a lower-cased summary alone."""
    return F.struct(
        archetype(summary, profile.archetypes).alias("arch"), evidence_grade(summary).alias("grade"), contains_any(summary, OTHER_DOMAINS).alias("other"), contains_any(summary, LANGUAGE_DOMAINS).alias("language"),
        contains_any(summary, PRODUCTION_CUES).alias("produced"), (sum_of([summary.contains(p) for p in DABBLING]) >= 2).alias("dabbles"), contains_any(summary, SCOPE_CUES).alias("scope"),
    )


def classify(candidates: DataFrame, profile, keep: tuple = ()) -> DataFrame:
    """Gates, reachability, place, band and strength of every candidate, and the columns named in `keep`."""
    described = F.array_join(F.transform(roles(), lambda r: lower(r["description"])), " ")
    # columns of their own: as expressions they would be evaluated again wherever they are read
    name = found_name(profile)
    if name in candidates.columns:
        candidates = candidates.withColumns({"_says": F.col(name)["audit"], "_end": F.col(name)["end"]})
    else:
        candidates = candidates.withColumn("_end", lower(F.col("profile.summary"))).withColumn("_says", summary_says(F.col("_end"), profile))
    candidates = candidates.withColumns({"_title": lower(F.col("profile.current_title")), "_place": lower(F.col("profile.location"))})
    candidates = candidates.withColumns({"_blob": evidence_grade(F.concat_ws(" ", "_end", described)), "_titled": F.concat_ws(" ", "_end", "_title")})
    says, title, place, titled = F.col("_says"), F.col("_title"), F.col("_place"), F.col("_titled")
    # the higher of the summary's grade and that of its end with what follows
    grade = F.when((says["grade"] == "STRONG") | (F.col("_blob") == "STRONG"), "STRONG").when((says["grade"] == "MED") | (F.col("_blob") == "MED"), "MED").when((says["grade"] == "WEAK") | (F.col("_blob") == "WEAK"), "WEAK").otherwise("NONE")
    firms = F.transform(roles(), lambda r: lower(r["company"]))
    durations = F.filter(F.transform(roles(), lambda r: r["duration_months"]), lambda d: d.isNotNull())
    yoe = F.col("profile.years_of_experience")
    moves = F.coalesce(F.col("signals.willing_to_relocate"), F.lit(False))
    in_target = contains_any(place, AUDIT_CITIES)
    in_home = (lower(F.col("profile.country")) == profile.home_country) | contains_any(place, HOME_CITIES)
    active = F.datediff(F.lit(profile.today), iso_date(F.col("signals.last_active_date")))
    open_now, rate = F.coalesce(F.col("signals.open_to_work_flag"), F.lit(False)), F.col("signals.recruiter_response_rate")
    tags = F.size(F.filter(skills(), lambda s: lower(s["name"]).isin(AI_SKILLS) | contains_any(lower(s["name"]), AI_PARTS)))
    band_ = F.when(yoe.isNull(), 0.0).otherwise(seniority_band(yoe)) * F.when(contains_any(title, ["junior", "intern"]), 0.5).otherwise(1.0)
    rows = candidates.select(
        "candidate_id",
        *keep,
        says["arch"].alias("arch"),
        grade.alias("grade"),
        says["grade"].alias("grade_summary"),
        yoe.alias("yoe"),
        F.coalesce(yoe.between(4, 10), F.lit(False)).alias("in_band"),
        ((F.size(firms) > 0) & F.forall(firms, lambda c: contains_any(c, profile.services))).alias("services_only"),
        (~contains_any(title, ENGINEER_TITLES) & (tags >= 5) & (says["grade"] != "STRONG")).alias("kw_stuffer"),
        ((says["other"] | contains_any(titled, OTHER_DOMAINS)) & ~says["language"] & ~contains_any(titled, LANGUAGE_DOMAINS)).alias("cv_primary"),
        (contains_any(title, RESEARCH_TITLES) & ~says["produced"]).alias("pure_research"),
        (says["dabbles"] & (says["grade"] != "STRONG")).alias("framework_dabbler"),
        contains_any(title, OTHER_TITLES).alias("noneng_title"),
        audit_flags(profile).alias("audit_flags"),
        in_target.alias("in_target"),
        (in_target | (moves & in_home)).alias("location_ok"),
        ((open_now | F.coalesce(active <= 120, F.lit(False))) & (rate.isNull() | (rate >= 0.3))).alias("reachable"),
        active.alias("active_days"),
        rate.alias("rr"),
        open_now.alias("otw"),
        F.col("signals.notice_period_days").alias("notice"),
        mean(durations).alias("avg_tenure"),
        F.when(says["scope"], F.least(F.lit(1.0), band_ + 0.1)).otherwise(band_).alias("seniority"),
        stability_band(durations).alias("stability"),
    )
    rows = rows.withColumn("honeypot", F.size("audit_flags") >= 2)
    gates = ["honeypot", "services_only", "kw_stuffer", "cv_primary", "pure_research", "framework_dabbler"]
    rows = rows.withColumn("disqualified", reduce(lambda a, b: a | b, [F.col(g) for g in gates]))
    base = F.greatest(F.when(F.col("arch") == "ELITE", 4.0).when(F.col("arch").isin("STRONG", "SENIOR_ENG"), 3.0).otherwise(0.0), F.when(F.col("grade") == "STRONG", 2.0).when(F.col("grade") == "MED", 1.0).otherwise(0.0))
    plus = lambda c, v: F.when(F.col(c), v).otherwise(0.0)
    rows = rows.withColumn("strength", base + plus("reachable", 0.5) + plus("location_ok", 0.25) - plus("disqualified", 3.0))
    return rows.withColumn("coherent", F.col("arch").isin("ELITE", "STRONG", "SENIOR_ENG")).withColumn("coherent_fit", F.col("coherent") & F.col("reachable") & F.col("in_band") & F.col("location_ok") & ~F.col("disqualified"))


def sum_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])


def exclusion_reason() -> Column:
    return F.when(~F.col("reachable"), "unreachable").when(F.col("disqualified"), "disqualified").when(~F.col("in_band"), "out-of-band(yoe)").when(~F.col("location_ok"), "out-of-location").otherwise("CLEAN-MISS")


#: Rows of a block of included rows, and bins of each axis that excluded rows are grouped by.
BLOCK_ROWS, AXIS_BINS = 512, 4
#: Axes on which an excluded row x has to reach an included row y.
AXES = ("rr", "active_days", "notice", "seniority", "stability", "otw", "in_target")
BINNED = ("rr", "active_days", "seniority", "stability")


def _axes(rows: DataFrame, slack: int, included: bool) -> DataFrame:
    """candidate_id and the axes as doubles of which more is better; what an included row asks for, or what an excluded one
    has. Rows that cannot be in a pair are left out."""
    spare = slack if included else 0
    held = lambda c, unknown: F.coalesce(F.col(c), F.lit(unknown)).cast("double")
    # an unknown flag of an included row is asked for, one of an excluded row is not there
    flag = lambda c: F.coalesce(F.col(c), F.lit(included)).cast("double")
    axes = {"rr": held("rr", 0), "active_days": -(held("active_days", 999) + spare), "notice": -(held("notice", 999) + spare), "seniority": F.col("seniority").cast("double"), "stability": F.col("stability").cast("double"), "otw": flag("otw"), "in_target": flag("in_target")}
    known = F.col("seniority").isNotNull() & F.col("stability").isNotNull()
    usable = known if included else known & F.coalesce(F.col("location_ok"), F.lit(False))
    return rows.where(usable).select("candidate_id", *[axes[c].alias(c) for c in AXES])


def _binned(rows: DataFrame, cuts: dict[str, list[float]]) -> Column:
    """The cell of a row: its bins on the binned axes and its flags."""
    cell = F.col("otw") * 2 + F.col("in_target")
    for c in BINNED:
        cell = cell * (AXIS_BINS + 1) + sum([(F.col(c) > cut).cast("int") for cut in cuts[c]], F.lit(0))
    return cell.cast("int")


def dominance(included: DataFrame, excluded: DataFrame, slack: int = 15) -> DataFrame:
    """Pairs (excluded x, included y) where x is at least as good on every axis: rr, active days and notice (both with
    `slack`), flags, seniority, stability, and x's location. Unknown seniority or stability is in no pair.

    Both sides are grouped into cells by quantiles of four axes and by flags; included cells are cut into blocks of some
    BLOCK_ROWS rows. A cell's best and a block's least on all axes say whether any of its rows can reach any of the block's;
    excluded rows are sent to the blocks that they may reach, and compared there. Cells are at most a few thousand,
    whatever the size; the number of included rows is not bounded."""
    y = written(_axes(included, slack, True), "included")
    x = written(_axes(excluded, slack, False), "excluded")
    quantiles = dict(zip(BINNED, x.stat.approxQuantile(list(BINNED), [i / AXIS_BINS for i in range(1, AXIS_BINS)], 0.02)))
    cuts = {c: sorted(set(q)) for c, q in quantiles.items()}
    sizes = y.groupBy(_binned(y, cuts).alias("of")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("wide"))
    placed = y.withColumn("cell", _binned(y, cuts)).join(F.broadcast(sizes), F.col("cell") == F.col("of"))
    block = F.struct("cell", F.pmod(F.xxhash64("candidate_id"), F.col("wide")).cast("int").alias("slice"))
    blocks = placed.groupBy(block.alias("block")).agg(F.collect_list(F.struct("candidate_id", *AXES)).alias("ys"), *[F.min(c).alias(f"least_{c}") for c in AXES])
    blocks = written(blocks, "blocks")
    cells = x.withColumn("cell", _binned(x, cuts)).groupBy("cell").agg(*[F.max(c).alias(f"most_{c}") for c in AXES])
    reach = reduce(lambda a, b: a & b, [F.col(f"most_{c}") >= F.col(f"least_{c}") for c in AXES])
    # a row a cell on one side, one a block on the other; neither has rows of its own with it
    meet = blocks.drop("ys").join(F.broadcast(cells), reach).select(F.col("cell").alias("x_cell"), "block")
    sent = x.withColumn("x_cell", _binned(x, cuts)).join(meet, "x_cell").join(blocks.select("block", "ys"), "block")
    holds = lambda r: reduce(lambda a, b: a & b, [F.col(c) >= r[c] for c in AXES])
    return sent.select(F.col("candidate_id").alias("excluded"), F.explode(F.transform(F.filter("ys", holds), lambda r: r["candidate_id"])).alias("included"))


def counts_at(ranked: DataFrame, by: str, cuts=(10, 50, 100)) -> DataFrame:
    return ranked.groupBy(by).agg(F.count("*").alias("pool"), *[F.count_if(F.col("rank") <= k).alias(f"top_{k}") for k in cuts])


def upper_median(rows: DataFrame, value: str, group: str) -> DataFrame:
    """min, max, spread and sorted[n // 2] of each group, which doesn't interpolate. Null values don't count."""
    known = rows.select(F.col(group), F.col(value)).where(F.col(value).isNotNull())
    placed = group_places(known, group, [F.col(value)], "group_place")
    ends = known.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("group_size")).withColumnRenamed(group, "group_key")
    middle = placed.join(ends, F.col(group).eqNullSafe(F.col("group_key"))).where(F.col("group_place") == F.floor(F.col("group_size") / 2) + 1)
    return middle.select(F.col(group), "low", "high", F.col(value).alias("median"), (F.col("high") - F.col("low")).alias("spread"))


def spearman(rows: DataFrame, a: list[Column], b: list[Column], group: str) -> DataFrame:
    """1 - 6 sum d^2 / (m (m^2 - 1)) by group, ties in the order given; null below two rows. The orders are of columns.
    Rows are sorted as they are: give no more columns than orders and group need."""
    first = group_places(rows, group, a, "first_place")
    both = group_places(first, group, b, "second_place")
    g = both.select(F.col(group), (F.col("first_place") - F.col("second_place")).cast("double").alias("d")).groupBy(group).agg(F.sum(F.col("d") * F.col("d")).alias("s"), F.count("*").cast("double").alias("m"))
    return g.select(group, F.when(F.col("m") > 1, 1 - 6 * F.col("s") / (F.col("m") * (F.col("m") * F.col("m") - 1))).alias("rho"))


def stretch() -> Column:
    """The stretch of ranks that a row is in, null beyond the hundredth."""
    return F.when(F.col("rank") <= 10, "1-10").when(F.col("rank") <= 50, "11-50").when(F.col("rank") <= 100, "51-100")


def bucket_means(rows: DataFrame, value: str) -> DataFrame:
    return rows.where("rank <= 100").groupBy(stretch().alias("bucket")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Overlap of two id sets; 1 if both are empty."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    n, u = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()), F.count("*")
    return both.agg(n.alias("common"), u.alias("united")).withColumn("jaccard", F.when(F.col("united") == 0, 1.0).otherwise(F.col("common") / F.col("united")))


def churn(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    entered = after.select(key).distinct().join(before, key, "left_anti").withColumn("change", F.lit("entered"))
    left = before.select(key).distinct().join(after, key, "left_anti").withColumn("change", F.lit("left"))
    return entered.unionByName(left)


def concept_depth(found: Column) -> Column:
    return F.least(F.size(found), F.lit(3))


def off_lexicon(summary: Column, profile) -> Column:
    """The off-lexicon terms that a lower-cased summary has."""
    return F.filter(F.array(*[F.when(has_any(summary, [t]), F.lit(t)) for t in profile.off_lexicon]), lambda t: t.isNotNull()).cast("array<string>")


def covered(candidates: DataFrame, profile, found: Column | None = None) -> Column:
    """What the lexicon credits a candidate with and what it misses: the number of concepts in the primary texts (`found`,
    where they are at hand), off-lexicon terms in the summary, and any in descriptions alone."""
    summary = lower(F.col("profile.summary"))
    described = F.lower(F.array_join(F.transform(roles(), lambda r: F.coalesce(r["description"], F.lit(""))), " "))
    built, _ = evidence_texts()
    terms, name = list(profile.off_lexicon), found_name(profile)
    off = F.col(name)["off"] if name in candidates.columns else off_lexicon(summary, profile)
    hit = F.size(off) > 0 if name in candidates.columns else has_any(summary, terms)
    return F.struct(concept_depth(concepts(F.lower(built), profile) if found is None else found).alias("depth"), hit.alias("summary"), (~hit & has_any(described, terms)).alias("described"), off.alias("terms"))


def lexicon_coverage(candidates: DataFrame, profile) -> DataFrame:
    """What the lexicon credits and what it misses, as (section, item, n): rows by number of concepts in the primary
    texts; rows with any off-lexicon term in the summary, and in descriptions alone; and rows of each such term."""
    return coverage_counts(candidates.select(covered(candidates, profile).alias("c")).select("c.*"), profile)


def coverage_counts(rows: DataFrame, profile) -> DataFrame:
    """lexicon_coverage of rows that are `covered`."""
    terms = list(profile.off_lexicon)
    sums = [F.count_if(F.col("depth") == d).alias(f"depth {d}{'+' * (d == 3)}") for d in range(4)]
    sums += [F.count_if("summary").alias("in summary"), F.count_if("described").alias("in descriptions alone"), *[F.count_if(F.array_contains("terms", t)).alias(f"term {t}") for t in terms]]
    counts = rows.agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(n.split(" ")[0] if n[0] in "dt" else "off_lexicon").alias("section"), F.lit(n.partition(" ")[2] if n[0] in "dt" else n).alias("item"), F.col(f"`{n}`").alias("n")) for n in counts.columns]))
    return counts.select(each.alias("c")).select("c.*")


def term_frequencies(rows: DataFrame, terms, summary: Column, description: Column) -> DataFrame:
    """Of each term: documents, those with it in the summary, and those with it in descriptions alone."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), has_any(summary, [t]).alias("s"), has_any(description, [t]).alias("d")) for t in terms]))
    found = rows.select(each.alias("f")).select("f.*").where("s or d")
    return found.groupBy("term").agg(F.count("*").alias("documents"), F.count_if("s").alias("in_summary"), F.count_if(F.col("d") & ~F.col("s")).alias("description_only"))
