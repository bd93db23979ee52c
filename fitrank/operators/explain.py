"""One sentence on each ranked row: role, evidence, standout signal and concerns, chosen by the id's number and built as
Columns over the few rows that are left after the limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Initialisms that are spoken with a vowel first.
INITIALISMS = ["ai", "ml", "nlp", "ir", "ux", "ui", "sre", "mle", "llm"]


def id_number(name: str = "candidate_id") -> Column:
    """The number after the last underscore, else 0."""
    return F.coalesce(F.element_at(F.split(F.col(name), "_"), -1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def pick(options: list[str], salt: int = 0) -> Column:
    place = F.pmod(id_number() + salt, F.lit(len(options))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), place)


def article(phrase: Column) -> Column:
    """a or an, as the first word is spoken."""
    word = F.lower(F.regexp_extract(F.trim(phrase), r"^[(\[{\"']*([^\s]*)", 1))
    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    number = F.regexp_extract(word, r"^0*(\d*)", 1)
    spoken_vowel = number.isin("8", "11", "18") | number.rlike(r"^8\d$")
    return (
        F.when(word == "", "a")
        .when(word.rlike(r"^\d"), F.when(spoken_vowel, "an").otherwise("a"))
        .when(letters.isin(INITIALISMS), "an")
        .when(word.rlike("^[aeiou]"), F.when(word.rlike("^(uni|use|usa|ubiq|eu|one|uk)"), "a").otherwise("an"))
        .otherwise("a")
    )


def with_article(phrase: Column) -> Column:
    return F.concat(article(phrase), F.lit(" "), phrase)


def _t(name: str) -> Column:
    return F.col(f"trace.{name}")


def employer() -> Column:
    """Company of the first role marked as current that names one."""
    current = F.filter(F.coalesce("career_history", F.array()), lambda r: F.coalesce(r["is_current"], F.lit(False)) & (F.coalesce(r["company"], F.lit("")) != ""))
    return F.get(current, F.lit(0))["company"]


def evidence_phrase() -> Column:
    named = F.coalesce(_t("evidence_concepts"), F.array().cast("array<string>"))
    named = F.when(F.array_contains(named, "hybrid search"), F.array_remove(named, "search")).otherwise(named)
    head, last = F.array_join(F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(1))), ", "), F.element_at(named, -1)
    listed = F.when(F.size(named) > 1, F.concat(head, F.lit(" and "), last)).otherwise(head)
    verb = pick(["built", "shipped", "delivered", "worked hands-on with", "put into use", "developed"], 7)
    generic = pick(["applied machine learning at work", "trained and used models", "worked with learned models", "run models for real users", "a general modelling record"], 3)
    return F.when(F.size(named) > 0, F.concat(verb, F.lit(" "), listed)).when(_t("evidence") >= 0.5, generic)


def standout() -> Column:
    """The strongest signal as a noun phrase; of equal ones the first."""
    s = lambda n: F.col(f"signals.{n}")
    github, rate, notice = s("github_activity_score"), s("recruiter_response_rate"), s("notice_period_days")
    percent = F.concat((rate * 100).cast("int").cast("string"), F.lit("% response rate"))
    days = notice.cast("int").cast("string")
    options = [
        (github > 0, F.least(github / 80, F.lit(1.0)), F.concat(F.lit("a code activity score of "), F.bround(github, 0).cast("int").cast("string"), F.lit(" of 100"))),
        (rate >= 0.5, F.least((rate - 0.4) / 0.55, F.lit(1.0)), with_article(percent)),
        (notice <= 45, F.least((60 - notice) / 60, F.lit(1.0)), F.when(notice.cast("int") == 0, "immediate availability").otherwise(F.concat(F.lit("availability within "), days, F.lit(" days")))),
        (_t("location") >= 1.0, F.lit(0.45), F.lit("a home in a hiring city")),
    ]
    return F.array_max(F.filter(F.array(*[F.when(c, F.struct(v.cast("double").alias("v"), F.lit(-i).alias("i"), p.alias("p"))) for i, (c, v, p) in enumerate(options)]), lambda x: x.isNotNull()))["p"]


def concerns() -> Column:
    """At most two, in a fixed order."""
    s = lambda n: F.col(f"signals.{n}")
    low = lambda n, v: F.coalesce(_t(n) <= v, F.lit(False))
    under = lambda n, v: F.coalesce(_t(n) < v, F.lit(False))
    notice = s("notice_period_days").cast("int").cast("string")
    each = [
        (low("domain_gate", 0.2), pick(["the main domain lies elsewhere", "most work is in another field"], 11)),
        (F.coalesce(s("notice_period_days") >= 90, F.lit(False)), F.concat(pick(["notice runs to ", "the notice period is ", "leaving takes ", "a start is off by "], 5), notice, F.lit(" days"))),
        (under("recency", 0.4), pick(["recent activity is low", "the profile has been quiet"], 9)),
        (under("location", 0.6), pick(["the location is off target", "a move would be needed", "the base is far from the hiring cities"], 2)),
        (F.coalesce(s("recruiter_response_rate") < 0.35, F.lit(False)), F.lit("replies to recruiters are rare")),
        (low("product", 0.4), pick(["the career is mostly in services", "product experience is thin"], 4)),
        (low("stability", 0.3), pick(["tenures are short", "roles change often"], 6)),
    ]
    return F.slice(F.filter(F.array(*[F.when(c, p) for c, p in each]), lambda x: x.isNotNull()), 1, 2)


def weakest_axis() -> Column:
    years = F.col("profile.years_of_experience")
    axes = [
        (_t("evidence") <= 0.6, _t("evidence"), pick(["direct evidence is limited", "evidence of built systems is light", "depth is not yet shown"], 8)),
        ((_t("seniority") <= 0.8) & ~years.between(5, 9), _t("seniority"), F.lit("experience is outside the core range")),
        ((_t("location") >= 0.6) & (_t("location") < 1.0), _t("location"), F.when(_t("location") > 0.6, "the city is a second choice").otherwise("the city is not a hiring one")),
        ((_t("product") > 0.4) & (_t("product") <= 0.6), _t("product"), F.lit("product background is unclear")),
        ((_t("stability") > 0.3) & (_t("stability") <= 0.6), _t("stability"), F.lit("tenures are on the short side")),
    ]
    return F.array_min(F.filter(F.array(*[F.when(c, F.struct(v.alias("v"), F.lit(i).alias("i"), p.alias("p"))) for i, (c, v, p) in enumerate(axes)]), lambda x: x.isNotNull()))["p"]


#: Ways to join who, what and with what, by tone of the place: leading, strong, solid.
PATTERNS = (
    ("{who} who has {what}, with {plus}", "A clear match: {who} who has {what}, backed by {plus}", "{who} at the top of the list: has {what} and shows {plus}", "Strong on every count, {who} who has {what}; adds {plus}", "{who}, proven: has {what}, complemented by {plus}", "Leads on substance: {who} who has {what}, plus {plus}"),
    ("{who} who has {what}, with {plus}", "A good match: {who} who has {what}, helped by {plus}", "{who} who has {what} and offers {plus}", "Solid record: {who} who has {what}; shows {plus}", "{who}, well suited: has {what}, along with {plus}", "Well placed: {who} who has {what}, plus {plus}"),
    ("{who} who has {what}, with {plus}", "A possible match: {who} who has {what}, with {plus}", "{who} who has {what}; brings {plus}", "Worth a look: {who} who has {what}, and {plus}", "{who}, an option: has {what}, with {plus}", "Further down, {who} who has {what}, plus {plus}"),
)


def finalize(text: Column) -> Column:
    """Single spaces and none before , ; or a full stop."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s+([,;.])", "$1")


def explained(ranked: DataFrame) -> DataFrame:
    """Adds `reasoning` to ranked rows. Parts are columns of their own, so that each is worked out once."""
    title = F.coalesce(F.nullif(F.trim(F.col("profile.current_title")), F.lit("")), F.lit("candidate"))
    years, c = F.col("profile.years_of_experience"), F.col
    shown = F.when(years == F.floor(years), years.cast("long").cast("string")).otherwise(F.format_string("%.1f", years))
    # the input's columns travel under names of their own, so that none clashes with one of the parts
    own = [x for x in ranked.columns if x != "reasoning"]
    packed = ranked.select(*[F.col(f"`{x}`").alias(f"own_{i}") for i, x in enumerate(own)], "candidate_id", "rank", "profile", "career_history", "signals", "trace")
    rows = packed.withColumns({"explain_title": title, "explain_years": shown, "explain_at": employer(), "explain_what": evidence_phrase(), "explain_plus": standout(), "explain_worries": concerns(), "explain_weak": weakest_axis()})
    rows = rows.withColumn("explain_who", F.concat(with_article(c("explain_title")), F.coalesce(F.concat(F.lit(" of "), c("explain_years"), F.lit(" years")), F.lit("")), F.coalesce(F.concat(F.lit(" at "), c("explain_at")), F.lit(""))))
    tone = F.when(c("rank") <= 15, 0).when(c("rank") <= 50, 1).otherwise(2)
    pattern = F.lit("")
    for level, patterns in enumerate(PATTERNS):
        full, bare = pick(list(patterns)), pick([p[: p.index("{what}") + 6] for p in patterns])
        pattern = F.when(tone == level, F.when(c("explain_plus").isNotNull(), full).otherwise(bare)).otherwise(pattern)
    rows = rows.withColumn("explain_pattern", pattern).withColumn("explain_turn", pick([", though ", ", but ", "; note that "], 1))
    for slot, value in (("{who}", c("explain_who")), ("{what}", F.coalesce(c("explain_what"), F.lit("a partly related record"))), ("{plus}", F.coalesce(c("explain_plus"), F.lit("")))):
        rows = rows.withColumn("explain_pattern", F.replace(c("explain_pattern"), F.lit(slot), value))
    worry = F.when(F.size("explain_worries") > 0, F.array_join("explain_worries", " and ")).when(c("rank") > 50, c("explain_weak"))
    rows = rows.withColumn("explain_text", finalize(F.concat(c("explain_pattern"), F.coalesce(F.concat(c("explain_turn"), worry), F.lit("")))))
    capital = F.concat(F.upper(F.substring("explain_text", 1, 1)), F.expr("substring(explain_text, 2)"), F.when(c("explain_text").endswith("."), "").otherwise("."))
    done = rows.withColumn("reasoning", F.when(c("explain_text") == "", "No explanation.").otherwise(capital))
    return done.select(*[F.col(f"own_{i}").alias(x) for i, x in enumerate(own)], "reasoning")
