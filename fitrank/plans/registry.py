"""All queries by name, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from ..functions.lexicon import concepts, has_any
from ..functions.scalar import evidence_texts, iso_date, month_diff, narrative
from ..operators import audit, experiments, explain, metrics, semantic, verification
from ..operators.consistency import consistency_flags
from ..operators.engagement import notice_factor, with_engagement
from ..operators.explain import explained
from ..operators.fit import chaser_penalty, domain_gate, seniority_band, stability_band, with_fit
from ..operators.ranking import rank_all, score, tie_break_violations, top_n, with_labels, without_vector
from ..profile import corpus_profile
from ..sources import readers, sinks
from ..storage import shared_path, written
from . import oracles, over_sets, over_time
from .candidate_view import candidates, table
from .pipeline import MOST_NAMED, best_of, candidate_audit, display_rows, only, rank_candidates, scored_pool, semantic_scores, usable_scores

PROFILE = corpus_profile()
#: Rows of a sweep: the feature is to re-score a ranking's best under many parameters.
SUPERSET = 2000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def token(*terms: str) -> str:
    """DuckDB's test for a whole token in lower-cased text."""
    return f"regexp_matches(lower(text), '(^|[^\\pL\\pN_])({'|'.join(sorted(terms, key=len, reverse=True))})([^\\pL\\pN_]|$)')"


def flagship(spark, sf_dir):
    """The best 25 of the candidate view, scored on texts and vectors, with their explanations."""
    return rank_candidates(_pool(spark, sf_dir), PROFILE, 25, _vectors(spark, sf_dir), _probes(spark, sf_dir)).select("candidate_id", "rank", "score", "reasoning")


def _pool(spark, sf_dir, variants=(PROFILE,)):
    """The candidate view for scoring and auditing: what documents say is found once a document."""
    return candidates(spark, sf_dir, profiles=tuple(variants))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.format_string("CAND_%07d", "vec_id").alias("candidate_id"), F.col("vec_id").alias("row_idx"), "embedding")


def _probes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 8").orderBy("vec_id").select("embedding").collect()
    return np.array([r["embedding"] for r in rows], np.float32)


# --- lexicons -------------------------------------------------------------------------------------------------

GATE = f"CASE WHEN {token(*PROFILE.positive)} THEN 1.0 WHEN {token(*PROFILE.negative)} OR ({token(*PROFILE.research)} AND NOT {token(*PROFILE.production)}) THEN 0.2 ELSE 0.6 END"
DEPTH = " + ".join(f"CAST({token(*t)} AS INT)" for t in PROFILE.concepts.values())


@query(f"SELECT doc_id, CAST({GATE} AS DOUBLE) AS gate, {token('with', 'from')} AS found FROM documents")
def lexicon_gate(spark, sf_dir):
    text = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", domain_gate(text, PROFILE).alias("gate"), has_any(text, ["with", "from"]).alias("found"))


@query(f"SELECT CAST(least({DEPTH}, 3) AS INT) AS depth, count(*) AS documents FROM documents GROUP BY 1")
def concept_depth(spark, sf_dir):
    found = concepts(F.lower("text"), PROFILE, suppress=False)
    return table(spark, sf_dir, "documents").select(audit.concept_depth(found).alias("depth")).groupBy("depth").agg(F.count("*").alias("documents"))


SUPPRESSING = PROFILE.but(negation=r"(?:\bthan|\bthe|\bof)", aspiration=r"\b(?:when|this)\b")


@query(f"SELECT doc_id, array_to_string({oracles.found('t', SUPPRESSING)}, ',') AS concepts FROM (SELECT doc_id, {oracles.FOLD.format('text')} AS t FROM documents)")
def concept_suppressed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(concepts(F.lower("text"), SUPPRESSING), ",").alias("concepts"))


COVERAGE = {f"depth {d}{'+' * (d == 3)}": f"least(len(concepts), 3) = {d}" for d in range(4)} | {"in summary": oracles.has("folded", PROFILE.off_lexicon), "in descriptions alone": "false"} | {f"term {t}": oracles.has("folded", [t]) for t in PROFILE.off_lexicon}


@query(f"""WITH {oracles.VIEW},{oracles.engagement(PROFILE)},{oracles.fit(PROFILE)}, f AS (SELECT concepts, {oracles.FOLD.format('summary')} AS folded FROM heard)
"""
    + " UNION ALL ".join(f"SELECT '{n.split(' ')[0] if n[0] in 'dt' else 'off_lexicon'}' AS section, '{n.partition(' ')[2] if n[0] in 'dt' else n}' AS item, count(*) FILTER (WHERE {c}) AS n FROM f" for n, c in COVERAGE.items())
)
def lexicon_coverage(spark, sf_dir):
    return audit.lexicon_coverage(candidates(spark, sf_dir), PROFILE)


@query(f"""WITH f AS (SELECT 'with' AS term, {token('with')} AS s FROM documents UNION ALL SELECT 'from', {token('from')} FROM documents UNION ALL SELECT 'that', {token('that')} FROM documents)
SELECT term, count(*) AS documents FROM f WHERE s GROUP BY term""")
def term_frequencies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return audit.term_frequencies(docs, ["with", "from", "that"], F.lower("text"), F.lit("")).select("term", "documents")


# --- scalars and bands ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS months, CAST(o_orderdate AS DATE) AS day, l_linenumber
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def month_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", month_diff(F.col("o_orderdate"), F.col("l_shipdate")).cast("long").alias("months"), iso_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"), "l_linenumber")


TEXT = "trim(array_to_string(list_filter(list_concat({}, titles), lambda x: x <> ''), ' '))"


@query(f"WITH {oracles.VIEW} SELECT candidate_id, {TEXT.format('[summary, headline]')} AS narrative, {TEXT.format('[summary]')} AS built, '' AS described FROM view")
def narrative_build(spark, sf_dir):
    built, described = evidence_texts()
    return candidates(spark, sf_dir).select("candidate_id", narrative().alias("narrative"), built.alias("built"), described.alias("described"))


YEARS = "abs(c_acctbal) / 700"


@query(f"SELECT c_custkey, CAST(CASE WHEN y BETWEEN 5 AND 9 THEN 1.0 WHEN y BETWEEN 4 AND 10 THEN 0.8 WHEN y BETWEEN 3 AND 12 THEN 0.5 WHEN y > 12 THEN 0.35 ELSE 0.25 END AS DOUBLE) AS seniority FROM (SELECT c_custkey, {YEARS} AS y FROM customer)")
def seniority(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", seniority_band(F.abs("c_acctbal") / 700).alias("seniority"))


@query("""WITH m AS (SELECT o_custkey, floor(o_totalprice / 20000) AS d FROM orders WHERE floor(o_totalprice / 20000) > 0),
g AS (SELECT o_custkey, count(*) AS n, avg(d) AS a FROM m GROUP BY o_custkey),
b AS (SELECT *, CASE WHEN a >= 30 THEN 1.0 WHEN a >= 24 THEN 0.85 WHEN a >= 18 THEN 0.6 WHEN a >= 12 THEN 0.4 ELSE 0.25 END AS v FROM g)
SELECT o_custkey, CAST(CASE WHEN n < 2 THEN 0.7 WHEN n >= 4 AND a < 18 THEN least(v, 0.3) ELSE v END AS DOUBLE) AS stability, CAST(CASE WHEN n >= 4 AND a < 18 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS penalty FROM b""")
def tenure_bands(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 20000).cast("double").alias("d")).where("d > 0").groupBy("o_custkey").agg(F.collect_list("d").alias("m"))
    return months.select("o_custkey", stability_band(F.col("m")).alias("stability"), chaser_penalty(F.col("m"), PROFILE).alias("penalty"))


@query("SELECT p_partkey, CASE WHEN d <= 30 THEN 1.0::DOUBLE ELSE pow(greatest(0, least(1, (180 - d) / 150)), 2) END AS notice FROM (SELECT p_partkey, CAST(p_size * 5 AS DOUBLE) AS d FROM part)")
def notice_curve(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", notice_factor((F.col("p_size") * 5).cast("double"), PROFILE).alias("notice"))


VIEW_FLAGS = """WITH n AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) + INTERVAL 22 YEAR AS d FROM orders),
o AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey), DATE '2024-02-01') AS nxt FROM n),
r AS (SELECT *, (year(nxt) - year(d)) * 12 + month(nxt) - month(d) AS m FROM o),
q AS (SELECT *, m + o_orderkey % 4 + CASE WHEN o_orderkey % 40 = 0 THEN 30 ELSE 0 END AS claimed FROM r),
c AS (SELECT o_custkey, bool_or(abs(claimed - m) > 18) AS f1, sum(claimed) AS total, min(d) AS first FROM q GROUP BY o_custkey),
s AS (SELECT o_custkey, count(*) FILTER (WHERE l_discount > 0.04 AND l_quantity < 3) >= 3 AS f2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
y AS (SELECT c_custkey, abs(c_acctbal) / 1200 + 5 AS y FROM customer),
v AS (SELECT c_custkey, coalesce(c.f1, false) AS f1, coalesce(s.f2, false) AS f2, coalesce(c.total, 0) > y * 12 + 24 AS f3, coalesce(y * 12 > (2024 - year(c.first)) * 12 + 2 - month(c.first) + 48, false) AS f4, c_custkey % 50 = 0 AS f5
  FROM y LEFT JOIN c ON c.o_custkey = c_custkey LEFT JOIN s ON s.o_custkey = c_custkey)
"""


@query(VIEW_FLAGS + "SELECT printf('CAND_%07d', c_custkey) AS candidate_id, array_to_string(list_filter([CASE WHEN f1 THEN 'tenure_impossible' END, CASE WHEN f2 THEN 'phantom_expertise' END, CASE WHEN f3 THEN 'career_exceeds_life' END, CASE WHEN f4 THEN 'experience_exceeds_career_span' END, CASE WHEN f5 THEN 'edu_inversion' END], lambda x: x IS NOT NULL), ',') AS flags FROM v")
def consistency(spark, sf_dir):
    return candidates(spark, sf_dir, texts=False).select("candidate_id", F.array_join(consistency_flags(PROFILE), ",").alias("flags"))


@query("""WITH e AS (SELECT user_id, max(CAST(ts AS DATE)) AS last, avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) AS clicks, count(*) AS n, avg(value) AS value FROM events GROUP BY user_id),
t AS (SELECT c_custkey, CASE WHEN n % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN n IS NOT NULL THEN 0.4 * CASE WHEN n * 3 <= 30 THEN 1.0::DOUBLE ELSE pow(greatest(0, least(1, (180 - n * 3) / 150)), 2) END ELSE 0 END + CASE WHEN n % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END AS availability,
  0.7 * coalesce(clicks, 0) + 0.3 * CASE WHEN value IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, (280 - value * 2) / 280)) END AS responsiveness,
  CASE WHEN last IS NULL THEN 0.3::DOUBLE ELSE greatest(0, least(1, (180 - date_diff('day', last, DATE '2024-02-01')) / 180)) END AS recency
  FROM customer LEFT JOIN e ON user_id = c_custkey)
SELECT printf('CAND_%07d', c_custkey) AS candidate_id, round(availability, 6) AS availability, round(responsiveness, 6) AS responsiveness, round(recency, 6) AS recency FROM t""")
def engagement(spark, sf_dir):
    t = with_engagement(candidates(spark, sf_dir, texts=False), PROFILE)
    return t.select("candidate_id", *[F.round(F.col(f"engagement_trace.{n}"), 6).alias(n) for n in ("availability", "responsiveness", "recency")])


PARTS = ("availability", "responsiveness", "recency", "credibility")


@query(f"WITH {oracles.VIEW},{oracles.engagement(PROFILE)} SELECT candidate_id, round(multiplier, 6) AS multiplier, {', '.join(f'round({n}, 6) AS {n}' for n in PARTS)} FROM engaged")
def engagement_multiplier(spark, sf_dir):
    rows = with_engagement(candidates(spark, sf_dir, texts=False), PROFILE)
    return rows.select("candidate_id", F.round("multiplier", 6).alias("multiplier"), *[F.round(f"engagement_trace.{n}", 6).alias(n) for n in PARTS])


FEATURES = ("evidence", "domain_gate", "title_gate", "domain_title_gate", "technical", "seniority", "product", "location", "education", "stability", "chaser_penalty", "fit")


@query(f"WITH {oracles.VIEW},{oracles.engagement(PROFILE)},{oracles.fit(PROFILE)} SELECT candidate_id, n_concepts, has_disclaimer, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in FEATURES)} FROM fitted")
def fit_trace(spark, sf_dir):
    rows = with_fit(_pool(spark, sf_dir).withColumn("semantic", F.lit(None).cast("double")), PROFILE)
    t = lambda n: F.col(f"fit_trace.{n}")
    return rows.select("candidate_id", F.size(t("evidence_concepts")).cast("long").alias("n_concepts"), t("has_disclaimer").alias("has_disclaimer"), *[F.round(t(n), 6).alias(n) for n in FEATURES])


# --- vectors ---------------------------------------------------------------------------------------------------

SIMS = """WITH p AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 8), s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], q) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q)) + 1e-9) AS c FROM embeddings, p),
k AS (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) AS r FROM s), m AS (SELECT vec_id, greatest(0, avg(c)) AS sim FROM k WHERE r <= 3 GROUP BY vec_id)
"""


@query(SIMS + "SELECT vec_id, round(sim, 6) AS sim FROM m")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(semantic.cosine_topk(F.col("embedding"), _probes(spark, sf_dir).tolist(), 3), 6).alias("sim"))


@query(SIMS + "SELECT vec_id, CAST(CAST((row_number() OVER (ORDER BY round(sim, 6), vec_id) - 1) / ((SELECT count(*) FROM m) - 1) AS REAL) AS DOUBLE) AS semantic FROM m")
def semantic_percentile(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.round(semantic.cosine_topk(F.col("embedding"), _probes(spark, sf_dir).tolist(), 3), 6).alias("raw"))
    return semantic.pool_percentile(v, "raw", "vec_id").select("vec_id", "semantic")


@query(f"WITH {oracles.SEMANTIC} SELECT candidate_id, round(raw, 4) AS raw, semantic FROM semantic")
def semantic_matrix(spark, sf_dir):
    v = semantic.similarity(_vectors(spark, sf_dir), _probes(spark, sf_dir)).select("candidate_id", "row_idx", "raw")
    return semantic.pool_percentile(v).select("candidate_id", F.round(F.col("raw").cast("double"), 4).alias("raw"), "semantic")


# --- ranking ---------------------------------------------------------------------------------------------------


@query()
def rank_topn(spark, sf_dir):
    return flagship(spark, sf_dir)


RANKED = f"SELECT candidate_id, CAST(row_number() OVER (ORDER BY {oracles.round6('score')} DESC, candidate_id) AS INTEGER) AS rank, {oracles.round6('score')} AS score FROM"
#: Scores with the pool percentile of the vectors.
WITH_SEMANTIC = f"""{oracles.scores(PROFILE)},{oracles.SEMANTIC},
both_scores AS (SELECT f.candidate_id, CASE WHEN flagged THEN 0 ELSE (fit / chaser_penalty - {PROFILE.weights["technical"]}::DOUBLE * technical
  + {PROFILE.weights["technical"]}::DOUBLE * (CASE WHEN semantic IS NULL THEN evidence ELSE {1 - PROFILE.semantic_share}::DOUBLE * evidence + {PROFILE.semantic_share}::DOUBLE * semantic END) * gate) * chaser_penalty * multiplier END AS score
  FROM fitted f JOIN engaged USING (candidate_id) JOIN flags USING (candidate_id) LEFT JOIN semantic s ON s.candidate_id = f.candidate_id)
"""


@query(oracles.scores(PROFILE) + RANKED + " scored")
def rank_full(spark, sf_dir):
    return rank_all(score(_pool(spark, sf_dir), PROFILE))


@query(f"{WITH_SEMANTIC}{RANKED} both_scores ORDER BY rank LIMIT 100")
def rank_hundred(spark, sf_dir):
    """The best hundred on texts and vectors."""
    return rank_candidates(_pool(spark, sf_dir), PROFILE, 100, _vectors(spark, sf_dir), _probes(spark, sf_dir)).select("candidate_id", "rank", "score")


@query(f"{WITH_SEMANTIC}{RANKED} both_scores ORDER BY rank LIMIT 25")
def rank_headline(spark, sf_dir):
    """The flagship's rows without their wording."""
    return flagship(spark, sf_dir).drop("reasoning")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY round(c_acctbal, 0) DESC, c_custkey) AS BIGINT) AS rank, round(c_acctbal, 0) AS score FROM customer")
def rank_customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 0).alias("score"))
    return rank_all(rows, "c_custkey").select("c_custkey", F.col("rank").cast("long").alias("rank"), "score")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS BIGINT) AS rank FROM part ORDER BY rank LIMIT 100")
def top_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("score"))
    return top_n(rows, 100, "p_partkey").select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query(f"""{oracles.scores(PROFILE)}, r AS ({RANKED} scored ORDER BY rank LIMIT 100), l AS (SELECT *, lag(score) OVER (ORDER BY rank) AS s, lag(candidate_id) OVER (ORDER BY rank) AS i FROM r)
SELECT count(*) FILTER (WHERE score > s OR (score = s AND candidate_id < i)) AS violations, count(*) AS ranked FROM l""")
def tie_break_check(spark, sf_dir):
    ranked = written(top_n(scored_pool(_pool(spark, sf_dir), PROFILE), 100).select("candidate_id", "rank", "score"), "ranked")
    return tie_break_violations(ranked).agg(F.count("*").alias("violations")).join(ranked.agg(F.count("*").alias("ranked")), F.lit(True))


@query("""WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS score, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 100),
l AS (SELECT *, lag(score) OVER (ORDER BY rank) AS s, lag(p_partkey) OVER (ORDER BY rank) AS i FROM r) SELECT p_partkey, CAST(rank AS INTEGER) AS rank FROM l WHERE score > s OR (score = s AND p_partkey < i)""")
def tie_break_violators(spark, sf_dir):
    """Rows out of order where a ranking goes by another value than it should."""
    best = top_n(table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("score")), 100, "p_partkey")
    return tie_break_violations(best.withColumn("score", F.col("p_size").cast("double")), "p_partkey").select("p_partkey", "rank")


@query()
def explanation(spark, sf_dir):
    return rank_candidates(_pool(spark, sf_dir), PROFILE, 100).select("candidate_id", "rank", "reasoning")


def _picked(options: tuple[str, ...], salt: int) -> str:
    """DuckDB's choice by the id's number."""
    return f"([{', '.join(oracles.quoted(o) for o in options)}])[CAST((k + {salt}) % {len(options)} AS INT) + 1]"


CONCERNS = f"""[CASE WHEN domain_gate <= 0.2 THEN {_picked(("the main domain lies elsewhere", "most work is in another field"), 11)} END,
CASE WHEN notice >= 90 THEN {_picked(("notice runs to ", "the notice period is ", "leaving takes ", "a start is off by "), 5)} || notice || ' days' END,
CASE WHEN recency < 0.4 THEN {_picked(("recent activity is low", "the profile has been quiet"), 9)} END,
CASE WHEN location < 0.6 THEN {_picked(("the location is off target", "a move would be needed", "the base is far from the hiring cities"), 2)} END,
CASE WHEN rate < 0.35 THEN 'replies to recruiters are rare' END,
CASE WHEN product <= 0.4 THEN {_picked(("the career is mostly in services", "product experience is thin"), 4)} END,
CASE WHEN stability <= 0.3 THEN {_picked(("tenures are short", "roles change often"), 6)} END]"""
STANDOUT = """[CASE WHEN github > 0 THEN {'v': least(github / 80, 1), 'i': 0, 'p': 'a code activity score of ' || CAST(round_even(github, 0) AS INT) || ' of 100'} END,
CASE WHEN rate >= 0.5 THEN {'v': least((rate - 0.4) / 0.55, 1), 'i': -1, 'p': CASE WHEN trunc(rate * 100) BETWEEN 80 AND 89 THEN 'an ' ELSE 'a ' END || CAST(trunc(rate * 100) AS INT) || '% response rate'} END,
CASE WHEN notice <= 45 THEN {'v': least((60 - notice) / 60, 1), 'i': -2, 'p': CASE WHEN notice = 0 THEN 'immediate availability' ELSE 'availability within ' || notice || ' days' END} END,
CASE WHEN location >= 1 THEN {'v': 0.45, 'i': -3, 'p': 'a home in a hiring city'} END]"""


@query(f"""{oracles.scores(PROFILE)}, r AS ({RANKED} scored ORDER BY rank LIMIT 100),
p AS (SELECT r.candidate_id, r.rank, v.k, v.title, f.domain_gate, f.location, f.product, f.stability, e.recency, CASE WHEN v.seen THEN v.n_events * 3 END AS notice, CASE WHEN v.seen THEN v.clicks END AS rate, CASE WHEN v.seen THEN least(v.value, 100) END AS github
  FROM r JOIN view v USING (candidate_id) JOIN fitted f USING (candidate_id) JOIN engaged_parts e USING (candidate_id))
SELECT candidate_id, rank, CASE WHEN regexp_matches(lower(title), '^(ai|ml|nlp|ir|ux|ui|sre|mle|llm) ') OR regexp_matches(lower(title), '^[aeiou]') THEN 'an' ELSE 'a' END AS article, CAST(k AS BIGINT) AS number,
  array_to_string(list_filter({CONCERNS}, lambda x: x IS NOT NULL)[1:2], '; ') AS concerns, list_max(list_filter({STANDOUT}, lambda x: x IS NOT NULL)).p AS standout FROM p""")
def explanation_parts(spark, sf_dir):
    """What the hundred explanations are made of, apart from their wording: the article of the title, the id's number, the
    concerns and the strongest signal."""
    pool = _pool(spark, sf_dir)
    best = best_of(scored_pool(pool, PROFILE), pool, 100)
    return best.select("candidate_id", "rank", explain.article(F.col("profile.current_title")).alias("article"), explain.id_number().cast("long").alias("number"), F.array_join(explain.concerns(), "; ").alias("concerns"), explain.standout().alias("standout"))


@query()
def explanation_distinct(spark, sf_dir):
    return verification.distinct_reasons(rank_candidates(_pool(spark, sf_dir), PROFILE, 100))


@query()
def display(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return display_rows(explained(best_of(scored_pool(pool, PROFILE), pool, 100)))


@query(f"""{oracles.scores(PROFILE)}, r AS ({RANKED} scored ORDER BY rank LIMIT 100)
SELECT rank, candidate_id, title, printf('%.1f yrs', yoe) AS experience, printf('%.6f', score) AS score FROM r JOIN view USING (candidate_id)""")
def leaderboard(spark, sf_dir):
    """What a leaderboard shows, without wording."""
    pool = _pool(spark, sf_dir)
    return display_rows(best_of(scored_pool(pool, PROFILE), pool, 100).withColumn("reasoning", F.lit(None).cast("string"))).drop("reasoning")


@query(f"""{oracles.scores(PROFILE)}, r AS ({RANKED} scored ORDER BY rank LIMIT 3)
SELECT candidate_id, rank, title AS current_title, place AS location, round(yoe, 6) AS years, n_roles AS roles, {', '.join(f'round({n}, 6) AS {n}' for n in ("availability", "responsiveness", "recency", "credibility"))}, round(multiplier, 6) AS mult, score
FROM r JOIN view USING (candidate_id) JOIN engaged_parts USING (candidate_id) JOIN (SELECT candidate_id, multiplier FROM engaged) USING (candidate_id)""")
def audited_rows(spark, sf_dir):
    """The first three ranked rows, each looked up by its id: profile, roles and parts of the trace."""
    pool = _pool(spark, sf_dir)
    ranked = written(best_of(scored_pool(pool, PROFILE), pool, 3), "ranked")
    found = [candidate_audit(ranked, r["candidate_id"]) for r in ranked.select("candidate_id").collect()]  # three rows
    parts = [F.round(n, 6).alias(n) for n in ("availability", "responsiveness", "recency", "credibility", "mult")]
    rows = reduce(lambda a, b: a.unionByName(b), found)
    return rows.select("candidate_id", "rank", "profile.current_title", "profile.location", F.round("profile.years_of_experience", 6).alias("years"), F.size("career_history").cast("long").alias("roles"), *parts, F.round("score", 6).alias("score"))


@query()
def audit_lookup(spark, sf_dir):
    """The first-ranked row with its profile, signals and trace."""
    pool = _pool(spark, sf_dir)
    scored = scored_pool(pool, PROFILE)
    first = top_n(scored, 1).first()
    return candidate_audit(best_of(scored, pool, 1), first["candidate_id"] if first else "").drop("profile", "career_history", "signals", "evidence_concepts", "honeypot")


@query("SELECT printf('CAND_%07d', c_custkey) AS candidate_id FROM customer WHERE c_custkey NOT IN (SELECT vec_id FROM embeddings)")
def coverage_anti(spark, sf_dir):
    return without_vector(candidates(spark, sf_dir).select("candidate_id"), _vectors(spark, sf_dir))


@query("SELECT printf('CAND_%07d', doc_id) AS candidate_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labels(spark, sf_dir):
    name = F.format_string("CAND_%07d", "doc_id").alias("candidate_id")
    return with_labels(table(spark, sf_dir, "documents").select(name, "lang"), table(spark, sf_dir, "labels").select(name))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS rr, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey * 3 END AS d, c_custkey % 2 = 0 AS otw, c_custkey * 11 % 60 AS notice, c_custkey % 5 > 0 AS loc, c_custkey % 3 = 0 AS tgt, c_custkey % 4 / 4 AS sen, c_custkey % 6 / 6 AS stab,
  row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS rank FROM customer), x AS (SELECT * FROM s WHERE rank > 100), y AS (SELECT * FROM s WHERE rank <= 100)
SELECT x.c_custkey AS excluded, y.c_custkey AS included FROM x, y WHERE coalesce(x.rr, 0) >= coalesce(y.rr, 0) AND coalesce(x.d, 999) <= coalesce(y.d, 999) + 15 AND (x.otw OR NOT y.otw) AND x.notice <= y.notice + 15 AND x.loc AND (x.tgt OR NOT y.tgt) AND x.sen >= y.sen AND x.stab >= y.stab""")
def dominance_join(spark, sf_dir):
    k = F.col("c_custkey")
    axes = [F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("rr"), F.when(k % 7 > 0, F.col("c_nationkey") * 3).alias("active_days"), (k % 2 == 0).alias("otw"), (k * 11 % 60).alias("notice"), (k % 5 > 0).alias("location_ok"), (k % 3 == 0).alias("in_target"), (k % 4 / 4).alias("seniority"), (k % 6 / 6).alias("stability")]
    s = table(spark, sf_dir, "customer").select(k.alias("candidate_id"), F.col("c_nationkey").cast("double").alias("score"), *axes)
    included = written(top_n(s, 100), "included")
    return audit.dominance(included, s.join(F.broadcast(included.select("candidate_id")), "candidate_id", "left_anti"))


# --- audit and aggregates --------------------------------------------------------------------------------------

RANKED_DOCS = "SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents"


def ranked_docs(spark, sf_dir, *keep):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), *keep)
    return rank_all(rows, "doc_id", keep)


@query(f"SELECT lang, count(*) AS pool, count(*) FILTER (WHERE rank <= 10) AS top_10, count(*) FILTER (WHERE rank <= 50) AS top_50, count(*) FILTER (WHERE rank <= 100) AS top_100 FROM ({RANKED_DOCS}) GROUP BY lang")
def arch_counts(spark, sf_dir):
    return audit.counts_at(ranked_docs(spark, sf_dir, "lang"), "lang")


CLASSES = oracles.classes(PROFILE, audit)


@query(f"""{CLASSES} SELECT CASE WHEN NOT reachable THEN 'unreachable' WHEN disqualified THEN 'disqualified' WHEN NOT in_band THEN 'out-of-band(yoe)' WHEN NOT location_ok THEN 'out-of-location' ELSE 'CLEAN-MISS' END AS reason, count(*) AS n FROM classes GROUP BY 1""")
def reason_counts(spark, sf_dir):
    return audit.classify(_pool(spark, sf_dir), PROFILE).groupBy(audit.exclusion_reason().alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, max(CASE WHEN i = n // 2 THEN o_totalprice END) AS median, max(o_totalprice) - min(o_totalprice) AS spread FROM p GROUP BY 1""")
def upper_median(spark, sf_dir):
    return audit.upper_median(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


@query(f"""SELECT CASE WHEN rank <= 10 THEN '1-10' WHEN rank <= 50 THEN '11-50' ELSE '51-100' END AS bucket, avg(n_chars) AS mean, count(*) AS n FROM ({RANKED_DOCS}) WHERE rank <= 100 GROUP BY 1""")
def bucket_means(spark, sf_dir):
    return audit.bucket_means(ranked_docs(spark, sf_dir, "n_chars"), "n_chars")


@query("""WITH r AS (SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS DOUBLE) AS d FROM part)
SELECT p_brand, round(CASE WHEN count(*) > 1 THEN 1 - 6 * sum(d * d) / (count(*) * (count(*)::DOUBLE * count(*) - 1)) END, 9) AS rho FROM r GROUP BY p_brand""")
def spearman(spark, sf_dir):
    rows = audit.spearman(table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_size", "p_partkey"), [F.col("p_retailprice"), F.col("p_partkey")], [F.col("p_size"), F.col("p_partkey")], "p_brand")
    return rows.select("p_brand", F.round("rho", 9).alias("rho"))


@query("""WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 3000), b AS (SELECT doc_id FROM documents WHERE lang = 'en'),
n AS (SELECT (SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)) AS common, (SELECT count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)) AS united)
SELECT common, united, round(common / united, 9) AS jaccard FROM n""")
def jaccard_topk(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return audit.jaccard(d.where("n_chars > 3000"), d.where("lang = 'en'"), "doc_id").withColumn("jaccard", F.round("jaccard", 9))


@query("""SELECT doc_id, 'entered' AS change FROM documents WHERE lang = 'en' AND NOT n_chars > 3000 UNION ALL SELECT doc_id, 'left' FROM documents WHERE n_chars > 3000 AND lang <> 'en'""")
def id_churn(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return audit.churn(d.where("n_chars > 3000"), d.where("lang = 'en'"), "doc_id")


FLAGS = ("in_band", "services_only", "kw_stuffer", "cv_primary", "pure_research", "framework_dabbler", "noneng_title", "in_target", "location_ok", "reachable", "otw", "honeypot", "disqualified", "coherent", "coherent_fit")
VALUES = ("yoe", "rr", "notice", "avg_tenure", "seniority", "stability", "strength")


@query(f"{CLASSES} SELECT candidate_id, arch, grade, grade_summary, CAST(active_days AS INTEGER) AS active_days, {', '.join(FLAGS)}, {', '.join(f'round(CAST({v} AS DOUBLE), 6) AS {v}' for v in VALUES)} FROM classes")
def audit_classes(spark, sf_dir):
    rows = audit.classify(_pool(spark, sf_dir), PROFILE)
    return rows.select("candidate_id", "arch", "grade", "grade_summary", "active_days", *FLAGS, *[F.round(v, 6).alias(v) for v in VALUES])


def _classes_and_ranking(spark, sf_dir):
    """Classes of the pool and its best hundred, from one pass over the candidates."""
    rows = written(audit.classify(score(_pool(spark, sf_dir), PROFILE), PROFILE, ("score",)), "classes")
    return rows.drop("score"), top_n(rows.select("candidate_id", "score"), 100).select("candidate_id", "rank", "score")


#: Classes of the view with the rank of the best hundred.
MEMBERS = f"""{oracles.scores(PROFILE)}, ranking AS ({RANKED} scored ORDER BY rank LIMIT 100),
{CLASSES[CLASSES.index("c_text AS"):]},
m AS (SELECT c.*, r.rank FROM classes c LEFT JOIN ranking r USING (candidate_id))
"""


@query(MEMBERS + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER (WHERE {g}) AS pool, count(*) FILTER (WHERE {g} AND rank IS NOT NULL) AS top, coalesce(string_agg(candidate_id, ',' ORDER BY rank) FILTER (WHERE {g} AND rank IS NOT NULL), '') AS ids FROM m" for g in verification.GATES))
def gate_counts(spark, sf_dir):
    return verification.gate_counts(verification.members(*_classes_and_ranking(spark, sf_dir)))


@query(MEMBERS + """SELECT CASE WHEN rank IS NULL THEN 'excluded fit' ELSE 'weaker included' END AS cohort, count(*) AS n, round(avg(rr), 6) AS response, round(avg(active_days), 6) AS active_days, round(avg(CAST(otw AS INT)), 6) AS open, round(avg(notice), 6) AS notice, round(avg(CAST(in_target AS INT)), 6) AS in_target
FROM m WHERE (rank IS NULL AND coherent_fit) OR (rank IS NOT NULL AND NOT coherent) GROUP BY 1""")
def cohort_means(spark, sf_dir):
    rows = verification.cohorts(verification.members(*_classes_and_ranking(spark, sf_dir)))
    return rows.select("cohort", "n", *[F.round(c, 6).alias(c) for c in ("response", "active_days", "open", "notice", "in_target")])


_ITEMS = {"pool": "true", "ranked": "i", "coherent in": "coherent AND i", "coherent out": "coherent AND NOT i", "weaker in": "NOT coherent AND i", "fit": "coherent_fit", "fit in": "coherent_fit AND i", "fit out": "coherent_fit AND NOT i", "elite": "e", "elite reachable": "e AND reachable", "elite in": "e AND i", "elite reachable out": "e AND reachable AND NOT i", "elite unreachable out": "e AND NOT reachable AND NOT i", "strong wording in": "NOT coherent AND grade = 'STRONG' AND i", "strong wording out": "NOT coherent AND grade = 'STRONG' AND NOT i"}


def _tall(section: str, rows: str, item: str, *values: str) -> list[str]:
    return [f"SELECT '{section}' AS section, {item} || ' {v}' AS item, round(CAST({v} AS DOUBLE), 6) AS value FROM ({rows})" for v in values]


@query(f"""{MEMBERS}, p AS (SELECT *, rank IS NOT NULL AS i, arch = 'ELITE' AS e FROM m),
sw AS (SELECT x.candidate_id AS excluded, y.candidate_id AS included FROM m x JOIN m y ON x.rank IS NULL AND x.coherent_fit AND y.rank IS NOT NULL AND NOT y.coherent AND coalesce(x.rr, 0) >= coalesce(y.rr, 0) AND coalesce(x.active_days, 999) <= coalesce(y.active_days, 999) + 15 AND (x.otw OR NOT y.otw)
  AND coalesce(x.notice, 999) <= coalesce(y.notice, 999) + 15 AND x.location_ok AND (x.in_target OR NOT y.in_target) AND x.seniority >= y.seniority AND x.stability >= y.stability),
so AS (SELECT CAST(rank - row_number() OVER (ORDER BY strength DESC, rank) AS DOUBLE) AS d FROM m WHERE rank IS NOT NULL)
"""
    + " UNION ALL ".join([
        *_tall("archetypes", "SELECT arch, count(*) AS pool, count(*) FILTER (WHERE rank <= 10) AS top_10, count(*) FILTER (WHERE rank <= 50) AS top_50, count(*) FILTER (WHERE rank <= 100) AS top_100 FROM m GROUP BY arch", "arch", "pool", "top_10", "top_50", "top_100"),
        *_tall("grades", "SELECT grade, count(*) AS n FROM m WHERE rank IS NOT NULL GROUP BY grade", "grade", "n"),
        *[x for g in verification.GATES for x in _tall("gates", f"SELECT count(*) FILTER (WHERE {g}) AS pool, count(*) FILTER (WHERE {g} AND rank IS NOT NULL) AS top FROM m", f"'{g}'", "pool", "top")],
        *[x for n, c in _ITEMS.items() for x in _tall("placements", f"SELECT count(*) FILTER (WHERE {c}) AS n FROM p", f"'{n}'", "n")],
        *_tall("reasons", "SELECT CASE WHEN NOT reachable THEN 'unreachable' WHEN disqualified THEN 'disqualified' WHEN NOT in_band THEN 'out-of-band(yoe)' WHEN NOT location_ok THEN 'out-of-location' ELSE 'CLEAN-MISS' END AS reason, count(*) AS n FROM m WHERE coherent AND rank IS NULL GROUP BY 1", "reason", "n"),
        *_tall("strength", "SELECT CASE WHEN rank <= 10 THEN '1-10' WHEN rank <= 50 THEN '11-50' ELSE '51-100' END AS bucket, avg(strength) AS mean FROM m WHERE rank IS NOT NULL GROUP BY 1", "bucket", "mean"),
        *_tall("strength", "SELECT 1 - 6 * sum(d * d) / (count(*) * (count(*)::DOUBLE * count(*) - 1)) AS rho FROM so", "'order'", "rho"),
        *_tall("swaps", "SELECT count(*) AS pairs, count(DISTINCT excluded) AS excluded, count(DISTINCT included) AS included FROM sw", "'distinct'", "pairs", "excluded", "included"),
        *_tall("cohorts", "SELECT CASE WHEN rank IS NULL THEN 'excluded fit' ELSE 'weaker included' END AS cohort, count(*) AS n, avg(rr) AS response, avg(active_days) AS active_days, avg(CAST(otw AS INT)) AS open, avg(notice) AS notice, avg(CAST(in_target AS INT)) AS in_target FROM m WHERE (rank IS NULL AND coherent_fit) OR (rank IS NOT NULL AND NOT coherent) GROUP BY 1", "cohort", "n", "response", "active_days", "open", "notice", "in_target"),
    ])
)
def verification_rows(spark, sf_dir):
    report = verification.verification(*_classes_and_ranking(spark, sf_dir))
    return report.withColumn("value", F.round("value", 6))


# --- metrics and experiments -----------------------------------------------------------------------------------

REL = "CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 1 ELSE 0 END"
LISTS = f"""WITH l AS (SELECT d.source AS "group", row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS pos, {REL} AS rel FROM labels JOIN documents d USING (doc_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY rel DESC, pos) AS best, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY "group" ORDER BY pos) AS hits FROM l),
g AS (SELECT "group", sum((pow(2, rel) - 1) / log2(pos + 1)) AS dcg, {", ".join(f'sum(CASE WHEN pos <= {k} THEN (pow(2, rel) - 1) / log2(pos + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN best <= {k} THEN (pow(2, rel) - 1) / log2(best + 1) ELSE 0 END) AS i{k}, count(*) FILTER (WHERE pos <= {k} AND rel >= 3) / {k} AS p{k}' for k in (10, 50))},
  CASE WHEN count(*) FILTER (WHERE rel >= 1) > 0 THEN sum(CASE WHEN rel >= 1 THEN hits / pos ELSE 0 END) / count(*) FILTER (WHERE rel >= 1) ELSE 0 END AS ap FROM w GROUP BY "group")
"""


def labelled_lists(spark, sf_dir):
    rel = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 3).when(F.col("quality") == 1, 1).otherwise(0)
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id").select(F.col("source").alias("group"), "n_chars", "doc_id", rel.alias("rel"))
    return metrics.positions(rows, "group", [F.desc("n_chars"), F.col("doc_id")])


@query(LISTS + 'SELECT "group", round(dcg, 9) AS dcg FROM g')
def dcg(spark, sf_dir):
    return metrics.dcg(labelled_lists(spark, sf_dir)).withColumn("dcg", F.round("dcg", 9))


@query(LISTS + """, n AS (SELECT "group", CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END AS n10, CASE WHEN i50 > 0 THEN d50 / i50 ELSE 0 END AS n50, p10, p50, ap FROM g)
SELECT "group", round(n10, 9) AS ndcg_10, round(n50, 9) AS ndcg_50, round(p10, 9) AS p_10, round(p50, 9) AS p_50, round(ap, 9) AS ap, round(0.5 * n10 + 0.3 * n50 + 0.15 * ap + 0.05 * p10, 9) AS composite FROM n""")
def ranking_metrics(spark, sf_dir):
    m = metrics.all_metrics(labelled_lists(spark, sf_dir))
    return m.select("group", *[F.round(c, 9).alias(c) for c in m.columns if c != "group"])


def _features(spark, sf_dir):
    rows = labelled_lists(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("id"), "rel", (F.col("n_chars") / 4000).alias("length"), ((F.col("doc_id") * 7 % 100) / 100).alias("hash"), F.lit(1.0).alias("mult"), F.col("doc_id").alias("input_pos"))


@query(f"""WITH d AS (SELECT doc_id, {REL} AS rel, n_chars / 4000 AS length, (doc_id * 7 % 100) / 100 AS hash FROM labels JOIN documents USING (doc_id)),
s AS (SELECT CAST(w AS INTEGER) AS weight_id, doc_id, rel, w / 10 * length + (1 - w / 10) * hash AS score FROM d, range(11) AS r(w)),
p AS (SELECT *, row_number() OVER (PARTITION BY weight_id ORDER BY score DESC, doc_id) AS pos FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY weight_id ORDER BY rel DESC, pos) AS best, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY weight_id ORDER BY pos) AS hits FROM p),
g AS (SELECT weight_id, {", ".join(f'sum(CASE WHEN pos <= {k} THEN (pow(2, rel) - 1) / log2(pos + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN best <= {k} THEN (pow(2, rel) - 1) / log2(best + 1) ELSE 0 END) AS i{k}' for k in (10, 50))}, count(*) FILTER (WHERE pos <= 10 AND rel >= 3) / 10 AS p10,
  sum(CASE WHEN rel >= 1 THEN hits / pos ELSE 0 END) / greatest(1, count(*) FILTER (WHERE rel >= 1)) AS ap FROM w GROUP BY weight_id)
SELECT weight_id, round(0.5 * coalesce(d10 / nullif(i10, 0), 0) + 0.3 * coalesce(d50 / nullif(i50, 0), 0) + 0.15 * ap + 0.05 * p10, 9) AS composite FROM g""")
def weight_sweep(spark, sf_dir):
    weights = spark.createDataFrame([(i, i / 10, 1 - i / 10) for i in range(11)], "weight_id int, length double, hash double")
    return experiments.evaluate_weights(_features(spark, sf_dir), weights).withColumn("composite", F.round("composite", 9))


@query()
def weight_tuning(spark, sf_dir):
    best, top = experiments.tune(experiments.labelled_rows(_features(spark, sf_dir), "input_pos"), {"length": 0.5, "hash": 0.5})
    return spark.createDataFrame([(k, v, float(top)) for k, v in best.items()], "weight string, value double, composite double")


def _superset(spark, sf_dir):
    """The best of the pool on texts and vectors, with their percentiles."""
    pool = _pool(spark, sf_dir)
    semantic = usable_scores(_vectors(spark, sf_dir), _probes(spark, sf_dir))
    best = written(top_n(scored_pool(pool, PROFILE, semantic), SUPERSET).select("candidate_id", "rank", "score"), "superset")
    superset = only(pool, best, SUPERSET)
    return best, superset.withColumn("semantic", F.lit(None).cast("double")) if semantic is None else superset.join(semantic, "candidate_id", "left")


_PERTURBED = [(label, experiments._parameters(p)) for label, p in [("", PROFILE), *experiments.perturbations(PROFILE)]]
_MIX = "concat_ws(' ', " + ", ".join(f"count(*) FILTER (WHERE rank <= 10 AND arch = '{n}') || '{n[0]}'" for n in [*PROFILE.loose_archetypes, "other"]) + ")"


@query(f"""{WITH_SEMANTIC},{oracles.swept(PROFILE, _PERTURBED, 'both_scores', SUPERSET)},
base AS (SELECT candidate_id, rank AS base_rank FROM tops WHERE label = ''), base_mix AS (SELECT {_MIX} AS base_mix FROM tops WHERE label = ''),
m AS (SELECT t.*, base_rank FROM tops t LEFT JOIN base USING (candidate_id) WHERE label <> ''),
g AS (SELECT label, {", ".join(f"round(count(*) FILTER (WHERE rank <= {k} AND base_rank <= {k}) / (2 * count(*) FILTER (WHERE rank <= {k}) - count(*) FILTER (WHERE rank <= {k} AND base_rank <= {k})), 9) AS jaccard_{k}" for k in (10, 50, 100))},
  count(*) FILTER (WHERE score = 0) AS flagged, count(*) FILTER (WHERE rank <= 10 AND rank = base_rank) = count(*) FILTER (WHERE rank <= 10) AS same_top, {_MIX} AS mix FROM m GROUP BY label)
SELECT g.*, mix = base_mix AS same_mix FROM g, base_mix""")
def perturb_sweep(spark, sf_dir):
    rows = experiments.sweep(_superset(spark, sf_dir)[1], PROFILE)
    return rows.withColumns({c: F.round(c, 9) for c in rows.columns if c.startswith("jaccard")})


@query(f"{WITH_SEMANTIC}, b AS ({RANKED} both_scores ORDER BY rank LIMIT {SUPERSET}) SELECT round(max(CASE WHEN rank = 100 THEN score END) - min(score), 5) AS gap FROM b")
def superset_gap(spark, sf_dir):
    return experiments.superset_gap(_superset(spark, sf_dir)[0]).withColumn("gap", F.round("gap", 5))


#: The profile, one concept with more words, and a bonus for good assessments.
VARIANTS = [("base", PROFILE), ("words", PROFILE.but(concepts={"with": ["with", "with the", "and", "and the"]})), ("assessed", PROFILE.but(assessment_bonus=0.1))]


def _labelled_candidates(spark, sf_dir):
    rel = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 3).when(F.col("quality") == 1, 1).otherwise(0)
    return table(spark, sf_dir, "labels").select(F.format_string("CAND_%07d", "doc_id").alias("candidate_id"), rel.alias("rel"))


@query()
def impact(spark, sf_dir):
    return experiments.impact(_pool(spark, sf_dir, [p for _, p in VARIANTS]), _labelled_candidates(spark, sf_dir), VARIANTS, semantic_scores(_vectors(spark, sf_dir), _probes(spark, sf_dir)))


@query()
def impact_bootstrap(spark, sf_dir):
    labels = _labelled_candidates(spark, sf_dir)
    n = labels.count()
    semantic = written(semantic_scores(_vectors(spark, sf_dir), _probes(spark, sf_dir)), "semantic")
    among = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    labelled = candidates(spark, sf_dir, profiles=tuple(p for _, p in VARIANTS), among=among, semantic=semantic)
    if n <= MOST_NAMED:
        labelled = only(labelled, labels, n)
    rows = experiments.variant_scores(labelled.join(labels, "candidate_id"), VARIANTS)
    return experiments.bootstrap(rows, ["words", "assessed"])


@query()
def bootstrap_ci(spark, sf_dir):
    rows = _features(spark, sf_dir).select("id", "rel", F.col("length").alias("base"), F.col("hash").alias("variant"))
    return experiments.bootstrap(rows, ["variant"])


# --- sources and sinks -----------------------------------------------------------------------------------------


def _people(spark, sf_dir):
    """Suppliers as records of the source formats, one in ten without an id."""
    k = F.col("s_suppkey")
    profile = F.struct(F.col("s_name").alias("summary"), F.concat(F.lit("headline "), k).alias("headline"), (F.col("s_acctbal") / 1000).alias("years_of_experience"), F.concat(F.lit("City "), F.col("s_nationkey")).alias("location"))
    role = F.struct(F.concat(F.lit("Title "), k).alias("title"), F.lit("did things").alias("description"), F.lit("2020-01-01").alias("start_date"), (k % 50).alias("duration_months"), (k % 2 == 0).alias("is_current"))
    signals = F.struct((k % 3 == 0).alias("open_to_work_flag"), F.when(k % 4 > 0, k % 120).alias("notice_period_days"), F.create_map(F.lit("skill"), k % 100).alias("skill_assessment_scores"))
    skills = F.array(F.struct(F.lit("sql").alias("name"), F.lit("expert").alias("proficiency"), F.when(k % 5 == 0, F.lit(12)).alias("duration_months")))
    return table(spark, sf_dir, "supplier").select(k, F.when(k % 10 > 0, F.concat(F.lit("S"), k)).alias("candidate_id"), profile.alias("profile"), F.array(role).alias("career_history"), skills.alias("skills"), signals.alias("acme_signals"))


def _json_lines(spark, sf_dir):
    """The path of a file of JSON lines in order of the key, with blank and broken lines and lines that are no objects."""
    path = f"{shared_path(spark, 'people')}.jsonl"
    line = F.to_json(F.struct("candidate_id", "profile", "career_history", "skills", "acme_signals"))
    broken = F.when(F.col("s_suppkey") % 4 == 0, F.array(line, F.lit("not json"))).when(F.col("s_suppkey") % 4 == 1, F.array(line, F.lit("[1, 2]"))).when(F.col("s_suppkey") % 4 == 2, F.array(line, F.lit(""))).otherwise(F.array(line))
    _people(spark, sf_dir).select("s_suppkey", F.posexplode(broken)).coalesce(1).sortWithinPartitions("s_suppkey", "pos").select("col").write.text(path)
    return path


SUPPLIERS = "SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, CASE WHEN s_suppkey % 10 > 0 THEN 'S' || s_suppkey END AS cid FROM supplier"


@query(f"""SELECT cid AS candidate_id, s_name AS summary, s_acctbal / 1000 AS years, CAST(s_suppkey % 50 AS DOUBLE) AS months, s_suppkey % 2 = 0 AS is_current, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 12 END AS DOUBLE) AS skill_months,
  s_suppkey % 3 = 0 AS open, CAST(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 120 END AS DOUBLE) AS notice, CAST(s_suppkey % 100 AS DOUBLE) AS assessed FROM ({SUPPLIERS})""")
def json_lines_scan(spark, sf_dir):
    rows = readers.read_candidates(spark, _json_lines(spark, sf_dir))
    role, skill = F.get("career_history", F.lit(0)), F.get("skills", F.lit(0))
    return rows.select("candidate_id", F.col("profile.summary").alias("summary"), F.col("profile.years_of_experience").alias("years"), role["duration_months"].alias("months"), role["is_current"].alias("is_current"), skill["duration_months"].alias("skill_months"), F.col("signals.open_to_work_flag").alias("open"), F.col("signals.notice_period_days").alias("notice"), F.col("signals.skill_assessment_scores")["skill"].alias("assessed"))


@query(f"SELECT coalesce(cid, 'ROW_' || i) AS candidate_id, s_name || ' headline ' || s_suppkey || ' Title ' || s_suppkey || ' did things' AS narrative FROM ({SUPPLIERS})")
def narrative_chunks(spark, sf_dir):
    return readers.narratives(spark, _json_lines(spark, sf_dir))


FLAT = """CASE WHEN s_suppkey % 10 > 0 THEN 'S' || s_suppkey ELSE printf('CAND_{}_%07d', i) END AS candidate_id, s_name AS summary, s_acctbal AS years, 'C' || s_nationkey AS location, CAST(CASE WHEN s_acctbal > 0 THEN floor(s_acctbal * 12) ELSE 12 END AS DOUBLE) AS months, 2 AS skills, s_suppkey % 3 = 0 AS open"""


def _flat(spark, sf_dir, dotted: str = "."):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "supplier").orderBy(k).select(F.when(k % 10 > 0, F.concat(F.lit("S"), k)).alias("candidate_id"), F.col("s_name").alias("profile.summary"), text(F.col("s_acctbal")).alias("years_of_experience"), F.concat(F.lit("C"), F.col("s_nationkey")).alias(f"profile{dotted}location"), F.lit("a, b").alias("skills"), F.when(k % 3 == 0, "true").otherwise("false").alias("acme_signals.open_to_work_flag"))


def _flat_rows(rows):
    return rows.select("candidate_id", F.col("profile.summary").alias("summary"), F.col("profile.years_of_experience").alias("years"), F.col("profile.location").alias("location"), F.get("career_history", F.lit(0))["duration_months"].alias("months"), F.size("skills").alias("skills"), F.col("signals.open_to_work_flag").alias("open"))


@query(f"SELECT {FLAT.format('CSV')} FROM ({SUPPLIERS})")
def csv_scan(spark, sf_dir):
    path = f"{shared_path(spark, 'people')}.csv"
    _flat(spark, sf_dir, "_").coalesce(1).write.csv(path, header=True, escape='"')
    return _flat_rows(readers.read_candidates(spark, path))


@query(f"SELECT {FLAT.format('XLSX')} FROM ({SUPPLIERS})")
def xlsx_scan(spark, sf_dir):
    path = f"{shared_path(spark, 'people')}.xlsx"
    rows = _flat(spark, sf_dir)
    sinks.write_bytes(spark, path, sinks.workbook([rows.columns, *[["" if v is None else v for v in r] for r in rows.collect()]]))
    return _flat_rows(readers.read_candidates(spark, path))


@query("SELECT 'N' || n_nationkey AS candidate_id, n_name AS summary FROM nation")
def json_scan(spark, sf_dir):
    path = f"{shared_path(spark, 'people')}.json"
    record = F.struct(F.concat(F.lit("N"), F.col("n_nationkey")).alias("candidate_id"), F.struct(F.col("n_name").alias("summary")).alias("profile"))
    text = table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(record)).alias("t")).first()["t"]
    sinks.write_bytes(spark, path, text.encode())
    return readers.read_candidates(spark, path).select("candidate_id", F.col("profile.summary").alias("summary"))


@query("SELECT printf('CAND_%07d', doc_id) AS candidate_id, CAST(quality AS INTEGER) AS tier FROM labels WHERE doc_id % 7 > 0")
def labels_scan(spark, sf_dir):
    path = shared_path(spark, "labels")
    rows = table(spark, sf_dir, "labels").select(F.format_string("CAND_%07d", "doc_id").alias("candidate_id"), F.when(F.col("doc_id") % 7 > 0, F.col("quality")).alias("tier"))
    rows.select(F.to_json(F.struct("*"))).write.text(path)
    return readers.read_labels(spark, path)


@query(f"{oracles.scores(PROFILE)}, r AS ({RANKED} scored ORDER BY rank LIMIT 100) SELECT candidate_id, rank, printf('%.6f', score) AS score FROM r")
def ranking_roundtrip(spark, sf_dir):
    path = shared_path(spark, "ranking")
    sinks.write_ranking(rank_candidates(_pool(spark, sf_dir), PROFILE, 100), path)
    return readers.read_ranking(spark, path).where("length(reasoning) > 0").select("candidate_id", "rank", "score")


@query()
def ranking_download(spark, sf_dir):
    """The lines of the in-memory CSV."""
    text = sinks.ranking_csv(rank_candidates(_pool(spark, sf_dir), PROFILE, 100))
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "place int, line string")


@query("SELECT printf('CAND_%07d', vec_id) AS candidate_id, vec_id AS row_idx, CAST(len(embedding) AS INTEGER) AS dim, CAST(8 AS BIGINT) AS probes FROM embeddings")
def artifacts_roundtrip(spark, sf_dir):
    path = shared_path(spark, "artifacts")
    sinks.write_artifacts(_vectors(spark, sf_dir), _probes(spark, sf_dir), path)
    vectors, probes = readers.read_artifacts(spark, path)
    return vectors.select("candidate_id", "row_idx", F.size("embedding").alias("dim"), F.lit(len(probes)).cast("long").alias("probes"))


def _classes_and_both_scores(spark, sf_dir, semantic):
    """Classes of the pool, what the lexicon covers and scores, from one pass over the candidates and in few bytes a row:
    rows that are `plain` are scored on texts alone, those that are `both` on texts and vectors. Candidates with a vector
    come twice, all others count for both."""
    case = lambda s, plain, both: F.struct(s.cast("double").alias("semantic"), F.lit(plain).alias("plain"), F.lit(both).alias("both"))
    once, twice = F.array(case(F.lit(None), True, True)), F.array(case(F.lit(None), True, False), case(F.col("semantic"), False, True))
    pool = _with_vectors(candidates(spark, sf_dir, profiles=(PROFILE,), semantic=semantic), semantic)
    pool = pool.withColumn("case", F.explode(F.when(F.col("semantic").isNull(), once).otherwise(twice)))
    scored = score(pool.select(*[c for c in pool.columns if c not in ("semantic", "case")], "case.*"), PROFILE, keep=("fit_trace",))
    scored = scored.withColumn("covered", audit.covered(scored, PROFILE, F.col("fit_trace.evidence_concepts")))
    return written(audit.classify(scored, PROFILE, ("key", "score", "plain", "both", "covered")), "classes")


def _with_vectors(pool, semantic):
    return pool.withColumn("semantic", F.lit(None).cast("double")) if semantic is None else pool


@query()
def reports(spark, sf_dir):
    """Lines of the four reports and of the short verdict, as they are written."""
    semantic = usable_scores(_vectors(spark, sf_dir), _probes(spark, sf_dir))
    semantic = None if semantic is None else written(semantic, "semantic")
    rows = _classes_and_both_scores(spark, sf_dir, semantic)
    plain = rows.where("plain")
    classes = plain.drop("key", "score", "plain", "both", "covered")
    ranking = written(top_n(plain.select("candidate_id", "score"), 100).select("candidate_id", "rank", "score"), "ranking")
    best = written(top_n(rows.where("both").select("candidate_id", "key", "score"), SUPERSET).select("key"), "superset")
    superset = _with_vectors(candidates(spark, sf_dir, among=best, semantic=semantic), semantic)
    report = written(verification.verification(classes, ranking), "report")
    texts = {
        "verification": verification.verification_report(report, verification.gate_counts(verification.members(classes, ranking))),
        "sensitivity": sinks.markdown(experiments.sweep(superset, PROFILE).orderBy("jaccard_10", "label"), "Sensitivity"),
        "coverage": sinks.markdown(audit.coverage_counts(plain.select("covered.*"), PROFILE), "Lexicon coverage"),
        "bootstrap": sinks.markdown(bootstrap_ci(spark, sf_dir), "Bootstrap"),
        "verdict": "\n".join(verification.verdict_lines(report)),
    }
    folder = shared_path(spark, "reports")
    for name, text in texts.items():
        sinks.write_bytes(spark, f"{folder}/{name}.md", text.encode())
    lines = [(name, i, line) for name, text in texts.items() for i, line in enumerate(text.splitlines())]
    return spark.createDataFrame(lines, "report string, place int, line string")


def queries() -> dict:
    return {**QUERIES, **over_time.queries(), **over_sets.queries()}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **over_time.oracle_sql(), **over_sets.oracle_sql()}
