"""DuckDB SQL of the candidate view and of scoring on it, independent of the engine's expressions.

Texts are folded first: letters beyond ASCII become z, one for one, so that \\b and \\w of DuckDB's patterns part words as
whole tokens are parted, and places stay what they are.
"""

from __future__ import annotations

from ..profile import JobProfile

FOLD = r"regexp_replace(lower({}), '[ªµºß-öø-ɏ\x{{0300}}-\x{{036f}}]', 'z', 'g')"


def round6(x: str) -> str:
    """Six places of the binary value, halves to even; DuckDB's own round goes by a product."""
    return f"CAST(printf('%.6f', {x}) AS DOUBLE)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(terms) -> str:
    """An alternation of whole tokens, longest first."""
    return r"\b(" + "|".join(sorted(set(terms), key=lambda t: (-len(t), t))) + r")\b"


def has(text: str, terms) -> str:
    return f"regexp_matches({text}, {quoted(words(terms))})" if terms else "false"


def stands(text: str, terms, profile: JobProfile) -> str:
    """Is there a mention that nothing takes back? For each mention the whole prefix is looked at."""
    parts = rf"string_split(regexp_replace({text}, {quoted(words(terms))}, chr(2) || '\1', 'g'), chr(2))"
    negated = quoted(profile.negation + r"\s+(?:[\w'/-]+\s+){0,2}$")
    taken = f"regexp_matches(right(p, 40), {negated}) OR regexp_matches(regexp_extract(p, '[^.!?\n]*$'), {quoted(profile.aspiration)})"
    prefixes = f"list_transform(range(1, len({parts})), lambda i: array_to_string(({parts})[1:i], ''))"
    return f"len(list_filter({prefixes}, lambda p: NOT ({taken}))) > 0"


def found(text: str, profile: JobProfile) -> str:
    """The list of concepts that stand."""
    each = ", ".join(f"CASE WHEN {has(text, t)} AND {stands(text, t, profile)} THEN {quoted(n)} END" for n, t in profile.concepts.items())
    return f"list_filter([{each}], lambda c: c IS NOT NULL)"


TITLES = "['Search Engineer', 'Data Scientist', 'Content Writer', 'ML Engineer', 'Computer Vision Engineer', 'Junior Developer', 'Project Manager']"

VIEW = f"""
v_orders AS (SELECT o_custkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) + INTERVAL 22 YEAR AS d FROM orders),
v_next AS (SELECT *, lead(d) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS nxt FROM v_orders),
v_roles AS (SELECT *, (year(coalesce(nxt, DATE '2024-02-01')) - year(d)) * 12 + month(coalesce(nxt, DATE '2024-02-01')) - month(d) AS real_months FROM v_next),
v_claims AS (SELECT *, CAST(real_months + o_orderkey % 4 + CASE WHEN o_orderkey % 40 = 0 THEN 30 ELSE 0 END AS DOUBLE) AS months, {TITLES}[CAST(o_orderkey % 7 + 1 AS INT)] AS title, 'Company ' || o_orderkey % 40 AS company FROM v_roles),
v_career AS (SELECT o_custkey, min(d) AS first, sum(months) AS total, bool_or(abs(months - real_months) > 18) AS f1, bool_or(abs(months - real_months) > 4) AS wide, count(*) AS n_roles,
  list(title ORDER BY o_orderkey) AS titles, list(company ORDER BY o_orderkey) AS firms, list(o_orderpriority ORDER BY o_orderkey) AS fields, list(months ORDER BY o_orderkey) AS months,
  count(*) FILTER (WHERE months > 0) AS n_months, sum(months) FILTER (WHERE months > 0) AS sum_months, avg(months) AS avg_months FROM v_claims GROUP BY o_custkey),
v_items AS (SELECT o_custkey, 'skill ' || l_partkey % 60 AS name, CASE WHEN l_discount > 0.07 THEN 'expert' WHEN l_discount > 0.04 THEN 'advanced' ELSE 'intermediate' END AS proficiency, CASE WHEN l_quantity < 3 THEN 0.0::DOUBLE ELSE l_quantity END AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v_skills AS (SELECT i.o_custkey, count(*) FILTER (WHERE proficiency <> 'intermediate' AND i.months = 0) AS phantom, count(*) FILTER (WHERE c.sum_months > 0 AND i.months > c.sum_months) AS overlong, max(i.months) AS longest FROM v_items i JOIN v_career c USING (o_custkey) GROUP BY i.o_custkey),
v_named AS (SELECT o_custkey, 'skill ' || l_partkey % 60 AS name, arg_max(CASE WHEN l_discount > 0.04 THEN 1 ELSE 0 END, l_orderkey * 100 + l_linenumber) AS claimed FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
v_events AS (SELECT user_id, max(CAST(ts AS DATE)) AS last, avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) AS clicks, count(*) AS n, avg(value) AS value FROM events GROUP BY user_id),
v_size AS (SELECT max(doc_id) + 1 AS n_docs FROM documents),
view AS (SELECT c_custkey AS k, printf('CAND_%07d', c_custkey) AS candidate_id, coalesce(d.text, '') AS summary, c_name AS headline, {TITLES}[CAST(c_custkey % 7 + 1 AS INT)] AS title, 'Company ' || c_custkey % 40 AS company, abs(c_acctbal) / 1200 + 5 AS yoe, n_name AS place, c_mktsegment AS segment,
    r.first, coalesce(r.total, 0) AS total, coalesce(r.f1, false) AS f1, coalesce(r.wide, false) AS wide, coalesce(r.titles, []) AS titles, coalesce(r.firms, []) AS firms, coalesce(r.fields, []) AS fields, coalesce(r.n_months, 0) AS n_months, r.sum_months, coalesce(r.n_roles, 0) AS n_roles, r.avg_months,
    coalesce(s.phantom, 0) AS phantom, coalesce(s.overlong, 0) AS overlong, s.longest, e.last, e.clicks, e.n AS n_events, e.value, e.user_id IS NOT NULL AS seen, e.n * 7 % 100 < 40 AND coalesce(m.claimed = 1, false) AS inflated
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN documents d ON c_custkey % (SELECT n_docs FROM v_size) = d.doc_id LEFT JOIN v_career r ON r.o_custkey = c_custkey LEFT JOIN v_skills s ON s.o_custkey = c_custkey LEFT JOIN v_events e ON e.user_id = c_custkey LEFT JOIN v_named m ON m.o_custkey = c_custkey AND m.name = 'skill ' || e.n % 60)"""

FLAGS = """
flags AS (SELECT candidate_id, f1 OR phantom >= 3 OR total > yoe * 12 + 24 OR coalesce(yoe * 12 > (2024 - year(first)) * 12 + 2 - month(first) + 48, false) OR k % 50 = 0 AS flagged FROM view)"""


def engagement(profile: JobProfile) -> str:
    w, e = profile, profile.engagement
    notice = f"CASE WHEN n_events * 3 <= {w.notice_free} THEN 1.0::DOUBLE ELSE pow(greatest(0, least(1, ({w.notice_end}::DOUBLE - n_events * 3) / {w.notice_end - w.notice_free}::DOUBLE)), 2) END"
    return f"""
engaged_parts AS (SELECT candidate_id,
    CASE WHEN seen AND n_events % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN seen THEN 0.4::DOUBLE * {notice} ELSE 0 END + CASE WHEN seen AND n_events % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END AS availability,
    greatest(0, least(1, 0.7::DOUBLE * coalesce(clicks, 0) + 0.3::DOUBLE * CASE WHEN value IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, (280 - value * 2) / 280)) END)) AS responsiveness,
    CASE WHEN last IS NULL THEN 0.3::DOUBLE ELSE greatest(0, least(1, (180 - date_diff('day', last, DATE '2024-02-01')) / 180)) END AS recency,
    greatest(0, least(1, 0.2::DOUBLE + CASE WHEN seen AND least(value, 100) > 0 THEN 0.4::DOUBLE * least(1, least(value, 100) / 60) ELSE 0 END + CASE WHEN seen AND n_events % 5 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN seen AND n_events % 7 = 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN seen AND n_events % 2 = 1 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN inflated THEN 0.1::DOUBLE ELSE 0 END - 0.1::DOUBLE * least(overlong, 2))) AS credibility
  FROM view),
engaged AS (SELECT *, {w.floor}::DOUBLE + {1 - w.floor}::DOUBLE * ({e["availability"]}::DOUBLE * availability + {e["responsiveness"]}::DOUBLE * responsiveness + {e["recency"]}::DOUBLE * recency + {e["credibility"]}::DOUBLE * credibility) AS multiplier FROM engaged_parts)"""


def _industries(names) -> str:
    return "[" + ", ".join(quoted(n) for n in names) + "]"


def fit(profile: JobProfile) -> str:
    b, w = profile.bands, profile.weights
    text = FOLD.format("trim(array_to_string(list_filter(list_concat([summary, headline], titles), lambda x: x <> ''), ' '))")
    built = FOLD.format("trim(array_to_string(list_filter(list_concat([summary], titles), lambda x: x <> ''), ' '))")
    every = "list_concat([title], titles)"
    tech, rejected = quoted("(?i)" + profile.tech_title), quoted("(?i)" + profile.rejected_title)
    fields = "list_filter(list_concat(fields, [segment]), lambda x: x <> '')"
    city = lambda names: " OR ".join(f"contains(lower(place), {quoted(c)})" for c in names)
    firm = " OR ".join(f"contains(lower(c), {quoted(s)})" for s in profile.services)
    mean = "sum_months / n_months"
    band = f"CASE WHEN {mean} >= 30 THEN 1.0 WHEN {mean} >= 24 THEN 0.85 WHEN {mean} >= 18 THEN 0.6 WHEN {mean} >= 12 THEN 0.4 ELSE 0.25 END"
    moves = "(seen AND n_events % 3 = 0)"
    return f"""
texts AS (SELECT *, {text} AS narrative, {built} AS built FROM view),
heard AS (SELECT *, {found("built", profile)} AS concepts, regexp_matches(narrative, {quoted(profile.disclaimer)}) AS has_disclaimer FROM texts),
graded AS (SELECT *, CASE WHEN len(concepts) >= 3 THEN {b["three"]}::DOUBLE WHEN len(concepts) = 2 THEN {b["two"]} WHEN len(concepts) = 1 THEN {b["one"]} WHEN {has("narrative", profile.generic)} THEN {b["generic"]} ELSE 0 END AS grade FROM heard),
fit_parts AS (SELECT candidate_id, CASE WHEN has_disclaimer THEN least(grade, {b["disclaimer"]}) ELSE grade END AS evidence, len(concepts) AS n_concepts, has_disclaimer, {has("narrative", profile.generic)} AS generic,
    CASE WHEN {has("narrative", profile.positive)} THEN 1.0::DOUBLE WHEN {has("narrative", profile.negative)} OR ({has("narrative", profile.research)} AND NOT {has("narrative", profile.production)}) THEN 0.2 ELSE 0.6 END AS domain_gate,
    CASE WHEN len(list_filter({every}, lambda t: regexp_matches(t, {tech}))) > 0 THEN 1.0::DOUBLE ELSE 0.2 END AS title_gate,
    CASE WHEN len(concepts) > 0 THEN 1.0::DOUBLE WHEN regexp_matches(title, {rejected}) THEN 0.2 WHEN len(titles) > 0 AND len(list_filter(titles, lambda t: NOT regexp_matches(t, {rejected}))) = 0 THEN 0.2 ELSE 1.0 END AS domain_title_gate,
    (CASE WHEN yoe BETWEEN 5 AND 9 THEN 1.0::DOUBLE WHEN yoe BETWEEN 4 AND 10 THEN 0.8 WHEN yoe BETWEEN 3 AND 12 THEN 0.5 WHEN yoe > 12 THEN 0.35 ELSE 0.25 END) * CASE WHEN contains(lower(title), 'junior') OR contains(lower(title), 'intern') THEN 0.5::DOUBLE ELSE 1 END AS base_seniority, {has("narrative", profile.scope)} AS scoped,
    CASE WHEN len(firms) > 0 AND len(list_filter(firms, lambda c: NOT ({firm}))) = 0 THEN 0.2::DOUBLE WHEN len(list_intersect({fields}, {_industries(profile.product_industries)})) > 0 THEN 1.0 WHEN len({fields}) > 0 AND len(list_filter({fields}, lambda f: NOT list_contains({_industries(profile.services_industries)}, f))) = 0 THEN 0.4 ELSE 0.6 END AS product,
    CASE WHEN {city(profile.cities)} THEN 1.0::DOUBLE WHEN {city(profile.second_cities)} THEN CASE WHEN {moves} THEN 1.0 ELSE 0.8 END WHEN lower(place) = {quoted(profile.home_country)} THEN 0.6 WHEN {moves} THEN 0.5 ELSE 0.2 END AS location,
    CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7 ELSE 0.5 END AS education,
    CASE WHEN n_months < 2 THEN 0.7::DOUBLE WHEN n_months >= 4 AND {mean} < 18 THEN least({band}, 0.3) ELSE {band} END AS stability, CASE WHEN n_months >= 4 AND {mean} < 18 THEN {profile.chaser}::DOUBLE ELSE 1 END AS chaser_penalty
  FROM graded),
fit_sums AS (SELECT *, CASE WHEN scoped THEN least(1.0::DOUBLE, base_seniority + 0.1::DOUBLE) ELSE base_seniority END AS seniority, least(domain_gate, title_gate, domain_title_gate) AS gate FROM fit_parts),
fitted AS (SELECT *, evidence * gate AS technical, ({w["technical"]}::DOUBLE * (evidence * gate) + {w["seniority"]}::DOUBLE * seniority + {w["product"]}::DOUBLE * product + {w["location"]}::DOUBLE * location + {w["education"]}::DOUBLE * education + {w["stability"]}::DOUBLE * stability) * chaser_penalty AS fit FROM fit_sums)"""


def scores(profile: JobProfile) -> str:
    """Common tables up to `scored` (candidate_id, score), without vectors."""
    return f"WITH {VIEW},{FLAGS},{engagement(profile)},{fit(profile)},\nscored AS (SELECT candidate_id, CASE WHEN flagged THEN 0 ELSE fit * multiplier END AS score FROM fitted JOIN engaged USING (candidate_id) JOIN flags USING (candidate_id))\n"


def parameters(rows: list[tuple]) -> str:
    """A table of parameters: rows of (label, {name: value})."""
    names = list(rows[0][1])
    values = ", ".join("(" + ", ".join([quoted(label), *[f"{float(v)!r}::DOUBLE" for v in p.values()]]) + ")" for label, p in rows)
    return f"(VALUES {values}) AS t(label, {', '.join(names)})"


def swept(profile: JobProfile, rows: list[tuple], superset: str, size: int) -> str:
    """Common tables up to `tops` (label, candidate_id, rank, score, arch): the best hundred of a superset under each row of
    parameters. Needs the tables of `scores` and `semantic`, and `superset` (candidate_id, score)."""
    grade = "CASE WHEN n_concepts >= 3 THEN b_three WHEN n_concepts = 2 THEN b_two WHEN n_concepts = 1 THEN b_one WHEN generic THEN b_generic ELSE 0 END"
    arch = "CASE " + " ".join(f"WHEN contains(lower(summary), {quoted(v)}) THEN {quoted(n)}" for n, v in profile.loose_archetypes.items()) + " ELSE 'other' END"
    left = "greatest(0::DOUBLE, least(1::DOUBLE, (notice_end - n_events * 3) / (notice_end - notice_free)))"
    return f"""prm AS (SELECT * FROM {parameters(rows)}),
best AS (SELECT candidate_id FROM {superset} ORDER BY {round6('score')} DESC, candidate_id LIMIT {size}),
sup AS (SELECT f.*, e.responsiveness, e.recency, e.credibility, s.semantic, g.flagged, v.seen, v.n_events, {arch} AS arch FROM fit_sums f JOIN best USING (candidate_id) JOIN engaged_parts e USING (candidate_id) JOIN flags g USING (candidate_id) JOIN view v USING (candidate_id) LEFT JOIN semantic s USING (candidate_id)),
grades AS (SELECT *, CASE WHEN has_disclaimer THEN least({grade}, b_disclaimer) ELSE {grade} END AS ev FROM sup, prm),
blends AS (SELECT *, CASE WHEN semantic IS NULL THEN ev ELSE (1 - semantic_share) * ev + semantic_share * semantic END AS blended,
  CASE WHEN seen AND n_events % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN seen THEN 0.4::DOUBLE * CASE WHEN n_events * 3 <= notice_free THEN 1 ELSE {left} * {left} END ELSE 0 END + CASE WHEN seen AND n_events % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END AS available FROM grades),
swept AS (SELECT label, candidate_id, arch, CASE WHEN flagged THEN 0 ELSE (w_technical * blended * gate + w_seniority * seniority + w_product * product + w_location * location + w_education * education + w_stability * stability) * CASE WHEN chaser_penalty < 1 THEN chaser ELSE 1 END
  * (floor + (1 - floor) * (e_availability * available + e_responsiveness * responsiveness + e_recency * recency + e_credibility * credibility)) END AS score FROM blends),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {round6('score')} DESC, candidate_id) AS rank FROM swept) WHERE rank <= 100)"""


#: Similarity to the first eight vectors and its percentile, as the engine's batches work them out (32-bit there).
SEMANTIC = """
sem_probes AS (SELECT vec_id AS probe, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 8),
sem_all AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], q) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q)) + 1e-9) AS c FROM embeddings, sem_probes),
sem_top AS (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) AS r FROM sem_all),
sem_raw AS (SELECT vec_id, greatest(0, avg(c)) AS raw FROM sem_top WHERE r <= 3 GROUP BY vec_id),
semantic AS (SELECT printf('CAND_%07d', vec_id) AS candidate_id, raw, CAST(CAST((row_number() OVER (ORDER BY raw, vec_id) - 1) / ((SELECT count(*) FROM sem_raw) - 1) AS REAL) AS DOUBLE) AS semantic FROM sem_raw)"""


def _any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in parts) + ")"


def classes(profile: JobProfile, a) -> str:
    """Common tables up to `classes`, the independent audit of the view; `a` has its fixed lists."""
    grade = lambda text: f"CASE WHEN {_any(text, a.STRONG_EVIDENCE)} THEN 'STRONG' WHEN {_any(text, a.MEDIUM_EVIDENCE)} THEN 'MED' WHEN {_any(text, a.WEAK_EVIDENCE)} THEN 'WEAK' ELSE 'NONE' END"
    arch = "CASE " + " ".join(f"WHEN contains(s, {quoted(v)}) THEN {quoted(n)}" for n, v in profile.archetypes.items()) + " ELSE 'OTHER' END"
    dabbling = " + ".join(f"CAST(contains(s, {quoted(p)}) AS INT)" for p in a.DABBLING)
    firm = _any("lower(c)", profile.services)
    mean = "sum_months / n_months"
    return f"""WITH {VIEW},
c_text AS (SELECT *, lower(summary) AS s, lower(title) AS t, lower(summary) || ' ' || repeat(' ', CAST(greatest(n_roles - 1, 0) AS INT)) AS blob, lower(summary) || ' ' || lower(title) AS st, lower(place) AS p, (seen AND n_events % 3 = 0) AS moves, (seen AND n_events % 2 = 0) AS otw_,
    date_diff('day', last, DATE '2024-02-01') AS active_days FROM view),
c_rows AS (SELECT candidate_id, {arch} AS arch, {grade("blob")} AS grade, {grade("s")} AS grade_summary, yoe, yoe BETWEEN 4 AND 10 AS in_band,
    len(firms) > 0 AND len(list_filter(firms, lambda c: NOT {firm})) = 0 AS services_only, false AS kw_stuffer,
    {_any("st", a.OTHER_DOMAINS)} AND NOT {_any("st", a.LANGUAGE_DOMAINS)} AS cv_primary, {_any("t", a.RESEARCH_TITLES)} AND NOT {_any("s", a.PRODUCTION_CUES)} AS pure_research,
    ({dabbling}) >= 2 AND {grade("s")} <> 'STRONG' AS framework_dabbler, {_any("t", a.OTHER_TITLES)} AS noneng_title,
    {_any("p", a.AUDIT_CITIES)} AS in_target, {_any("p", a.AUDIT_CITIES)} OR (moves AND (p = {quoted(profile.home_country)} OR {_any("p", a.HOME_CITIES)})) AS location_ok,
    (otw_ OR coalesce(active_days <= 120, false)) AND (clicks IS NULL OR clicks >= 0.3) AS reachable, active_days, clicks AS rr, otw_ AS otw, CAST(n_events * 3 AS DOUBLE) AS notice, avg_months AS avg_tenure,
    CASE WHEN {_any("s", a.SCOPE_CUES)} THEN least(1.0::DOUBLE, b + 0.1::DOUBLE) ELSE b END AS seniority,
    CASE WHEN n_roles < 2 THEN 0.7::DOUBLE WHEN n_roles >= 4 AND avg_months < 18 THEN least(sb, 0.3) ELSE sb END AS stability,
    CAST(wide AS INT) + CAST(phantom_ >= 3 AS INT) + CAST(coalesce(longest > yoe * 12 + 6 AND yoe <> 0, false) AS INT) + CAST(total > yoe * 12 + 18 AND yoe <> 0 AS INT) + CAST(k % 50 = 0 AS INT) >= 2 AS honeypot
  FROM (SELECT *, phantom AS phantom_, (CASE WHEN yoe BETWEEN 5 AND 9 THEN 1.0::DOUBLE WHEN yoe BETWEEN 4 AND 10 THEN 0.8 WHEN yoe BETWEEN 3 AND 12 THEN 0.5 WHEN yoe > 12 THEN 0.35 ELSE 0.25 END) * CASE WHEN contains(t, 'junior') OR contains(t, 'intern') THEN 0.5::DOUBLE ELSE 1 END AS b,
    CASE WHEN avg_months >= 30 THEN 1.0::DOUBLE WHEN avg_months >= 24 THEN 0.85 WHEN avg_months >= 18 THEN 0.6 WHEN avg_months >= 12 THEN 0.4 ELSE 0.25 END AS sb FROM c_text)),
c_gates AS (SELECT *, honeypot OR services_only OR kw_stuffer OR cv_primary OR pure_research OR framework_dabbler AS disqualified, arch IN ('ELITE', 'STRONG', 'SENIOR_ENG') AS coherent FROM c_rows),
classes AS (SELECT *, greatest(CASE WHEN arch = 'ELITE' THEN 4.0::DOUBLE WHEN arch IN ('STRONG', 'SENIOR_ENG') THEN 3.0 ELSE 0 END, CASE grade WHEN 'STRONG' THEN 2.0::DOUBLE WHEN 'MED' THEN 1.0 ELSE 0 END) + CASE WHEN reachable THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN location_ok THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN disqualified THEN 3.0::DOUBLE ELSE 0 END AS strength,
    coherent AND reachable AND in_band AND location_ok AND NOT disqualified AS coherent_fit FROM c_gates)"""
