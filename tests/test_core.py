"""Operators of the ranking on small fixtures."""

import json
import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitrank.functions.lexicon import concepts, has_any
from fitrank.functions.scalar import iso_date, month_diff
from fitrank.operators import audit, experiments, explain, metrics, semantic
from fitrank.operators.consistency import consistency_flags
from fitrank.operators.engagement import notice_factor, with_engagement
from fitrank.operators.fit import chaser_penalty, stability_band, with_fit
from fitrank.operators.ranking import rank_all, score, tie_break_violations, top_n
from fitrank.profile import JobProfile
from fitrank.sources import readers, sinks
from fitrank.storage import written

JOB = JobProfile()


def person(i, summary="", title="Search Engineer", yoe=7.0, months=(30, 40), flags=(), city="Pune", **signals):
    roles, year = [], 2026
    for k, m in enumerate(months):
        start = date(2026 - (m + 5) // 12 - k * 4, 1, 1)
        roles.append({"title": title, "company": f"Firm {k}", "industry": "SaaS", "start_date": str(start), "end_date": None if k == 0 else f"{start.year + m // 12}-{m % 12 + 1:02d}-01", "duration_months": m if k else (2026 - start.year) * 12 + 5, "is_current": k == 0})
    base = {"open_to_work_flag": True, "notice_period_days": 0, "willing_to_relocate": True, "recruiter_response_rate": 0.9, "avg_response_time_hours": 4, "last_active_date": "2026-06-08", "github_activity_score": 70, "verified_email": True, "verified_phone": True, "linkedin_connected": True}
    return {"candidate_id": f"CAND_{i:07d}", "profile": {"summary": summary, "current_title": title, "years_of_experience": yoe, "location": city, "country": "India", "current_industry": "SaaS"}, "career_history": roles, "education": [{"tier": "tier_1", "start_year": 2010, "end_year": 2014}], "skills": [], "acme_signals": base | signals}


def load(spark, tmp_path, people, raw=""):
    path = tmp_path / "people.jsonl"
    path.write_bytes("\n".join(json.dumps(p) for p in people).encode() + raw.encode("latin-1"))
    return readers.read_candidates(spark, str(path))


TEXTS = [
    ("built ranking systems and a search engine.", ["ranking", "search"]),
    ("a research engineer", []),
    ("lighter than ranking systems", []),
    ("not a search engine", []),
    ("looking to build ranking systems. shipped faiss.", ["hybrid search"]),
    ("shipped faiss. exploring ranking systems", ["hybrid search"]),
    ("piano ranking model", ["ranking"]),
    ("éranking model, bm25", ["hybrid search"]),
    ("taking online courses on vector databases", []),
    ("x" * 60 + " ranking systems", ["ranking"]),
]


@pytest.mark.parametrize("text,expected", TEXTS)
def test_concepts(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(concepts(F.col("t"), JOB).alias("c")).first().c == expected


def test_lexicon_equals_plain_search(spark):
    terms = ["a/b test", "map", "l&t", "ab"]
    texts = ["map", "maps", "a map.", "l&t x", "ab_", "a/b tests", "éab", "a/b test", ""]
    want = [bool(re.search(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")(?!\w)", t)) for t in texts]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(has_any(F.col("t"), terms).alias("x")).collect()]
    assert got == want


def test_dates(spark):
    texts = ["2024-03-08", "2024-03-08T10:00", "2024-3-8", "20240308", "2024-W10-5", "2024-02-30", "x", None]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(iso_date(F.col("t")).alias("d")).collect()]
    d = date(2024, 3, 8)
    assert got == [d, d, None, d, d, None, None, None]
    assert spark.range(1).select(month_diff(F.lit(date(2023, 12, 31)), F.lit(date(2024, 1, 1)))).first()[0] == 1


def test_reader_and_flags(spark, tmp_path):
    bad = [person(1), person(2, yoe=2.0, months=(90, 90)), person(3), person(4, yoe=40.0), {"candidate_id": "E"}]
    bad[2]["education"][0]["end_year"] = 2001
    bad[2]["skills"] = [{"name": n, "proficiency": "expert", "duration_months": 0} for n in "abc"]
    rows = load(spark, tmp_path, bad, "\nnot json\n\n[1,2]\n{\"candidate_id\": \"b\xff\"}")
    got = {r.candidate_id: r.f for r in rows.select("candidate_id", consistency_flags(JOB).alias("f")).collect()}
    assert got["CAND_0000001"] == [] and got["E"] == [] and "career_exceeds_life" in got["CAND_0000002"] and len(got) == 6
    assert got["CAND_0000003"] == ["phantom_expertise", "edu_inversion"] and got["CAND_0000004"] == ["experience_exceeds_career_span"]


def test_bands(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert [round(row(notice_factor(F.lit(float(d)), JOB)), 9) for d in (0, 30, 90, 120, 180)] == [1, 1, 0.36, 0.16, 0]
    assert row(stability_band(arr(14, 15))) == 0.4 and row(stability_band(arr(5))) == 0.7 and row(stability_band(arr(14, 16, 27, 13))) == 0.3
    assert row(chaser_penalty(arr(14, 16, 27, 13), JOB)) == 0.75 and row(chaser_penalty(arr(12, 14, 13), JOB)) == 1.0


def test_scores_and_order(spark, tmp_path):
    people = [person(2, "built ranking systems, semantic search and faiss"), person(1, "built ranking systems, semantic search and faiss"), person(3, "taking online courses on ranking systems", "Content Writer"), person(4, yoe=1.0, months=(200, 200))]
    scored = written(score(load(spark, tmp_path, people), JOB), "scored")
    best = {r["candidate_id"]: r for r in top_n(scored, 4).collect()}
    assert [i for i, r in sorted(best.items(), key=lambda x: x[1]["rank"])][:2] == ["CAND_0000001", "CAND_0000002"]
    assert best["CAND_0000004"]["score"] == 0 and best["CAND_0000004"]["trace"]["fit"] is None and best["CAND_0000001"]["score"] > best["CAND_0000003"]["score"]
    assert tie_break_violations(top_n(scored, 4)).count() == 0 and [r["rank"] for r in rank_all(scored).orderBy("rank").collect()] == [1, 2, 3, 4]
    t = best["CAND_0000001"]["trace"]
    assert t["evidence"] == 1.0 and t["evidence_concepts"] == ["ranking", "search", "hybrid search"] and t["location"] == 1.0
    text = explain.explained(top_n(scored, 4)).select("reasoning").collect()
    assert all(20 <= len(r.reasoning) <= 320 and r.reasoning.endswith(".") and not re.search(r"  | [,;.]|\ba [aeio]|\{", r.reasoning.lower()) for r in text)
    sinks.write_ranking(explain.explained(top_n(scored, 4)), str(tmp_path / "out"))
    assert [r.candidate_id for r in readers.read_ranking(spark, str(tmp_path / "out")).orderBy("rank").collect()][0] == "CAND_0000001"
    assert "| CAND_0000001 |" in sinks.markdown(top_n(scored, 1).select("candidate_id"), "t") and sinks.ranking_csv(explain.explained(top_n(scored, 1))).startswith("candidate_id,rank,score,reasoning")


def test_engagement_bounds(spark, tmp_path):
    ghost = person(2, open_to_work_flag=False, notice_period_days=180, willing_to_relocate=False, recruiter_response_rate=0.0, avg_response_time_hours=300, last_active_date="2020-01-01", github_activity_score=0, verified_email=False, verified_phone=False, linkedin_connected=False)
    m = {r.candidate_id: r.multiplier for r in with_engagement(load(spark, tmp_path, [person(1), ghost]), JOB).collect()}
    assert m["CAND_0000001"] > 0.85 and 0.6 <= m["CAND_0000002"] <= 0.65


def test_rounding_is_exact(spark):
    rows = spark.createDataFrame([("a", 0.1234565), ("b", 0.1234564), ("c", 0.5)], "candidate_id string, score double")
    assert [(r.candidate_id, r.score) for r in top_n(rows, 3).orderBy("rank").collect()] == [("c", 0.5), ("a", 0.123456), ("b", 0.123456)]


def test_percentile(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)], "row_idx long, embedding array<float>")
    got = {r.row_idx: r.semantic for r in semantic.pool_percentile(semantic.similarity(v, np.array([[1.0, 0.0]]))).collect()}
    assert got == {1: 0.0, 2: 0.5, 0: 1.0, 3: None}
    many = spark.range(2000).select((F.col("id") % 7).cast("double").alias("raw"), F.col("id").alias("row_idx"))
    for r in semantic.pool_percentile(many).collect():
        want = np.float32(sum(1 for x in range(2000) if (x % 7, x) < (r.row_idx % 7, r.row_idx)) / 1999) if r.row_idx % 500 == 0 else None
        assert want is None or r.semantic == pytest.approx(float(want), abs=1e-9)
    assert not semantic.valid_artifacts(v, v.limit(1), np.ones((1, 2)))


def test_metrics(spark):
    rows = [("d", 1, 3), ("d", 2, 2), ("m", 1, 1), ("m", 2, 0), ("m", 3, 1), ("m", 4, 0), ("z", 1, 0)]
    df = spark.createDataFrame(rows, "group string, pos long, rel int")
    assert {r.group: round(r.dcg, 9) for r in metrics.dcg(df).collect()}["d"] == round(7 + 3 / np.log2(3), 9)
    m = {r.group: r for r in metrics.all_metrics(df).collect()}
    assert m["m"].ap == pytest.approx((1 + 2 / 3) / 2) and m["z"].composite == 0 and m["d"].ndcg_10 == 1 and m["d"].p_10 == 0.1
    assert experiments.composite(np.array([1, 0, 1, 0])) == pytest.approx(m["m"].composite)
    assert metrics.precision_at(df, 0).first().precision == 0


def test_audit(spark, tmp_path):
    rows = audit.classify(load(spark, tmp_path, [person(1, "focus on search, retrieval, and ranking"), person(2, "excited about how tutorials")]), JOB)
    got = {r.candidate_id: r for r in rows.collect()}
    assert got["CAND_0000001"].coherent_fit and got["CAND_0000001"].strength == 4.75 and got["CAND_0000002"].framework_dabbler
    assert rows.select(audit.exclusion_reason().alias("r")).distinct().count() == 2


def test_sweep_agrees_with_scores(spark, tmp_path):
    people = load(spark, tmp_path, [person(i, ["built ranking systems", "bm25 and ndcg", ""][i % 3], yoe=3.0 + i % 9, **({"notice_period_days": None} if i % 4 == 0 else {})) for i in range(12)]).withColumn("semantic", F.lit(0.4))
    changed = experiments.perturbations(JOB)[1][1]
    direct = {r.candidate_id: r.score for r in score(people, changed).collect()}
    swept = experiments.scores_under(experiments.ingredients(people, JOB), [("x", changed)]).collect()
    assert {r.candidate_id: pytest.approx(r.score) for r in swept} == direct
    assert experiments.sweep(people, JOB).count() == 34


def test_flat_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('candidate_id,profile.summary,profile_location,years_of_experience,skills,acme_signals.open_to_work_flag,education\n,hello,Pune,3.5,"a, b",true,\nX,"l1\nl2",Delhi,bad,"[{""name"":""z""}]",,"[{""tier"":""tier_1""}]"\n')
    got = {r.candidate_id: r for r in readers.read_candidates(spark, str(tmp_path / "a.csv")).collect()}
    assert len(got) == 2 and got["X"].profile.years_of_experience == 0.0 and got["X"].skills[0].name == "z" and got["X"].career_history[0].duration_months == 12
    other = next(r for k, r in got.items() if k != "X")
    assert other.candidate_id.startswith("CAND_CSV_") and [s.name for s in other.skills] == ["a", "b"] and other.career_history[0].duration_months == 42 and other.signals.open_to_work_flag
    (tmp_path / "l.json").write_text(json.dumps([{"candidate_id": "p"}, {"candidate_id": "q"}]))
    (tmp_path / "o.json").write_text(json.dumps({"candidate_id": "p"}))
    assert readers.read_candidates(spark, str(tmp_path / "l.json")).count() == 2 and readers.read_candidates(spark, str(tmp_path / "o.json")).count() == 1


def test_spreadsheet(spark, tmp_path):
    import zipfile

    cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in (["candidate_id", "profile.summary"], ["K", "hi"])) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert [(r.candidate_id, r.profile.summary) for r in readers.read_candidates(spark, str(tmp_path / "a.xlsx")).collect()] == [("K", "hi")]


def test_with_fit_gates(spark, tmp_path):
    rows = load(spark, tmp_path, [person(1, "computer vision", "Computer Vision Engineer"), person(2, "nlp", "Chef")]).withColumn("semantic", F.lit(None).cast("double"))
    t = {r.candidate_id: r.fit_trace for r in with_fit(rows, JOB).collect()}
    assert (t["CAND_0000001"].domain_gate, t["CAND_0000001"].domain_title_gate) == (0.2, 0.2) and (t["CAND_0000002"].domain_gate, t["CAND_0000002"].title_gate) == (1.0, 0.2)


def test_row_keys_of_many_files_are_joined_from_a_table(spark, tmp_path, monkeypatch):
    from fitrank import storage

    path = str(tmp_path / "rows")
    spark.range(100, numPartitions=7).selectExpr("id % 3 as a").write.parquet(path)
    rows = spark.read.parquet(path)
    few = storage.row_keys(rows, "key").collect()
    monkeypatch.setattr(storage, "BROADCAST_FILES", 2)
    many = storage.row_keys(rows, "key").collect()
    assert sorted(few) == sorted(many) and len({r.key for r in many}) == 100
