"""Sketches, multisets, dominance by blocks and the table function of mentions against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fitrank.functions.lexicon import unsuppressed
from fitrank.functions.mentions import Mentions, register_mentions
from fitrank.operators import audit, multisets, sketches
from fitrank.plans import over_sets
from fitrank.profile import JobProfile
from fitrank.storage import written


def test_sketches_roll_up_to_what_whole_groups_give(spark):
    rng = random.Random(1)
    rows = [(i % 7, "ab"[i % 2], rng.choice([f"u{rng.randrange(400)}", "hot", None]), rng.choice([rng.random(), None, float("nan")]), rng.randrange(1000)) for i in range(6000)]
    df = spark.createDataFrame(rows, "day int, kind string, user string, value double, n long")
    fine = written(sketches.sketched(df, ["day", "kind"], ["user", "n"], ["value"], ["user"]), "sketches")
    assert fine.count() == 14
    once = {r.kind: r for r in sketches.estimates(sketches.sketched(df, ["kind"], ["user", "n"], ["value"], ["user"]), (0.25, 0.5), 3).collect()}
    rolled = {r.kind: r for r in sketches.estimates(sketches.rolled_up(fine, ["kind"]), (0.25, 0.5), 3).collect()}
    for kind in "ab":
        own = [r for r in rows if r[1] == kind]
        users, values = Counter(r[2] for r in own if r[2]), sorted(r[3] for r in own if r[3] is not None and r[3] == r[3])
        got = rolled[kind]
        assert got.rows == len(own) and abs(got.distinct_user - once[kind].distinct_user) <= 10 and abs(got.distinct_n - once[kind].distinct_n) <= 30
        assert all(i["item"] is not None for i in got.frequent_user) and len(got.frequent_user) == 3
        assert abs(got.distinct_user - len(users)) <= 0.05 * len(users) and abs(got.distinct_n - len({r[4] for r in own})) <= 0.05 * 1000
        for estimate, rank in zip(got.quantile_value, (0.25, 0.5)):
            assert abs(sum(v <= estimate for v in values) / len(values) - rank) < 0.03
        assert got.frequent_user[0]["item"] == "hot" and got.frequent_user[0]["count"] == users["hot"]
    whole = sketches.estimates(sketches.rolled_up(fine, [])).first()
    assert whole.rows == 6000 and abs(whole.distinct_user - len({r[2] for r in rows if r[2]})) <= 20
    empty = sketches.estimates(sketches.rolled_up(sketches.sketched(df.where("false"), ["kind"], ["user"], ["value"]), ["kind"]))
    assert empty.count() == 0


def test_multisets(spark):
    rng = random.Random(2)
    side = lambda n: [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice(["x", "x", None, "y"])) for _ in range(n)]
    a, b = side(60), side(45)
    schema = "k long, COMMON string"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    counts = multisets.multiset_operations(x, y, ["k", "COMMON"])
    want = {r: (min(n, m), max(0, n - m), max(0, m - n), n + m) for r in set(a) | set(b) for n, m in [(Counter(a)[r], Counter(b)[r])]}
    assert {(r[0], r[1]): tuple(r)[2:] for r in counts.collect()} == want
    renamed = multisets.multiset_operations(x.toDF("k", "v"), y.toDF("k", "v"), ["k", "v"])
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(multisets.repeated(renamed, "only_a", ["k", "v"])) == rows(x.exceptAll(y)) and rows(multisets.repeated(renamed, "common", ["k", "v"])) == rows(x.intersectAll(y))
    assert multisets.multiset_operations(x.where("false"), y.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("block", [2, 512])
def test_dominance_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(audit, "BLOCK_ROWS", block)
    rng = random.Random(3)
    pick = lambda *v: rng.choice([*v, None])
    rows = [(f"c{i:03d}", pick(0.1, 0.5, 0.9), pick(3, 40, 90), pick(True, False), pick(0.0, 30.0, 60.0), pick(True, True, False), pick(True, False), pick(0.3, 0.6, 1.0, 1.0), pick(0.4, 0.7, 0.7)) for i in range(400)]
    schema = "candidate_id string, rr double, active_days int, otw boolean, notice double, location_ok boolean, in_target boolean, seniority double, stability double"
    df = spark.createDataFrame(rows, schema)
    inside, outside = rows[:150], rows[150:]

    def reaches(x, y):
        known = None not in (x[7], x[8], y[7], y[8])
        flag = lambda p, q: p is True or q is False
        return known and x[5] is True and (x[1] or 0) >= (y[1] or 0) and (999 if x[2] is None else x[2]) <= (999 if y[2] is None else y[2]) + 15 and flag(x[3], y[3]) and (999 if x[4] is None else x[4]) <= (999 if y[4] is None else y[4]) + 15 and flag(x[6], y[6]) and x[7] >= y[7] and x[8] >= y[8]

    want = sorted((x[0], y[0]) for x in outside for y in inside if reaches(x, y))
    got = audit.dominance(df.where("candidate_id < 'c150'"), df.where("candidate_id >= 'c150'"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    assert audit.dominance(df.where("false"), df).count() == 0 and audit.dominance(df, df.where("false")).count() == 0


MENTIONED = JobProfile().but(negation=r"(?:\bnot|\bno)", aspiration=r"\b(?:hope|seek)\b")
TEXTS = [None, "", "retrieval", "no retrieval. Retrieval", "not a big retrieval system", "we hope for retrieval", "hope. retrieval", "retrievals are none", "not one two three retrieval", "seek relevance and no bm25! faiss", "é retrieval é, (search engine)", "no " + "x" * 60 + " retrieval"]


def test_mentions_agree_with_the_suppressing_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    name = register_mentions(spark, MENTIONED, "mentions_here")
    df.createOrReplaceTempView("mention_texts")
    found = spark.sql(f"SELECT t.id, m.* FROM mention_texts t, LATERAL {name}(t.text) m").collect()
    assert all(TEXTS[r.id].lower()[r.place : r.place + len(r.term)] == r.term for r in found)
    standing = {(r.id, r.concept) for r in found if r.suppressed is None}
    columns = [F.when(unsuppressed(F.lower("text"), t, MENTIONED.negation, MENTIONED.aspiration), F.lit(c)).alias(f"c{i}") for i, (c, t) in enumerate(MENTIONED.concepts.items())]
    want = {(r[0], c) for r in df.select("id", *columns).collect() for c in r[1:] if c}
    assert standing == want and {r.suppressed for r in found} == {None, "negation", "aspiration"}
    assert [m[3] for m in Mentions(MENTIONED).find("not retrieval. hope for retrieval. retrieval")] == ["negation", "aspiration", None]


def test_queries_on_the_smallest_tables(spark):
    for name in ("sketch_rollup", "segment_cube", "order_multisets", "parts_except_all", "lexicon_mentions"):
        assert over_sets.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name


def test_workbooks_in_ranges(spark, tmp_path):
    from fitrank.sources import sinks, workbooks

    workbooks.register_workbooks(spark)
    head = ["id", "", "text", "z"]
    rows = [[str(i), "gone", f"é <{i}> & more", ""] for i in range(103)]
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook([head, *rows[:100], ["", "", "", ""]]))
    (tmp_path / "b.xlsx").write_bytes(sinks.workbook([["text", "id"], *[[r[2], r[0]] for r in rows[100:]]]))
    (tmp_path / "note.txt").write_text("no workbook")
    df = spark.read.format("workbook").option("partitionRows", 7).load(str(tmp_path))
    assert df.columns == ["id", "text", "z"] and df.rdd.getNumPartitions() == 16
    assert sorted((int(r.id), r.text, r.z) for r in df.collect()) == [(i, f"é <{i}> & more", "" if i < 100 else None) for i in range(103)]
    assert df.where("id = '5'").count() == 1
    assert spark.read.format("workbook").option("limit", 3).load(str(tmp_path / "a.xlsx")).count() == 3
    unsized = sinks.workbook([["id"], *[[str(i)] for i in range(20)]])
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(unsized)) as z, zipfile.ZipFile(tmp_path / "c.xlsx", "w") as out:
        for name in z.namelist():
            out.writestr(name, z.read(name).replace(z.read(name)[z.read(name).index(b"<dimension") : z.read(name).index(b"<sheetData")], b""))
    assert spark.read.format("workbook").option("partitionRows", 7).load(str(tmp_path / "c.xlsx")).count() == 20
    (tmp_path / "empty").mkdir()
    assert spark.read.format("workbook").schema("id string").load(str(tmp_path / "empty")).count() == 0


def test_ranges_of_a_long_sheet_stay_few(spark, tmp_path):
    from fitrank.sources import sinks, workbooks

    workbooks.register_workbooks(spark)
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook([["id"], *[[str(i)] for i in range(6000)]]))
    df = spark.read.format("workbook").option("partitionRows", 7).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == workbooks.MOST_LONG_RANGES
    assert sorted(int(r.id) for r in df.collect()) == list(range(6000))


def test_workbook_scan_deals_many_customers_to_several_workbooks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(over_sets, "CUSTOMERS_A_PART", 40)
    rows = [(i, f"n{i}", "x", i % 2) for i in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    found = over_sets.workbook_scan(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 8
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(str(v) for v in r) for r in rows)


def test_frequent_users_of_more_users_than_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sketches, "ITEMS", 64)
    rows = [(f"2024-01-0{d} 00:00:00", u, "view", float(u)) for d in range(1, 4) for u in range(1200)]
    events = spark.createDataFrame(rows, "ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "even" / "events.parquet"))
    found = over_sets.sketch_rollup(spark, str(tmp_path / "even")).first()
    assert found.rows == 3600 and found.users == 1200 and found.frequent_near
    told = spark.createDataFrame([("view", 1000, [(1, 100), (2, 90)])], "event_type string, told_rows long, frequent array<struct<item:long,n:long>>")
    error = lambda counts, most: over_sets.frequent_errors(spark.createDataFrame([("view", u, n) for u, n in counts], "event_type string, user_id long, count long"), told, most).first().error
    assert error([(1, 100), (2, 80), (3, 5)], 5) == 0.01  # the count of 2 is 10 off
    assert error([(1, 100), (2, 90), (3, 60)], 5) == 0.06  # 3 should have been named
    assert error([(1, 100), (2, 90), (3, 110)], 2) == 0.02  # 3 outnumbers 2
    assert error([(1, 100), (2, 90), (3, 90), (None, 500)], 2) == 0
