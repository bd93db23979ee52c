"""As-of joins, overlaps, sessions and arriving data against plain versions, with hot keys, ties and nulls."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fitrank.operators import ordered
from fitrank.plans import over_time
from fitrank.streaming import incremental

START = datetime(2024, 1, 1)


def plain_asof(left, right, tolerance=None, strict=False):
    out = []
    for k, t, i in left:
        best = None
        for rk, rt, v in right:
            if None not in (k, t, rk, rt) and rk == k and (rt < t if strict else rt <= t) and (best is None or (rt, v) > best):
                best = (rt, v)
        near = best and (tolerance is None or t - best[0] <= tolerance)
        out.append((i, best[1] if near else None))
    return sorted(out)


def hot_rows(seed, n, values):
    """Half of the rows have one key, many one time; some have nulls."""
    rng = random.Random(seed)
    key = lambda: rng.choice([0, 0, 0, 0, 1, 2, 3, None])
    return [(key(), rng.choice([None, 50, 50, *[rng.randrange(100)] * 6]), values(rng, i)) for i in range(n)]


@pytest.mark.parametrize("parts", ["1", "7", "40"])
@pytest.mark.parametrize(("tolerance", "strict"), [(None, False), (3, False), (None, True), (0, False)])
def test_asof_join(spark, parts, tolerance, strict):
    left, right = hot_rows(1, 300, lambda r, i: i), hot_rows(2, 120, lambda r, i: r.randrange(9))
    a = spark.createDataFrame(left, "k long, t long, id long")
    b = spark.createDataFrame(right, "KEY long, T2 long, v long")
    before, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.asof_join(a, b, "t", "T2", [("k", "KEY")], ["v"], tolerance, strict)
        assert got.columns == ["k", "t", "id", "v"]
        assert sorted((r.id, r.v) for r in got.collect()) == plain_asof(left, right, tolerance, strict)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_asof_join_of_times_without_key_and_of_empty_tables(spark):
    a = spark.createDataFrame([(START + timedelta(hours=h), h) for h in (0, 5, 9)], "ts timestamp, id int")
    b = spark.createDataFrame([(START + timedelta(hours=h, seconds=1), h) for h in (0, 4, 4, 9)], "at timestamp, found int")
    rows = lambda x: sorted((r.id, r.found) for r in x.collect())
    assert rows(ordered.asof_join(a, b, "ts", "at", take=["found"])) == [(0, None), (5, 4), (9, 4)]
    assert rows(ordered.asof_join(a, b.where("false"), "ts", "at", take=["found"])) == [(0, None), (5, None), (9, None)]
    assert rows(ordered.asof_join(a.where("false"), b, "ts", "at", take=["found"])) == []
    with pytest.raises(ValueError):
        ordered.asof_join(a, a, "ts", "ts")


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
def test_overlap_join(spark, touching, keyed):
    rng = random.Random(4)

    def spans(n):
        out = []
        for i in range(n):
            start = rng.randrange(-3000, 3000)
            out.append((rng.choice([0, 0, 0, 1, None]), start, start + rng.choice([-5, 0, 0, 1, 4, 5, 17, 64, 300, 5000]), i))
        return [*out, (0, None, 5, n), (0, 5, None, n + 1), *[(0, 10, 20, n + 2)] * 3]

    left, right = spans(150), spans(120)
    a, b = (spark.createDataFrame(x, "k long, start long, end long, id long") for x in (left, right))
    got = ordered.overlap_join(a, b, ("start", "end"), ("start", "end"), [("k", "k")] if keyed else [], touching, unit=4)
    want = []
    for k, s, e, i in left:
        for rk, rs, re, j in right:
            if None in (s, e, rs, re) or (keyed and (k is None or k != rk)):
                continue
            if (s <= e and rs <= re and s <= re and rs <= e) if touching else (s < e and rs < re and s < re and rs < e):
                want.append((i, j))
    assert sorted((r[0], r[1]) for r in got.select("l.id", "r.id").collect()) == sorted(want) and len(want) > 500
    assert ordered.overlap_join(a, b.where("false"), ("start", "end"), ("start", "end")).count() == 0


@pytest.mark.parametrize("parts", ["1", "13"])
def test_sessions(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, None]), START + timedelta(minutes=rng.randrange(4000)), i) for i in range(400)] + [(0, None, 900), (7, START, 901), (7, START + timedelta(minutes=30), 902), (7, START + timedelta(minutes=59, seconds=59), 903)]
    df = spark.createDataFrame(rows, "k long, t timestamp, session long")
    before, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.with_sessions(df, ["k"], "t", 30 * 60 * 10**6, name="number").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(got) == len(rows) and [r.number for r in got if r.t is None] == [None]
    found = {}
    for r in got:
        if r.t is not None:
            found.setdefault(r.number, []).append((r.k, r.t))
    want, last = [], None
    for k, t in sorted(((k, t) for k, t, _ in rows if t), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if last is None or last[0] != k or t - last[1] > timedelta(minutes=30):
            want.append([])
        want[-1].append((k, t))
        last = (k, t)
    key = lambda s: (s[0][0] is not None, s[0][0] or 0, s[0][1])
    assert sorted((sorted(s, key=lambda r: r[1]) for s in found.values()), key=key) == want


def test_sessions_agree_with_session_windows(spark):
    rows = [(k, START + timedelta(minutes=m)) for k, m in ((1, 0), (1, 30), (1, 59), (1, 89), (1, 200), (2, 0))]
    df = spark.createDataFrame(rows, "k long, t timestamp")
    mine = ordered.with_sessions(df, ["k"], "t", 30 * 60 * 10**6).groupBy("k", "session").agg(F.min("t").alias("begun"), F.count("*").alias("n")).select("k", "begun", "n")
    own = incremental.event_sessions(df, "t", "30 minutes", by=["k"], aggregates=[F.count("*").alias("n")]).select("k", F.col("begun").cast("timestamp").alias("begun"), "n")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, own.collect()))


SCHEMA = "k long, t timestamp_ntz, v double"


def arrivals(spark, rows):
    return spark.createDataFrame([(k, START + timedelta(minutes=m) if m is not None else None, v) for k, m, v in rows], SCHEMA)


def test_windows_restart_with_state_and_leave_late_rows_out(spark):
    first, second = arrivals(spark, [(1, 0, 1.0), (1, 59, 2.0), (2, 300, 4.0), (None, 301, 1.0), (1, None, 9.0)]), arrivals(spark, [(1, 5, 8.0), (2, 301, 16.0), (1, 200, 32.0)])
    count = [F.count("*").alias("n"), F.sum("v").alias("v")]
    flow = incremental.Incremental(spark, first.schema, lambda e: incremental.event_windows(e, "t", "1 hour", by=["k"], aggregates=count, late="2 hours"), "update")
    for rows in (first, second):
        flow.load(rows)
    hour = lambda h: START + timedelta(hours=h)
    got = {(r.begun, r.k): (r.n, r.v) for r in flow.latest(["begun", "ended", "k"]).collect()}
    # the row at minute 5 comes when the watermark is at minute 181; that at minute 200 is in time
    assert got == {(hour(0), 1): (2, 3.0), (hour(5), 2): (2, 20.0), (hour(5), None): (1, 1.0), (hour(3), 1): (1, 32.0)}
    assert flow.late_rows() == 1


def test_engagement_keeps_state_across_restarts_and_closes_by_timer(spark):
    loads = [[(1, 0, 1.0), (1, 10, None), (2, 0, 5.0), (None, 3, 1.0)], [(1, 30, 4.0), (2, 200, 7.0), (2, 150, 1.0)], [(3, 1000, 0.0)]]
    flow = incremental.Incremental(spark, arrivals(spark, loads[0]).schema, lambda e: incremental.engagement(e, "k", "t", "v", 60 * 60_000, "1 minute"))
    told = []
    for rows in loads:
        flow.load(arrivals(spark, rows))
        told.append(sorted((r.key, r.state, (r.begun - START).seconds // 60, (r.ended - START).seconds // 60, r.rows, r.value) for r in flow.log().collect()))
    assert told[0] == [(1, "running", 0, 10, 2, 1.0), (2, "running", 0, 0, 1, 5.0)]
    assert set(told[1]) - set(told[0]) == {(1, "running", 0, 30, 3, 5.0), (1, "closed", 0, 30, 3, 5.0), (2, "closed", 0, 0, 1, 5.0), (2, "running", 150, 200, 2, 8.0)}
    assert set(told[2]) - set(told[1]) == {(2, "closed", 150, 200, 2, 8.0), (3, "running", 1000, 1000, 1, 0.0)}


def plain_engagement(loads, idle, late):
    """What keyed state tells, a key at a time: (key, state, begun, ended, rows, value)."""
    held, told, latest = {}, [], 0
    for rows in loads:
        rows = sorted((k, t, 0.0 if v is None or v != v else v) for k, t, v in rows if None not in (k, t))
        for k, t, v in rows:
            if k in held and t - held[k][1] > idle:
                told.append((k, "closed", *held.pop(k)))
            begun, ended, n, value = held.get(k, (t, t, 0, 0.0))
            held[k] = (min(begun, t), max(ended, t), n + 1, value + v)
        told += [(k, "running", *held[k]) for k in {k for k, _, _ in rows}]
        latest = max([latest, *[t for _, t, _ in rows]])
        told += [(k, "closed", *held.pop(k)) for k in list(held) if held[k][1] + idle < latest - late]
    return told


@pytest.mark.parametrize("buckets", [1, 3, 1024])
def test_keys_of_a_bucket_keep_runs_of_their_own(spark, buckets):
    rng = random.Random(buckets)
    key = lambda: rng.choice([0, 0, 0, 0, None, *range(-20, 20)])
    loads, latest = [], 30
    for _ in range(3):  # rows up to 30 minutes behind the latest of the load before
        loads.append([(key(), rng.choice([None, *range(latest - 30, latest + 200)]), rng.choice([None, 0.25, 2.0, float("nan")])) for _ in range(120)])
        latest = max(t for k, t, _ in loads[-1] if None not in (k, t))
    loads.append([(99, latest + 500, 1.0)])
    flow = incremental.Incremental(spark, arrivals(spark, loads[0]).schema, lambda e: incremental.engagement(e, "k", "t", "v", 60 * 60_000, "31 minutes", buckets))
    for rows in loads:
        flow.load(arrivals(spark, rows))
    minute = lambda at: int((at - START).total_seconds()) // 60
    got = sorted((r.key, r.state, minute(r.begun), minute(r.ended), r.rows, r.value) for r in flow.log().collect())
    want = plain_engagement(loads, 60, 31)
    assert got == sorted(want) and sum(r[1] == "closed" for r in want) > 40


def test_engagement_of_many_keys_shares_state_and_timers(spark):
    rows = arrivals(spark, [(k, k % 50, 1.0) for k in range(5000)])
    flow = incremental.Incremental(spark, rows.schema, lambda e: incremental.engagement(e, "k", "t", "v", 60 * 60_000, "1 minute"))
    flow.load(rows)
    assert flow.log().where("state = 'running'").select("key").distinct().count() == 5000
    # with a state a key, 5,000 and as many calls of Python
    assert max(o["numRowsTotal"] for p in flow.progress for o in p["stateOperators"]) < 2500


def test_a_batch_that_runs_again_replaces_its_rows(spark):
    rows = arrivals(spark, [(1, 0, 1.0)])
    flow = incremental.Incremental(spark, rows.schema, lambda e: incremental.event_windows(e, "t", "1 hour", aggregates=[F.count("*").alias("n")]), "update")
    flow.load(rows)
    again = flow.log().where("batch = 0").drop("batch").collect()
    spark.createDataFrame(again, flow.log().drop("batch").schema).write.mode("overwrite").parquet(f"{flow.results}/batch=0")
    flow.run()
    assert [r.n for r in flow.latest(["begun", "ended"]).collect()] == [1]


def test_queries_on_the_smallest_tables(spark):
    for name in ("events_last_order", "order_before", "overlapping_orders", "purchases_in_errors", "user_sessions"):
        assert over_time.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name


@pytest.fixture(params=["1", "5", "60"])
def ranges(spark, request):
    """That many range partitions, whatever the size."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield int(request.param)
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_framed_windows_agree_with_plain_ones(spark, ranges):
    from pyspark.sql import Window

    rng = random.Random(8)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2, None]), i, rng.choice([None, 1.0, 2.5, 7.0]), rng.randrange(60)) for i in range(150)] + [(9, 900, 1.0, 3)]
    df = spark.createDataFrame(rows, "k long, id long, PART double, t long")
    plain = Window.partitionBy("k").orderBy(F.desc("t"), "id")
    columns = {"a": lambda w: F.lag("PART", 5).over(w), "b": lambda w: F.lead("id", 4).over(w), "c": lambda w: F.sum("PART").over(w.rowsBetween(-3, 2)), "d": lambda w: F.count("*").over(w.rowsBetween(1, 4))}
    want = sorted(map(tuple, df.select("*", *[f(plain).alias(n) for n, f in columns.items()]).collect()), key=str)
    got = ordered.windowed(df, ["k"], [F.desc("t"), F.col("id")], columns, before=5, after=4)
    assert got.columns == [*df.columns, *columns] and sorted(map(tuple, got.collect()), key=str) == want
    assert ordered.windowed(df.where("false"), ["k"], [F.col("id")], columns, 5, 4).count() == 0
    # without a key all rows are in one order
    got = ordered.windowed(df, [], [F.col("id")], {"x": lambda w: F.lag("id").over(w)}, before=1)
    assert sorted(map(tuple, got.select("id", "x").collect()))[:2] == [(0, None), (1, 0)]


@pytest.mark.parametrize(("before", "after"), [(0, 0), (5, 0), (0, 3), (20, 40)])
def test_range_windows_agree_with_plain_ones(spark, ranges, before, after):
    from pyspark.sql import Window

    rng = random.Random(9)
    rows = [(rng.choice([0, 0, 0, 0, 1, None]), i, rng.randrange(9), rng.choice([30, 30, *range(60)])) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, id long, v long, t long")
    columns = {"n": lambda w: F.count("*").over(w), "s": lambda w: F.sum("v").over(w)}
    plain = Window.partitionBy("k").orderBy("t").rangeBetween(-before, after)
    want = sorted(map(tuple, df.select("*", *[f(plain).alias(n) for n, f in columns.items()]).collect()), key=str)
    with_null = df.union(spark.createDataFrame([(0, 999, 1, None)], df.schema))
    got = sorted(map(tuple, ordered.range_windowed(with_null, ["k"], "t", columns, before, after).collect()), key=str)
    assert got == sorted([*want, (0, 999, 1, None, None, None)], key=str)


def test_tiles_agree_with_ntile(spark, ranges):
    from pyspark.sql import Window

    df = spark.createDataFrame([(k, i) for k, n in ((0, 1), (1, 6), (2, 7), (3, 50), (None, 9)) for i in range(n)], "k long, id long")
    want = df.withColumn("tile", F.ntile(7).over(Window.partitionBy("k").orderBy("id")))
    assert sorted(map(tuple, ordered.tiled(df, ["k"], [F.col("id")], 7).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_places_in_an_order(spark, ranges):
    from fitrank.storage import in_order, row_numbers

    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "id long, local string")
    got = row_numbers(df, [F.desc("id")], "n").collect()
    assert sorted((r.id, r.n) for r in got) == [(i, 100 - i) for i in range(101)]
    _, parts = in_order(df, [F.col("id")], "p", "n")
    assert parts.agg(F.sum("rows")).first()[0] == 101
