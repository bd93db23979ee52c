"""Queries over time and order, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from ..streaming import incremental
from .candidate_view import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
MINUTE = 60_000_000
HOUR, DAY = 60 * MINUTE, 24 * 60 * MINUTE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- as-of joins -------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate)
SELECT e.event_id, o.o_orderkey, o.o_orderdate FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def events_last_order(spark, sf_dir):
    """Every event with its user's last order before it."""
    found = ordered.asof_join(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders"), "ts", "o_orderdate", [("user_id", "o_custkey")], ["o_orderkey", "o_orderdate"])
    return found.select("event_id", "o_orderkey", "o_orderdate")


@query("""WITH p AS (SELECT o_custkey, o_orderdate, max(struct_pack(price := o_totalprice, k := o_orderkey)) AS best FROM orders GROUP BY o_custkey, o_orderdate)
SELECT x.o_orderkey, CASE WHEN date_diff('day', p.o_orderdate, x.o_orderdate) <= 90 THEN p.best.k END AS earlier_order, CASE WHEN date_diff('day', p.o_orderdate, x.o_orderdate) <= 90 THEN p.best.price END AS earlier_price
FROM orders x ASOF LEFT JOIN p ON x.o_custkey = p.o_custkey AND x.o_orderdate > p.o_orderdate""")
def order_before(spark, sf_dir):
    """Every order with its customer's last order of an earlier day, at most 90 days before; of several the dearest."""
    orders = table(spark, sf_dir, "orders")
    earlier = orders.select("o_custkey", "o_orderdate", F.col("o_totalprice").alias("earlier_price"), F.col("o_orderkey").alias("earlier_order"))
    found = ordered.asof_join(orders, earlier, "o_orderdate", "o_orderdate", [("o_custkey", "o_custkey")], ["earlier_price", "earlier_order"], tolerance=90 * DAY, strict=True)
    return found.select("o_orderkey", "earlier_order", "earlier_price")


@query("""WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.event_id, CASE WHEN p.ts - v.ts <= INTERVAL 6 HOUR THEN v.view_id END AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def purchase_last_view(spark, sf_dir):
    """Every purchase with its user's last view in the six hours before."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    found = ordered.asof_join(events.where("event_type = 'purchase'"), views, "ts", "ts", [("user_id", "user_id")], ["view_id"], tolerance=6 * HOUR)
    return found.select("event_id", "view_id")


# --- spans -------------------------------------------------------------------------------------------------------

SPANS = "s AS (SELECT o_orderkey, o_custkey, o_orderdate AS begun, max(l_shipdate) AS ended FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def _order_spans(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended"))
    return orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("begun"), "ended")


@query(f"""WITH {SPANS} SELECT x.o_custkey, x.o_orderkey AS first_order, y.o_orderkey AS second_order FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey
AND x.begun < y.ended AND y.begun < x.ended AND x.begun < x.ended AND y.begun < y.ended""")
def overlapping_orders(spark, sf_dir):
    """Pairs of a customer's orders that were open at one time, from order to last shipment."""
    spans = _order_spans(spark, sf_dir)
    pairs = ordered.overlap_join(spans, spans, ("begun", "ended"), ("begun", "ended"), [("o_custkey", "o_custkey")], touching=False, unit=DAY)
    return pairs.where("l.o_orderkey < r.o_orderkey").select("l.o_custkey", F.col("l.o_orderkey").alias("first_order"), F.col("r.o_orderkey").alias("second_order"))


@query("""WITH s AS (SELECT event_id, ts, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS until FROM events WHERE event_type = 'error' AND value >= 0)
SELECT s.event_id, count(*) AS purchases, round(sum(p.value), 6) AS value FROM s JOIN events p ON p.event_type = 'purchase' AND p.ts BETWEEN s.ts AND s.until GROUP BY s.event_id""")
def purchases_in_errors(spark, sf_dir):
    """Purchases of any user while an error lasts: points in spans of very different lengths, without a key."""
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'error' and value >= 0").select("event_id", "ts", F.timestamp_add("MINUTE", F.floor("value"), "ts").alias("until"))
    found = ordered.overlap_join(spans, events.where("event_type = 'purchase'").select("ts", "value"), ("ts", "until"), ("ts", "ts"), unit=MINUTE)
    return found.groupBy("l.event_id").agg(F.count("*").alias("purchases"), F.round(F.sum("r.value"), 6).alias("value"))


# --- sessions ----------------------------------------------------------------------------------------------------

SESSIONS = """b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS begins FROM events WHERE ts IS NOT NULL),
n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM b)"""


@query(f"""WITH {SESSIONS} SELECT user_id, min(ts) AS begun, max(ts) AS ended, count(*) AS events, round(sum(value), 6) AS value FROM n GROUP BY user_id, number""")
def user_sessions(spark, sf_dir):
    """Runs of a user's events with four hours at most from one to the next."""
    rows = ordered.with_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 4 * HOUR, ["event_id"])
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("begun"), F.max("ts").alias("ended"), F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value")).drop("session")


# --- framed windows ----------------------------------------------------------------------------------------------


@query("""SELECT event_id, lag(value, 2) OVER w AS two_before, lead(event_type) OVER w AS next_type, round(avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbours(spark, sf_dir):
    """Each event with values of its user's events around it."""
    columns = {"two_before": lambda w: F.lag("value", 2).over(w), "next_type": lambda w: F.lead("event_type").over(w), "mean": lambda w: F.round(F.avg("value").over(w.rowsBetween(-3, 1)), 6)}
    rows = ordered.windowed(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], columns, before=3, after=1)
    return rows.select("event_id", *columns)


@query("""SELECT event_id, count(*) OVER w AS in_a_day, max(value) OVER w AS highest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 HOUR FOLLOWING)""")
def rolling_day(spark, sf_dir):
    """Each event with its user's events of the day before it and the hour after it."""
    columns = {"in_a_day": lambda w: F.count("*").over(w), "highest": lambda w: F.max("value").over(w)}
    return ordered.range_windowed(table(spark, sf_dir, "events"), ["user_id"], "ts", columns, before=DAY, after=HOUR).select("event_id", *columns)


@query("SELECT o_orderkey, CAST(ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS tile FROM orders")
def price_tiles(spark, sf_dir):
    return ordered.tiled(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.col("o_totalprice"), F.col("o_orderkey")], 7).select("o_orderkey", "tile")


# --- arriving data -----------------------------------------------------------------------------------------------

#: Events arrive in four loads by time; one in fifty only with the last.
LOADS = 4
ARRIVES = "CASE WHEN event_id % 50 = 7 THEN 3 ELSE CAST(least(3, floor(date_diff('minute', (SELECT min(ts) FROM events), ts) / (7.5 * 24 * 60))) AS INT) END"


def _loads(spark, sf_dir, delayed: bool = False):
    """The events of each load, as their times say; with `delayed`, one in fifty is left to the last."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("ts").alias("first"))
    minutes = F.timestamp_diff("MINUTE", F.col("first"), F.col("ts"))
    number = F.least(F.lit(LOADS - 1), F.floor(minutes / (7.5 * 24 * 60)).cast("int"))
    number = F.when(F.col("event_id") % 50 == 7, LOADS - 1).otherwise(number) if delayed else number
    placed = events.join(F.broadcast(first), F.lit(True)).withColumn("load", number)  # one row
    return [placed.where(F.col("load") == i).select(events.columns) for i in range(LOADS)]


def _closing(spark, sf_dir):
    """One event of no user long after all others, so that every window before it closes."""
    events = table(spark, sf_dir, "events")
    last = events.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"))
    return last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])


def _values():
    return [F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value")]


@query("SELECT date_trunc('hour', ts) AS begun, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ended, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def stream_hours(spark, sf_dir):
    """Tumbling windows of events that arrive in four loads, in a query restarted for each."""
    loads = _loads(spark, sf_dir)
    flow = incremental.Incremental(spark, loads[0].schema, lambda e: incremental.event_windows(e, "ts", "1 hour", by=["event_type"], aggregates=_values(), late="2 hours"), "update", "hours")
    for rows in loads:
        flow.load(rows)
    return flow.latest(["begun", "ended", "event_type"])


@query(f"""WITH a AS (SELECT *, {ARRIVES} AS load FROM events), m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS closed FROM a WHERE load < 3),
w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS begun, * FROM a), e AS (SELECT *, load = 3 AND begun + INTERVAL 6 HOUR <= (SELECT closed FROM m) AS late FROM w)
SELECT begun, event_type, count(*) AS events, round(sum(value), 6) AS value FROM e WHERE NOT late GROUP BY ALL""")
def stream_late(spark, sf_dir):
    """Six-hour windows where one event in fifty arrives with the last load: those more than a day behind are left out."""
    loads = _loads(spark, sf_dir, delayed=True)
    flow = incremental.Incremental(spark, loads[0].schema, lambda e: incremental.event_windows(e, "ts", "6 hours", by=["event_type"], aggregates=_values(), late="1 day"), "update", "late")
    for rows in loads:
        flow.load(rows)
    return flow.latest(["begun", "ended", "event_type"]).drop("ended")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(2 * k) AS begun, * FROM events, range(3) AS r(k))
SELECT begun, user_id, count(*) AS events, max(value) AS highest FROM w GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    """Six-hour windows every two hours, told as they close."""
    loads = _loads(spark, sf_dir)
    sums = [F.count("*").alias("events"), F.max("value").alias("highest")]
    flow = incremental.Incremental(spark, loads[0].schema, lambda e: incremental.event_windows(e, "ts", "6 hours", "2 hours", by=["user_id"], aggregates=sums, late="3 hours"), "append", "sliding")
    for rows in [*loads, _closing(spark, sf_dir)]:
        flow.load(rows)
    return flow.log().where("user_id is not null").drop("batch", "ended")


@query(SQL["user_sessions"])
def stream_sessions(spark, sf_dir):
    """The sessions of a table, found as events arrive."""
    loads = _loads(spark, sf_dir)
    flow = incremental.Incremental(spark, loads[0].schema, lambda e: incremental.event_sessions(e, "ts", "4 hours", by=["user_id"], aggregates=_values(), late="1 hour"), "append", "sessions")
    for rows in [*loads, _closing(spark, sf_dir)]:
        flow.load(rows)
    return flow.log().where("user_id is not null").drop("batch")


@query(f"WITH {SESSIONS} SELECT user_id AS key, min(ts) AS begun, max(ts) AS ended, count(*) AS rows, round(sum(value), 6) AS value FROM n GROUP BY user_id, number")
def stream_engagement(spark, sf_dir):
    """Each user's engagement in keyed state, closed by timers after four idle hours."""
    loads = _loads(spark, sf_dir)
    closing = _closing(spark, sf_dir).withColumn("user_id", F.lit(-1).cast("long"))  # a key of its own moves the watermark
    flow = incremental.Incremental(spark, loads[0].schema, lambda e: incremental.engagement(e, "user_id", "ts", "value", 4 * 3_600_000), "append", "engagement")
    for rows in [*loads, closing]:
        flow.load(rows)
    closed = flow.log().where("state = 'closed' and key >= 0")
    return closed.select("key", "begun", "ended", "rows", F.round("value", 6).alias("value"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
