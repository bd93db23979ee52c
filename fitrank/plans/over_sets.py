"""Queries over groups, multisets and table functions, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mentions import register_mentions
from ..operators import multisets, sketches
from ..profile import corpus_profile
from ..shipping import ship
from ..sources import sinks, workbooks
from ..storage import shared_path, written
from . import oracles
from .candidate_view import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- sketches ----------------------------------------------------------------------------------------------------


def frequent_errors(counts, told, most: int = 5):
    """event_type and the largest error of its frequent users as a share of its rows. A named user's error is that of its
    count; any other's is by how much it outnumbers the last of `most` named ones. Sketches of more users than they have
    items name only those they are sure of, maybe none: then the last one counts as 0."""
    last = F.coalesce(F.get("frequent", F.lit(most - 1))["n"], F.lit(0))
    named = told.select("event_type", F.explode("frequent").alias("f")).select("event_type", F.col("f.item").alias("user_id"), F.col("f.n").alias("n"))
    both = counts.where("user_id is not null").join(named, ["event_type", "user_id"], "full").join(F.broadcast(told.select("event_type", "told_rows", last.alias("last"))), "event_type")
    off = F.when(F.col("n").isNull(), F.col("count") - F.col("last")).otherwise(F.abs(F.col("n") - F.coalesce("count", F.lit(0))))
    return both.groupBy("event_type").agg(F.max(F.greatest(off, F.lit(0)) / F.col("told_rows")).alias("error"))


@query("SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, true AS users_near, true AS quantiles_near, true AS frequent_near FROM events GROUP BY event_type")
def sketch_rollup(spark, sf_dir):
    """Sketches by day and type, written, then rolled up by type and held against exact figures: distinct users within 5 %,
    ranks of three quantiles within 2 %, and counts of the five most frequent users within a hundredth of the rows."""
    events = table(spark, sf_dir, "events")
    fine = written(sketches.sketched(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], ["user_id"], ["value"], ["user_id"]), "sketches")
    told = sketches.estimates(sketches.rolled_up(fine, ["event_type"]), (0.1, 0.5, 0.9), 5)
    told = written(told.select("event_type", F.col("rows").alias("told_rows"), "distinct_user_id", "quantile_value", F.transform("frequent_user_id", lambda i: F.struct(i["item"].alias("item"), i["count"].alias("n"))).alias("frequent")), "estimates")
    both = events.join(F.broadcast(told), "event_type")  # a row a type
    below = [F.avg((F.col("value") <= F.col("quantile_value")[i]).cast("double")).alias(f"below{i}") for i in range(3)]
    exact = both.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.first("told_rows").alias("told_rows"), F.first("distinct_user_id").alias("told"), *below)
    errors = frequent_errors(events.groupBy("event_type", "user_id").count(), told).select("event_type", (F.col("error") <= 0.01).alias("frequent_near"))
    ranks = F.greatest(*[F.abs(F.col(f"below{i}") - r) for i, r in enumerate((0.1, 0.5, 0.9))]) <= 0.02
    near = (F.abs(F.col("told") - F.col("users")) <= 0.05 * F.col("users")) & (F.col("told_rows") == F.col("rows"))
    return exact.join(errors, "event_type", "left").select("event_type", "rows", "users", near.alias("users_near"), ranks.alias("quantiles_near"), F.coalesce("frequent_near", F.lit(False)).alias("frequent_near"))


# --- grouping sets -----------------------------------------------------------------------------------------------

FACTS = "f AS (SELECT r_name, n_name, c_mktsegment, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SUMS = "count(*) AS orders, round(sum(o_totalprice), 2) AS price"


def _facts(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("r_name", "n_name", "c_mktsegment", "o_orderpriority", "o_totalprice")


def _sums():
    return [F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price")]


@query(f"WITH {FACTS} SELECT r_name, n_name, {SUMS}, CAST(grouping(r_name, n_name) AS BIGINT) AS level FROM f GROUP BY ROLLUP (r_name, n_name)")
def region_rollup(spark, sf_dir):
    return _facts(spark, sf_dir).rollup("r_name", "n_name").agg(*_sums(), F.grouping_id().alias("level"))


@query(f"WITH {FACTS} SELECT r_name, c_mktsegment, o_orderpriority, {SUMS}, CAST(grouping(r_name, c_mktsegment, o_orderpriority) AS BIGINT) AS level FROM f GROUP BY CUBE (r_name, c_mktsegment, o_orderpriority)")
def segment_cube(spark, sf_dir):
    return _facts(spark, sf_dir).cube("r_name", "c_mktsegment", "o_orderpriority").agg(*_sums(), F.grouping_id().alias("level"))


@query(f"WITH {FACTS} SELECT n_name, c_mktsegment, o_orderpriority, {SUMS} FROM f GROUP BY GROUPING SETS ((n_name), (c_mktsegment, o_orderpriority), ())")
def order_sets(spark, sf_dir):
    sets = [["n_name"], ["c_mktsegment", "o_orderpriority"], []]
    return _facts(spark, sf_dir).groupingSets(sets, "n_name", "c_mktsegment", "o_orderpriority").agg(*_sums())


# --- multisets ---------------------------------------------------------------------------------------------------

SIDES = "a AS (SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice > 250000), b AS (SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_custkey % 3 = 0)"


@query(f"""WITH {SIDES}, k AS (SELECT * FROM a UNION SELECT * FROM b), c AS (SELECT *, count(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY ALL),
x AS (SELECT *, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL), y AS (SELECT *, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL), u AS (SELECT *, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT k.*, coalesce(c.n, 0) AS common, coalesce(x.n, 0) AS only_a, coalesce(y.n, 0) AS only_b, u.n AS united FROM k LEFT JOIN c USING (o_orderpriority, o_orderstatus) LEFT JOIN x USING (o_orderpriority, o_orderstatus) LEFT JOIN y USING (o_orderpriority, o_orderstatus) JOIN u USING (o_orderpriority, o_orderstatus)""")
def order_multisets(spark, sf_dir):
    """Two selections of orders as multisets of priority and status."""
    orders = table(spark, sf_dir, "orders")
    return multisets.multiset_operations(orders.where("o_totalprice > 250000"), orders.where("o_custkey % 3 = 0"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT p_brand, p_size FROM part WHERE p_size > 25 EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0")
def parts_except_all(spark, sf_dir):
    """Rows that one list has more often than the other, as often as they are more."""
    parts, columns = table(spark, sf_dir, "part"), ["p_brand", "p_size"]
    return multisets.repeated(multisets.multiset_operations(parts.where("p_size > 25"), parts.where("p_partkey % 2 = 0"), columns), "only_a", columns)


# --- table functions ---------------------------------------------------------------------------------------------

#: Terms of the synthetic documents with words that take them back.
MENTIONED = corpus_profile().but(negation=r"(?:\bthan|\bthe|\bof)", aspiration=r"\b(?:when|this)\b")


def _mentions_sql() -> str:
    """Counts by concept: all mentions, those after a negation, and others after an aspiration of their sentence."""
    parts = []
    negated = oracles.quoted(MENTIONED.negation + r"\s+(?:[\w'/-]+\s+){0,2}$")
    for name, terms in MENTIONED.concepts.items():
        cut = rf"string_split(regexp_replace(t, {oracles.quoted(oracles.words(terms))}, chr(2) || '\1', 'g'), chr(2))"
        parts.append(f"SELECT doc_id, {oracles.quoted(name)} AS concept, list_transform(range(1, len({cut})), lambda i: array_to_string(({cut})[1:i], '')) AS prefixes FROM d")
    count = lambda c: f"CAST(len(list_filter(prefixes, lambda p: {c})) AS BIGINT)"
    is_negated = f"regexp_matches(right(p, 40), {negated})"
    is_aspired = rf"regexp_matches(regexp_extract(p, '[^.!?\n]*$'), {oracles.quoted(MENTIONED.aspiration)})"
    return f"""WITH d AS (SELECT doc_id, {oracles.FOLD.format('text')} AS t FROM documents), m AS ({' UNION ALL '.join(parts)})
SELECT doc_id, concept, CAST(len(prefixes) AS BIGINT) AS mentions, {count(is_negated)} AS negated, {count(f'NOT {is_negated} AND {is_aspired}')} AS aspired FROM m WHERE len(prefixes) > 0"""


@query(_mentions_sql())
def lexicon_mentions(spark, sf_dir):
    """Mentions of each concept by document, from a table function in SQL text."""
    name = register_mentions(spark, MENTIONED)
    table(spark, sf_dir, "documents").createOrReplaceTempView("mentioning_documents")
    return spark.sql(f"""SELECT d.doc_id, m.concept, count(*) AS mentions, count_if(m.suppressed = 'negation') AS negated, count_if(m.suppressed = 'aspiration') AS aspired
    FROM mentioning_documents d, LATERAL {name}(d.text) m GROUP BY d.doc_id, m.concept""")


# --- workbooks ---------------------------------------------------------------------------------------------------


#: Customers of all nations whose workbooks are written one a nation; more are dealt to several.
CUSTOMERS_A_PART = 200_000


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def workbook_scan(spark, sf_dir):
    """Customers as workbooks, one a nation or, of many customers, several of it, read back in ranges of rows."""
    import pandas as pd

    from ..storage import filesystem

    ship(spark)
    folder = shared_path(spark, "workbooks")

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        nation, part = int(rows["c_nationkey"].iloc[0]), int(rows["part"].iloc[0])
        data = sinks.workbook([columns, *rows[columns].sort_values("c_custkey").astype(str).values.tolist()])
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/_{nation}-{part}") as out:
            out.write(data)
        store.move(f"{path}/_{nation}-{part}", f"{path}/nation-{nation:03d}-{part:05d}.xlsx")
        return pd.DataFrame({"nation": [nation], "rows": [len(rows)]})

    columns = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]
    customers = table(spark, sf_dir, "customer").select(*columns)
    parts = customers.count() // CUSTOMERS_A_PART + 1
    placed = customers.withColumn("part", F.pmod(F.xxhash64("c_custkey"), F.lit(parts)))
    placed.groupBy("c_nationkey", "part").applyInPandas(put, "nation long, rows long").agg(F.sum("rows")).first()
    workbooks.register_workbooks(spark)
    return spark.read.format("workbook").option("partitionRows", 25).load(folder)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
