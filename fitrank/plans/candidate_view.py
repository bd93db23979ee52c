"""A deterministic candidate table over the synthetic tables, so that whole plans can run on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import month_diff
from ..operators.texts import PREFIX, with_found
from ..storage import written

SNAPSHOT = date(2024, 2, 1)
#: Orders end years before the events; they are moved so that careers reach the snapshot.
YEARS_ON = 22

TITLES = ("Search Engineer", "Data Scientist", "Content Writer", "ML Engineer", "Computer Vision Engineer", "Junior Developer", "Project Manager")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes in files of documents that travel to the customers; more are joined to them before anything else is.
BROADCAST_TEXTS = 64 << 20
#: Orders of a few customers that travel to the line items, some 30 MB.
BROADCAST_ORDERS = 500_000


def candidates(spark: SparkSession, sf_dir: str, texts: bool = True, profiles: tuple = (), among: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """Customers as profiles, their orders as roles, line items as skills, events as signals, documents as texts. Without
    texts summaries are null and documents are not read. `profiles`: what scoring and auditing look for; documents are
    read for them once each, however many customers share them. `among` (key): only these customers are built, whatever
    their number. `semantic` (candidate_id, semantic) adds that column."""
    whole = lambda name: table(spark, sf_dir, name)
    keys = None if among is None else among.select(F.col("key").alias("_among"))
    of = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"}
    t = lambda name: whole(name) if keys is None or name not in of else whole(name).join(keys, F.col(of[name]) == F.col("_among"), "left_semi")
    title = lambda k: F.element_at(F.array(*[F.lit(x) for x in TITLES]), (k % len(TITLES)).cast("int") + 1)
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    shifted = t("orders").withColumn("o_orderdate", F.add_months("o_orderdate", YEARS_ON * 12))
    orders = shifted.withColumn("next", F.lead("o_orderdate").over(by_date))
    real = month_diff(F.col("o_orderdate"), F.coalesce("next", F.lit(SNAPSHOT)))
    claimed = real + F.col("o_orderkey") % 4 + F.when(F.col("o_orderkey") % 40 == 0, 30).otherwise(0)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    role = F.struct(
        F.col("o_orderkey").alias("k"), title(F.col("o_orderkey")).alias("title"), F.lit(None).cast("string").alias("description"), F.concat(F.lit("Company "), F.col("o_orderkey") % 40).alias("company"), F.col("o_orderpriority").alias("industry"),
        day(F.col("o_orderdate")).alias("start_date"), day(F.col("next")).alias("end_date"), claimed.cast("double").alias("duration_months"), F.col("next").isNull().alias("is_current"),
    )
    career = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(role)).alias("career"))
    skill = F.struct(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), (-F.col("place")).alias("back"), F.concat(F.lit("skill "), F.col("l_partkey") % 60).alias("name"), F.when(F.col("l_discount") > 0.07, "expert").when(F.col("l_discount") > 0.04, "advanced").otherwise("intermediate").alias("proficiency"), F.when(F.col("l_quantity") < 3, 0.0).otherwise(F.col("l_quantity")).alias("duration_months"))
    # of line items with one number the first in the file is the last claim
    items = t("lineitem").select("*", F.col("_metadata.row_index").alias("place"))
    bought = t("orders").select("o_orderkey", "o_custkey")
    if keys is not None and bought.count() <= BROADCAST_ORDERS:
        bought = F.broadcast(bought)
    skills = items.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(skill)).alias("skill")).withColumnRenamed("o_custkey", "s_custkey")
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    seen = t("events").groupBy("user_id").agg(day(F.max("ts")).alias("last"), share("click").alias("clicks"), F.count("*").alias("n"), F.avg("value").alias("value"))
    assessed = F.create_map(F.concat(F.lit("Skill "), F.col("n") % 60), (F.col("n") * 7 % 100).cast("double"), F.concat(F.lit("with skill "), F.col("n") % 10), (F.col("n") * 3 % 100).cast("double"))
    signals = F.struct(
        (F.col("n") % 2 == 0).alias("open_to_work_flag"), (F.col("n") * 3).cast("double").alias("notice_period_days"), (F.col("n") % 3 == 0).alias("willing_to_relocate"), F.col("clicks").alias("recruiter_response_rate"), (F.col("value") * 2).alias("avg_response_time_hours"), F.col("last").alias("last_active_date"),
        F.least(F.col("value"), F.lit(100.0)).alias("github_activity_score"), (F.col("n") % 5 == 0).alias("verified_email"), (F.col("n") % 7 == 0).alias("verified_phone"), (F.col("n") % 2 == 1).alias("linkedin_connected"), assessed.alias("skill_assessment_scores"),
    )
    k = F.col("c_custkey")
    profile = F.struct(F.col("text").alias("summary"), F.col("c_name").alias("headline"), title(k).alias("current_title"), F.concat(F.lit("Company "), k % 40).alias("current_company"), (F.abs(F.col("c_acctbal")) / 1200 + 5).alias("years_of_experience"), F.col("n_name").alias("location"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("current_industry"))
    education = F.array(F.struct(F.concat(F.lit("tier_"), k % 4 + 1).alias("tier"), (k % 10 + 2000).cast("bigint").alias("start_year"), (k % 10 + 2004 - F.when(k % 50 == 0, 5).otherwise(0)).cast("bigint").alias("end_year")))
    customers = t("customer")
    people = customers.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if semantic is not None:
        # here rows are narrow
        people = people.join(semantic.select(F.col("candidate_id").alias("_id"), "semantic"), F.format_string("CAND_%07d", k) == F.col("_id"), "left").drop("_id")
    docs = None
    if texts:
        docs = t("documents").select("doc_id", "text")
        n_docs = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1  # from the files' statistics
        if keys is not None:
            docs = docs.join(customers.select((k % n_docs).alias("_doc")).distinct(), F.col("doc_id") == F.col("_doc"), "left_semi")
        if profiles:
            # written, so that nothing is found anew for every customer; cut fine, because a file may be one task
            docs = written(with_found(docs.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id"), "text", profiles), "found")
        shared = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_TEXTS
        if not shared:
            people, docs = people.join(docs, k % n_docs == F.col("doc_id")), None
    else:
        people = people.withColumn("text", F.lit(None).cast("string"))
    rows = people.join(career, k == F.col("o_custkey"), "left").join(skills, k == F.col("s_custkey"), "left").join(seen, k == F.col("user_id"), "left")
    if docs is not None:
        # last, so that no shuffle holds the texts of every customer
        rows = rows.join(F.broadcast(docs), k % n_docs == F.col("doc_id"))
    found = [c for c in rows.columns if c.startswith(PREFIX)] + ["semantic"] * (semantic is not None)
    strip = lambda c, names: F.transform(F.coalesce(F.col(c), F.array()), lambda r: F.struct(*[r[n].alias(n) for n in names]))
    return rows.select(
        k.alias("key"), F.format_string("CAND_%07d", k).alias("candidate_id"), profile.alias("profile"), strip("career", ["title", "description", "company", "industry", "start_date", "end_date", "duration_months", "is_current"]).alias("career_history"),
        education.alias("education"), strip("skill", ["name", "proficiency", "duration_months"]).alias("skills"), F.when(F.col("user_id").isNotNull(), signals).alias("signals"), *found,
    )
