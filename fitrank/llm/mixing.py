"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions alone.

A source's target is its weight's share of all words, at most `ceiling` times what it has; what is above
goes to the others by weight. Whole documents are taken: every document floor(target / words) times, and
for the rest of the target those that come first by md5 of their id (then by id, size and text), long ones (over 1/256 of the source)
before the others, so that the last pass ends within half a short document of the target.

Each pass is a stretch of the source's demand. Weights change over training time: a source's rate is
piecewise linear between the knots of its schedule. Its integral is the cumulative demand; inverting it at
the middle of a document gives the training position in [0, 1], by which documents are range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, row_keys, row_numbers, written

#: Words of the contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: (time, rate) knots by weight: common sources fade, rare ones grow.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def source_targets(sizes: DataFrame, weights: int = 3, ceiling: int = 3) -> DataFrame:
    """(source, source_size) -> also number (from 0 by code point, null last), weight and target.

    With caps c and weights w, the targets are min(c, level * w): sources above their cap are capped and the level that
    spends the rest on the others is worked out anew, until none is above. Each round is one aggregate."""
    numbered = row_numbers(sizes, [F.col("source").asc_nulls_last()], "number")
    rows = written(numbered.withColumn("weight", F.col("number") % weights + 1).withColumn("cap", F.col("source_size") * ceiling), "numbered")
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        now = rows.agg(F.count_if(above).alias("n"), F.sum("source_size").alias("whole"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("spent"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if now["n"] == capped or not now["weight"]:
            break
        capped, level = now["n"], float(now["whole"] - now["spent"]) / float(now["weight"])
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "number", "weight", "target")


def invert_schedule(share: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear rate has reached `share` of its whole."""
    parts = [((t1 - t0) * (r0 + r1) / 2, t0, t1, r0, r1) for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
    total, done, time = sum(p[0] for p in parts), 0.0, None
    for area, t0, t1, r0, r1 in parts:
        rest = F.greatest(share * total - done, F.lit(0.0))
        slope = (r1 - r0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + 2 * slope * rest, F.lit(0.0)))
        here = F.least(F.lit(t1), F.lit(t0) + 2 * rest / (F.lit(r0) + root))
        time = F.when(share * total <= done + area, here) if time is None else time.when(share * total <= done + area, here)
        done += area
    return time.otherwise(F.lit(float(knots[-1][0])))


def schedule_sql(share: str, knots) -> str:
    """The same as DuckDB SQL."""
    parts = [((t1 - t0) * (r0 + r1) / 2, t0, t1, r0, r1) for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
    total, done, cases = sum(p[0] for p in parts), 0.0, []
    number = lambda x: f"{float(x)!r}::DOUBLE"
    for area, t0, t1, r0, r1 in parts:
        rest = f"greatest({share} * {number(total)} - {number(done)}, 0::DOUBLE)"
        root = f"sqrt(greatest({number(r0 * r0)} + {number(2 * ((r1 - r0) / (t1 - t0)))} * {rest}, 0::DOUBLE))"
        done += area
        cases.append(f"WHEN {share} * {number(total)} <= {number(done)} THEN least({number(t1)}, {number(t0)} + 2 * {rest} / ({number(r0)} + {root}))")
    return f"CASE {' '.join(cases)} ELSE {number(knots[-1][0])} END"


def _before(rows: DataFrame) -> DataFrame:
    """Adds `before`: the words of earlier rows of the same source and kind (long or not), in order of mark, doc_id, size
    and text, so that only equal rows change places. Rows are dealt by leading digits of their mark, so a hot source is spread over many tasks; as there are at
    most three digits, its deals are few enough for one."""
    keys = ["source", "long", "deal"]
    dealt = rows.withColumn("deal", F.expr("substring(mark, 1, digits)"))
    upto = Window.partitionBy("source", "long").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys).agg(F.sum("size").alias("part"))
    offsets = parts.select(*keys, F.coalesce(F.sum("part").over(upto), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys).orderBy("mark", "doc_id", "size", "text_mark").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return inside.alias("a").join(offsets.alias("b"), same).select("a.*", (F.col("b.offset") + F.col("a.inside")).alias("before")).drop("inside", "deal", "text_mark")


def _with(rows: DataFrame, sources: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Adds columns of a table by source (null is a source)."""
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    return rows.alias("r").join(sources.alias("s"), same, how).select("r.*", *[f"s.{c}" for c in columns])


def mix(docs: DataFrame, weights: int = 3, ceiling: int = 3, schedules=SCHEDULES, block: int = 256, key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, passes (whole times taken), taken (words, repeats
    counted) and positions (training time of each time it is taken, ascending with the pass).

    Null texts have 0 words; a document of no words is taken 0 times. A null source is a source, after
    all others. Repeated rows count each; `key` names a column that tells rows apart (default doc_id).
    Reruns agree: the order comes from ids, sizes and texts, never from places; rows equal in all three have the same
    values up to their keys. An empty table gives no rows."""
    keep = [key] if key != "doc_id" else []
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    text_mark = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    narrow = written(docs.select("doc_id", *keep, "source", words.alias("size"), mark.alias("mark"), text_mark.alias("text_mark")), "sizes")
    sources = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ceiling)
    is_long = F.col("size") * 256 > F.col("source_size")
    sized = written(sources, "targets")
    parts = _with(narrow, sized, "source_size").groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.when(is_long, F.col("size")).otherwise(0)).alias("long_size"))
    digits = F.least(F.lit(3), F.ceil(F.log(F.greatest(F.lit(1.0), F.col("rows") / block)) / F.log(F.lit(16.0)))).cast("int")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    known = written(_with(sized, parts, "rows", "long_size").withColumn("digits", digits).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    columns = ("source_size", "number", "target", "digits", "whole", "rest", "long_size")
    rows = _before(_with(narrow, known, *columns).withColumn("long", is_long))
    # long documents first; the others fill what these left of the rest
    half = lambda quota: (F.col("before") * 2 + F.col("size")).cast("double") <= 2 * quota
    long_quota = F.col("rest") * F.col("long_size") / F.col("source_size")
    spent = rows.where(F.col("long") & half(long_quota)).groupBy("source").agg(F.sum("size").alias("spent"))
    rows = _with(rows, spent, "spent", how="left")
    quota = F.when(F.col("long"), long_quota).otherwise(F.col("rest") - F.coalesce("spent", F.lit(0)))
    again = (F.col("size") > 0) & half(quota)
    rows = rows.withColumn("passes", F.when(F.col("size") > 0, F.col("whole") + again.cast("long")).otherwise(F.lit(0)))
    middle = F.col("before") + F.col("size") / 2 + F.when(F.col("long"), F.lit(0)).otherwise(F.col("long_size"))
    # each pass of a source takes its stretch of the demand; the last, partial one is stretched over what is left of it
    share = lambda k: F.when(k < F.col("whole"), (k * F.col("source_size") + middle) / F.col("target")).otherwise(F.least(F.lit(1.0), (F.col("whole") * F.col("source_size") + middle * F.col("rest") / F.col("source_size")) / F.col("target")))

    def position(k):
        time = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            time = F.when(F.col("number") % len(schedules) == i, invert_schedule(share(k), knots)).otherwise(time)
        return time

    positions = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), position)).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", *keep, "size", "source", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"), positions.alias("positions"))


def in_training_order(plan: DataFrame) -> DataFrame:
    """Rows of a mix with the training positions of their first and last pass (to nine places), range-sorted by the
    first; what is never taken has none and comes last."""
    place = lambda i: F.round(F.try_element_at("positions", F.lit(i)), 9)
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("last_position")]
    return plan.withColumn("first_position", place(1)).withColumn("last_position", place(-1)).repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as taken, range-sorted by training position, which is
    kept as the column mix_position."""
    key, position = free_name(docs, "mix_row"), free_name(docs, "mix_position")
    rows = row_keys(docs, key)
    plan = mix(rows, key=key, **options).where("passes > 0").select(key, F.explode("positions").alias(position))
    return rows.join(plan, key).repartitionByRange(position, key).sortWithinPartitions(position, key).drop(key)
