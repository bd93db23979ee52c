"""Operators on rows in an order: as-of joins, sessions, framed windows and tiles without a task that holds a whole key.

Rows are put into range partitions by key, time and ties, so that a key with a third of all rows spans many of them. A
window then works within each partition, and what it misses is brought over the partition's bounds: the last row before
it, a few rows on either side, or counts of what came before. What crosses bounds is a row a partition (or a frame's
width of rows), and the number of partitions is the session's, not the input's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import free_name, in_order, row_numbers, written

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def ticks(rows: DataFrame, column: str) -> Column:
    """A time as a whole number: microseconds of timestamps and dates, whole numbers as they are, and other numbers as
    doubles; NaN is no time."""
    kind = rows.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def _packed(rows: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Columns as a struct of fields f0, f1, ..., so that their names clash with nothing."""
    return F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(rows.columns if columns is None else columns)])


def _unpacked(name: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(f"{name}.f{i}").alias(c) for i, c in enumerate(columns)]


def in_ranges(rows: DataFrame, order: Sequence[Column], name: str = "part") -> DataFrame:
    """rows with the number of their range partition, written so that it stays."""
    return written(rows.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ranges", "zstd")


def _same(a: Sequence[str | Column], b: Sequence[str | Column]) -> Column:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return reduce(lambda x, y: x & y, [column(x).eqNullSafe(column(y)) for x, y in zip(a, b)], F.lit(True))


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: Sequence[tuple[str, str]] = (), take: Sequence[str] | None = None, tolerance: float | None = None, strict: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Every left row with columns of the last right row of the same key at its time or before (strict: before), as long
    as it is not more than `tolerance` earlier (in ticks; microseconds of timestamps).

    by: pairs of a left and a right column of one type. take: right columns that are added (default all), which must not
    clash with left ones. Of right rows at one time that of the greatest `ties`, then `take` (columns that can be compared)
    counts. Rows of the same key and time may be any number: they spread over partitions. A left row with a null key or
    time, or without a match, gets nulls; a right row with one is never matched. Repeated left rows give a row each."""
    take = list(right.columns if take is None else take)
    clash = {c.lower() for c in left.columns} & {c.lower() for c in take}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    keys = [f"k{i}" for i in range(len(by))]
    side_of = lambda rows, on, side: [*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, on)], side]
    found = _packed(right, take)
    tie = F.struct(*[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate([*ties, *take])])
    rights = right.select(*side_of(right, [r for _, r in by], ticks(right, right_time).alias("at")), F.lit(1 if strict else 0).alias("side"), tie.alias("tie"), F.lit(0).cast("long").alias("salt"), F.struct(found.alias("row"), ticks(right, right_time).alias("at")).alias("found"), F.lit(None).cast(_packed_type(left)).alias("own"))
    lefts = left.select(*side_of(left, [c for c, _ in by], ticks(left, left_time).alias("at")), F.lit(0 if strict else 1).alias("side"), F.lit(None).cast(rights.schema["tie"].dataType).alias("tie"), F.monotonically_increasing_id().alias("salt"), F.lit(None).cast(rights.schema["found"].dataType).alias("found"), _packed(left).alias("own"))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "at"]])
    order = [*keys, "at", "side", "tie", "salt"]
    both = in_ranges(rights.where(whole).unionByName(lefts), [F.col(c) for c in order])
    # the last right row of each partition, and of all before it
    there = F.col("found").isNotNull()
    last = F.max_by(F.when(there, F.struct(*keys, "found")), F.when(there, F.struct(*order)))
    parts = both.groupBy("part").agg(last.alias("last"))
    before = Window.orderBy("part").rowsBetween(*_BEFORE)
    carried = parts.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("part", *keys).orderBy(*order[len(keys) :]).rowsBetween(*_UP_TO_HERE)
    seen = both.join(F.broadcast(carried), "part").withColumn("here", F.last("found", ignorenulls=True).over(within))
    match = F.coalesce("here", F.when(_same(keys, [F.col(f"carried.{k}") for k in keys]), F.col("carried.found")))
    near = F.lit(True) if tolerance is None else F.col("at") - F.col("match.at") <= tolerance
    rows = seen.where("own is not null").withColumn("match", F.when(whole, match))
    row = F.when(near, F.col("match.row"))
    return rows.withColumn("row", row).select(*_unpacked("own", left.columns), *_unpacked("row", take))


def _packed_type(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f"f{i}", f.dataType) for i, f in enumerate(rows.schema.fields)])


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[tuple[str, str]] = (), touching: bool = True, unit: int = 1 << 20) -> DataFrame:
    """Pairs of rows of the same key whose spans overlap, each pair once, as structs `l` and `r`. A span is (start, end); a
    point is a span of its own column twice. touching: spans that share an end only count, and so do empty spans;
    otherwise spans are half-open, and empty ones overlap nothing. Rows with a null key, start or end, or with an end
    before the start, are in no pair.

    A span goes by its length to a level, whose cells are at least as long, so it lies in two of them at most; levels'
    cells are 4 times as long each, from `unit` ticks. Of a pair the longer span's level counts: it meets the cells of its
    level that shorter ones visit, in a join on key and cell. So neither a long span is cut into many pieces nor do short
    ones meet in cells much longer than they. A pair is taken up in the cell where the later of its starts lies."""
    keys = [f"k{i}" for i in range(len(by))]

    def spans(rows: DataFrame, span: tuple[str, str], on: list[str]) -> DataFrame:
        ends = rows.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, on)], ticks(rows, span[0]).alias("start"), ticks(rows, span[1]).alias("end"), _packed(rows).alias("own"))
        order = F.col("start") <= F.col("end") if touching else F.col("start") < F.col("end")
        kept = ends.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], order))
        length = F.greatest((F.col("end") - F.col("start")).cast("double") / unit, F.lit(1.0))
        # one more where rounding of the logarithm might leave the cell shorter than the span
        return kept.withColumn("level", F.ceil(F.log(4.0, length) + 1e-9).cast("int"))

    def known(rows: DataFrame) -> list[int]:
        return sorted(r["level"] for r in rows.select("level").distinct().collect())  # a few dozen at most

    def cells(rows: DataFrame, levels: list[int], own: bool) -> DataFrame:
        """Each span in the cells of its own level, or of all longer ones among `levels`."""
        at = F.array(F.col("level")) if own else F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n > F.col("level"))
        wide = rows.select("*", F.explode(at).alias("at")).withColumn("cell_size", F.pow(F.lit(4.0), F.col("at")) * unit)
        first, last = (F.floor(F.col(c) / F.col("cell_size")) for c in ("start", "end"))
        return wide.select("*", F.explode(F.array_distinct(F.array(first, last))).alias("cell"))

    a, b = spans(left, left_span, [c for c, _ in by]), spans(right, right_span, [c for _, c in by])
    of_a, of_b = known(a), known(b)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        same = reduce(lambda p, q: p & q, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*keys, "at", "cell"]])
        later = F.greatest("x.start", "y.start")
        once = F.floor(later / F.col("x.cell_size")) == F.col("x.cell")
        cross = (F.col("x.start") <= F.col("y.end")) & (F.col("y.start") <= F.col("x.end"))
        if not touching:
            cross = (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
        return x.join(y, same & once & cross).select(F.col("x.own").alias("l"), F.col("y.own").alias("r"))

    # the left span's level counts where it is the longer or as long, else the right one's
    pairs = met(cells(a, of_a, True), cells(b, of_a, True)).unionByName(met(cells(a, of_a, True), cells(b, of_a, False))).unionByName(met(cells(a, of_b, False), cells(b, of_b, True)))
    named = lambda name, rows: F.struct(*_unpacked(name, rows.columns)).alias(name)
    return pairs.select(named("l", left), named("r", right))


def with_sessions(rows: DataFrame, by: Sequence[str], time: str, gap: float, ties: Sequence[str] = (), name: str = "session") -> DataFrame:
    """Adds `name`: the number of each row's session. A session ends where a key's next row is more than `gap` ticks later,
    as in event-time session windows. Rows with a null time get null; a null key is a key."""
    keys = [f"k{i}" for i in range(len(by))]
    packed = rows.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, by)], ticks(rows, time).alias("at"), F.struct(*[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(ties)]).alias("tie") if ties else F.lit(0).alias("tie"), F.monotonically_increasing_id().alias("salt"), _packed(rows).alias("own"))
    order = [*keys, "at", "tie", "salt"]
    placed = in_ranges(packed, [F.col(c) for c in order])
    timed = placed.where("at is not null")
    parts = timed.groupBy("part").agg(F.max(F.struct(*keys, "at")).alias("last"))
    before = Window.orderBy("part").rowsBetween(*_BEFORE)
    carried = F.broadcast(parts.select("part", F.last("last").over(before).alias("carried")))
    within = Window.partitionBy("part").orderBy(*order)
    last = F.coalesce(F.lag(F.struct(*keys, "at")).over(within), F.col("carried"))
    begins = ~_same(keys, [F.col(f"last.{k}") for k in keys]) | F.col("last").isNull() | (F.col("at") - F.col("last.at") > gap)
    marked = timed.join(carried, "part").withColumn("last", last).withColumn("begins", begins.cast("long"))
    counted = marked.withColumn("upto", F.sum("begins").over(within.rowsBetween(*_UP_TO_HERE)))
    offsets = marked.groupBy("part").agg(F.sum("begins").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("offset"))
    numbered = counted.join(F.broadcast(offsets), F.col("part") == F.col("of"))
    known = numbered.select(*_unpacked("own", rows.columns), (F.col("upto") + F.col("offset")).alias(name))
    return known.union(placed.where("at is null").select(*_unpacked("own", rows.columns), F.lit(None).cast("long").alias(name)))


def windowed(rows: DataFrame, by: Sequence[str], order: Sequence[Column], columns: dict[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0) -> DataFrame:
    """Adds window columns over rows of a key in an order: each is made by a function of the window, whose offsets or rows
    frames reach at most `before` rows back and `after` rows ahead (lag, lead, moving sums). A null key is a key; ties in
    the order come in any order. A partition gets the few rows beside it, wherever they are, so a hot key is spread."""
    part, place, halo = (free_name(rows, n) for n in ("part", "place", "halo"))
    whole, parts = in_order(rows, [*[F.col(f"`{k}`") for k in by], *order], part, place)
    ends = F.broadcast(parts.select(F.col("part").alias("of"), F.col("start").alias("of_start"), F.col("rows").alias("of_rows")))
    here = F.col(place) - F.col("of_start")
    tails = whole.join(ends, F.col(part) == F.col("of")).where((here < after) | (here >= F.col("of_rows") - before)).select(F.col(place).alias("at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns], F.col(place).alias(place)).alias("row"), F.lit(None).cast("int").alias("to"))
    marks = lambda at: parts.select(at.alias("at"), F.lit(None).cast(tails.schema["row"].dataType).alias("row"), F.col("part").alias("to"))
    out = whole.withColumn(halo, F.lit(False))
    names = [*rows.columns, place]
    for reach, at, span in ((before, F.col("start"), (-before, -1)), (after, F.col("start") + F.col("rows") - 1, (1, after))):
        if reach:
            # a few rows a partition meet in one task
            near = F.collect_list("row").over(Window.orderBy("at").rangeBetween(*span))
            given = tails.union(marks(at)).withColumn("near", near).where("to is not null").select("to", F.explode("near").alias("row"))
            out = out.unionByName(given.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("to").alias(part), F.lit(True).alias(halo)))
    window = Window.partitionBy(part, *[F.col(f"`{k}`") for k in by]).orderBy(place)
    return out.select("*", *[make(window).alias(name) for name, make in columns.items()]).where(~F.col(halo)).drop(part, place, halo)


def range_windowed(rows: DataFrame, by: Sequence[str], at: str, columns: dict[str, Callable[[WindowSpec], Column]], before: float = 0, after: float = 0) -> DataFrame:
    """Adds window columns over the rows of a key whose time (or number) `at` lies within `before` ticks before a row's and
    `after` after it, its peers included. Rows without `at` get nulls. A partition gets the rows of its first and last key
    that other partitions have within the frame; where a frame holds a large part of a key, so does what is given."""
    part, tick, halo = (free_name(rows, n) for n in ("part", "tick", "halo"))
    timed = rows.withColumn(tick, ticks(rows, at))
    key = [F.col(f"`{k}`") for k in by]
    whole = in_ranges(timed.where(F.col(tick).isNotNull()), [*key, F.col(tick), F.monotonically_increasing_id()], part)
    own = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], F.col(tick).alias("at"))
    bounds = whole.groupBy(F.col(part).alias("p")).agg(F.min(own).alias("first"), F.max(own).alias("last"))
    beside = Window.orderBy("p")
    bounds = bounds.withColumn("next", F.lead("first").over(beside)).withColumn("previous", F.lag("last").over(beside))  # a row a partition
    same = lambda name: _same(key, [F.col(f"{name}.k{i}") for i in range(len(by))])
    near = whole.join(F.broadcast(bounds.select(F.col("p").alias("of"), "next", "previous")), F.col(part) == F.col("of"))
    out = whole.withColumn(halo, F.lit(False))
    names = [*rows.columns, tick]
    t = F.col(tick)
    for reach, beside_it, within, further in ((before, "next", lambda end: t >= F.col(f"{end}.at") - before, F.col("p") > F.col(part)), (after, "previous", lambda end: t <= F.col(f"{end}.at") + after, F.col("p") < F.col(part))):
        # peers of a bound are given even if the frame reaches nowhere
        end = "first" if beside_it == "next" else "last"
        tail = near.where(same(beside_it) & within(beside_it)).drop("of", "next", "previous")
        given = tail.join(F.broadcast(bounds.select("p", end)), further & same(end) & within(end))
        out = out.unionByName(given.select(*[F.col(f"`{c}`") for c in names], F.col("p").alias(part), F.lit(True).alias(halo)))
    window = Window.partitionBy(part, *key).orderBy(tick).rangeBetween(-before, after)
    known = out.select("*", *[make(window).alias(name) for name, make in columns.items()]).where(~F.col(halo)).drop(part, tick, halo)
    rest = timed.where(F.col(tick).isNull()).drop(tick)
    return known.unionByName(rest, allowMissingColumns=True)


def tiled(rows: DataFrame, by: Sequence[str], order: Sequence[Column], tiles: int, name: str = "tile") -> DataFrame:
    """Adds `name`: the rows of a key in an order, in `tiles` runs from 1 that differ by one row at most, longer ones first
    (ntile). A null key is a key."""
    place, first, size = (free_name(rows, n) for n in ("place", "first_place", "key_rows"))
    placed = row_numbers(rows, [*[F.col(f"`{k}`") for k in by], *order], place)
    groups = placed.groupBy(*[F.col(f"`{k}`").alias(f"of{i}") for i, k in enumerate(by)]).agg(F.min(place).alias(first), F.count("*").alias(size))
    both = placed.join(groups, _same([F.col(f"`{k}`") for k in by], [F.col(f"of{i}") for i in range(len(by))]))
    i, short = F.col(place) - F.col(first), F.floor(F.col(size) / tiles)
    long_rows = (F.col(size) % tiles) * (short + 1)
    tile = F.when(i < long_rows, F.floor(i / (short + 1))).otherwise(F.floor((i - long_rows) / F.greatest(short, F.lit(1))) + F.col(size) % tiles) + 1
    return both.withColumn(name, tile.cast("int")).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def group_places(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the place from 1 within the group. Places come from one order of all rows, so that no task holds a
    whole group; what stands before a group is one row a group."""
    overall, before = free_name(rows, "overall"), free_name(rows, "before_group")
    placed = row_numbers(rows, [F.col(group), *order], overall)
    firsts = placed.groupBy(group).agg(F.min(overall).alias(before)).withColumnRenamed(group, free_name(rows, "of"))
    return placed.join(firsts, F.col(group).eqNullSafe(F.col(firsts.columns[0]))).withColumn(name, F.col(overall) - F.col(before) + 1).drop(overall, before, firsts.columns[0])
