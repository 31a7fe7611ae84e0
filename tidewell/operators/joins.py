"""Joins of a spine (one row per unit) with facts: window, as-of, nearest, active-at, star.

Facts are joined on the equi key with the time range as part of the join condition, so Spark shuffles
each side once by that key and AQE can split a hot one. Ties on time go to the given tiebreak column.

Where a unit has many index times or all events, carry_last (a running frame over the union of both sides) and
interval_join (an equi-join on key and time bucket) take the place of these joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import any_like, day_distance, hours_between, in_window, none_like, shift
from tidewell.sources.tables import cut


def left_with_defaults(spine: DataFrame, feature: DataFrame, key: str | Sequence[str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left join that keeps every unit, then defaults for its NULLs."""
    out = spine.join(feature, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def star(spine: DataFrame, features: Sequence[DataFrame], key: str) -> DataFrame:
    """Left joins of per-unit tables, all partitioned by the unit key."""
    return reduce(lambda out, feature: out.join(feature, key, "left"), features, spine)


def full_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Either side's units once, key coalesced."""
    return left.join(right, key, "full_outer")


def exclude(frame: DataFrame, excluded: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return frame.join(excluded, key, "left_anti")


def window_join(spine: DataFrame, events: DataFrame, key: str, low_hours: float, high_hours: float, ts: str = "ts", t0: str = "t0", closed: str = "[)", how: str = "inner") -> DataFrame:
    """Every event of the unit inside its window. Columns of both sides; events must not repeat spine names but the key."""
    right = events.withColumnRenamed(key, "__key")
    on = (F.col(key) == F.col("__key")) & in_window(F.col(ts), F.col(t0), low_hours, high_hours, closed)
    return spine.join(right, on, how).drop("__key")


def exists_flag(spine: DataFrame, events: DataFrame, key: str, low_hours: float, high_hours: float, name: str, closed: str = "[)") -> DataFrame:
    """The spine with a 0/1 column: has the unit an event in its window."""
    found = window_join(spine.select(key, "t0"), events.select(key, "ts"), key, low_hours, high_hours, closed=closed).select(key).distinct().withColumn(name, F.lit(1))
    return left_with_defaults(spine, found, key, {name: 0})


def last_row(joined: DataFrame, key: str | Sequence[str], ts: str, tiebreak: str, columns: Sequence[str]) -> DataFrame:
    """The whole latest row per key, as one aggregate with map-side combine."""
    keys = [key] if isinstance(key, str) else list(key)
    row = F.max_by(F.struct(*columns), F.struct(ts, tiebreak))
    return joined.groupBy(*keys).agg(row.alias("__row")).select(*keys, "__row.*")


def last_per_column(joined: DataFrame, key: str, ts: str, tiebreak: str, measures: Mapping[str, Column]) -> DataFrame:
    """The last non-NULL value of each measure on its own."""
    order = F.struct(ts, tiebreak)
    return joined.groupBy(key).agg(*[F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), order)).alias(n) for n, c in measures.items()])


def carry_last(
    spine: DataFrame, events: DataFrame, key: str, measures: Mapping[str, Column], lookback_hours: float, grace_hours: float = 0.0,
    ts: str = "ts", t0: str = "t0", tiebreak: str = "event_id", bucket_hours: float | None = None,
) -> DataFrame:
    """The spine with the last non-NULL value of each measure in [t0 - lookback, t0 + grace]: as-of by union and carry.

    Spine rows and events of a unit stand in one stream by time; a running frame carries each measure's last value along,
    so a unit may have any number of index times, where a join would meet each with each event. One shuffle, no
    join. A measure that is a struct is carried as a whole row. With bucket_hours the stream of a unit is cut into buckets of
    time, each headed by what the earlier ones carry, so that a unit with very many events is spread over tasks.
    NULL keys and index times meet no event; events without key or time are not used.
    """
    names = list(measures)
    held = {f"__m{i}": F.when(m.isNotNull(), F.struct(F.col(ts).alias("at"), m.alias("v"))) for i, m in enumerate(measures.values())}
    carried = list(held)
    happened = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("__key"), F.col(ts).alias("__at"), F.lit(0).alias("__side"), F.col(tiebreak).alias("__tie"), *[c.alias(n) for n, c in held.items()])
    index = spine.select(F.col(key).alias("__key"), shift(F.col(t0), grace_hours).alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in spine.columns]).alias("__row"))
    stream = happened.unionByName(index, allowMissingColumns=True)
    by = ["__key"]
    if bucket_hours:
        by = ["__key", "__bucket"]
        stream = stream.withColumn("__bucket", F.floor(_epoch_hours(F.col("__at"), dict(stream.dtypes)["__at"]) / F.lit(float(bucket_hours))))
        order = F.struct("__at", "__tie")
        last = stream.groupBy(*by).agg(F.min("__at").alias("__at"), *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in carried])
        before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        heads = last.select(*by, "__at", F.lit(-1).alias("__side"), *[F.last(c, ignorenulls=True).over(before).alias(c) for c in carried])
        stream = stream.unionByName(heads, allowMissingColumns=True)
    running = Window.partitionBy(*by).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = stream.select("__row", *[F.last(c, ignorenulls=True).over(running).alias(c) for c in carried]).where("__row is not null").select("__row.*", *carried)
    live = lambda c: F.when(F.col(f"{c}.at") >= shift(F.col(t0), -lookback_hours), F.col(f"{c}.v"))
    return out.select(*[F.col(f"`{c}`") for c in spine.columns], *[live(c).alias(n) for n, c in zip(names, carried, strict=True)])


def _epoch_hours(at: Column, kind: str) -> Column:
    """Hours since 1970 of a column of that timestamp type."""
    return hours_between(at, F.lit("1970-01-01 00:00:00").cast(kind))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, closed: str = "[)", base_hours: float = 1.0) -> DataFrame:
    """Every point beside each interval of its unit that covers it; a NULL end is open.

    Time is cut into buckets, of base_hours and its powers of two: an interval lies in one or two buckets of the size that
    is next to its own length, and a point looks once into each size that occurs. So the join is on (key, size, bucket): a
    unit with all events is spread over tasks, and the exact test comes after. Columns of both sides, which must
    not share names but the key. NULL keys, points and starts meet nothing.
    """
    kind = dict(points.dtypes)[at]
    hours = lambda x: _epoch_hours(x.cast(kind), kind)
    bucket = lambda x, size: F.floor(x / (F.lit(float(base_hours)) * F.pow(F.lit(2.0), size)))
    last_point = points.agg(F.max(at).alias("__bound"))  # one row: no point lies behind it
    timed = intervals.withColumnRenamed(key, "__key").where(F.col(start).isNotNull()).crossJoin(F.broadcast(last_point))
    stop = F.greatest(F.coalesce(F.least(F.col(end).cast(kind), F.col("__bound")), F.col(start).cast(kind)), F.col(start).cast(kind))
    timed = timed.withColumns({"__first": hours(F.col(start)), "__last": hours(stop)})
    timed = timed.withColumn("__level", F.ceil(F.log2(F.greatest((F.col("__last") - F.col("__first")) / base_hours, F.lit(1.0)))).cast("int"))
    sizes = sorted(r[0] for r in timed.select("__level").distinct().collect())  # a few powers of two
    whole = F.sequence(bucket(F.col("__first"), F.col("__level")), bucket(F.col("__last"), F.col("__level")))
    right = timed.withColumn("__bucket", F.explode(whole)).drop("__first", "__last", "__bound")
    left = points.withColumn("__size", F.explode(F.array(*[F.lit(x) for x in sizes]).cast("array<int>"))).withColumn("__here", bucket(hours(F.col(at)), F.col("__size")))
    same = (F.col(key) == F.col("__key")) & (F.col("__size") == F.col("__level")) & (F.col("__here") == F.col("__bucket"))
    after = F.col(at) >= F.col(start) if closed[0] == "[" else F.col(at) > F.col(start)
    before = F.col(at) <= F.col(end) if closed[1] == "]" else F.col(at) < F.col(end)
    return left.join(right, same & after & (before | F.col(end).isNull())).drop("__size", "__here", "__key", "__level", "__bucket")


def window_pairs(spine: DataFrame, events: DataFrame, key: str, low_hours: float, high_hours: float, ts: str = "ts", t0: str = "t0", closed: str = "[)") -> DataFrame:
    """window_join by time buckets: for units with very many events and index times."""
    windows = spine.withColumns({"__start": shift(F.col(t0), low_hours), "__end": shift(F.col(t0), high_hours)})
    return interval_join(events, windows, key, ts, "__start", "__end", closed).drop("__start", "__end")


def active_within(spine: DataFrame, intervals: DataFrame, key: str, start: str, end: str, rate: str | None = None) -> DataFrame:
    """active_at for any number of index times of a unit, by time buckets: (key, t0, active[, max_rate]) of each distinct pair."""
    index = spine.select(key, "t0").distinct()
    covered = interval_join(index, intervals.select(key, start, end, *([rate] if rate else [])), key, "t0", start, end)
    found = covered.groupBy(key, "t0").agg(F.lit(1).alias("active"), *([F.max(rate).alias("max_rate")] if rate else []))
    return left_with_defaults(index, found, [key, "t0"], {"active": 0})


def nearest(spine: DataFrame, events: DataFrame, key: str, date: str, target: str, tiebreak: str, group: Sequence[str] = ()) -> DataFrame:
    """Per unit (and group) the event nearest in days; of equally near ones the earlier side, then the tiebreak."""
    joined = spine.join(events, key)
    days, after = day_distance(F.col(date), F.col(target))
    ranked = joined.withColumns({"abs_days": days, "is_after": after})
    order = Window.partitionBy(key, *group).orderBy("abs_days", "is_after", date, tiebreak)
    return ranked.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def active_at(spine: DataFrame, intervals: DataFrame, key: str, start: str, end: str, rate: str | None = None) -> DataFrame:
    """Per unit: active (0/1) if an interval covers t0, start inclusive, end exclusive, NULL end open; and the largest rate of those."""
    joined = spine.select(key, "t0").join(intervals, key, "left")
    live = (F.col(start) <= F.col("t0")) & (F.col(end).isNull() | (F.col("t0") < F.col(end)))
    found = [F.max(F.when(live, 1).otherwise(0)).alias("active")]
    if rate:
        found.append(F.max(F.when(live, F.col(rate))).alias("max_rate"))
    return joined.groupBy(key).agg(*found)


def _grams(text: Column, size: int | Column) -> Column:
    """All substrings of that length, one where the length is 0."""
    last = F.length(text) - F.lit(size) + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.when(F.lit(size) == 0, 1).otherwise(last)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


#: Longest piece of a pattern that is looked up.
GRAM = 3
#: Patterns that are sent to all tasks.
FEW_PATTERNS = 20_000


def like_candidates(patterns: DataFrame, labels: DataFrame, pattern: str, label: str, without: Sequence[str] = ()) -> DataFrame:
    """(patterns x labels) pairs with lower(label) LIKE lower(pattern), for any number of either.

    A matching label holds each literal piece of the pattern, and so each of its trigrams. A pattern is posted under the
    trigram that fewest labels have (a shorter piece where it has no trigram, the empty one where it is all wildcards), labels
    are looked up by the substrings of the lengths that occur, and LIKE decides the pairs that meet. Few patterns are sent to all
    tasks, so that labels stay where they are: dealt out by substring, a frequent one's labels would be one task's.
    """
    kept = labels.where(none_like(F.col(label), without)) if without else labels
    # an escaped character ends a piece, like a wildcard
    pieces = F.split(F.regexp_replace(F.lower(F.col(pattern)), r"\\[\s\S]|[%_]+", "\u0000"), "\u0000")
    listed = patterns.where(F.col(pattern).isNotNull()).withColumn("__pieces", pieces)
    size = F.least(F.array_max(F.transform("__pieces", lambda x: F.length(x))), F.lit(GRAM))
    listed = cut(listed.withColumn("__size", size))
    sent = F.broadcast if listed.count() <= FEW_PATTERNS else lambda frame: frame
    long = F.array_distinct(F.flatten(F.transform("__pieces", lambda x: _grams(x, F.col("__size")))))
    sizes = sorted(r[0] for r in listed.select("__size").distinct().collect())  # 0 to GRAM
    own = F.array_distinct(F.flatten(F.array(*[_grams(F.lower(F.col(label)), n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    looked_up = kept.where(F.col(label).isNotNull()).withColumn("__gram", F.explode(own))
    wanted = listed.select(pattern, F.explode(long).alias("__gram")).distinct()
    met = looked_up.join(sent(wanted.select("__gram").distinct()), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = wanted.join(met, "__gram", "left").groupBy(pattern).agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__post"))
    posted = listed.join(rarest.withColumnRenamed(pattern, "__pattern"), F.col(pattern) == F.col("__pattern")).drop("__pieces", "__size", "__pattern")
    pairs = looked_up.join(sent(posted), (F.col("__gram") == F.col("__post")) & F.expr(f"lower(`{label}`) like lower(`{pattern}`)"))
    return pairs.drop("__gram", "__post")


def with_total(frame: DataFrame, total: DataFrame) -> DataFrame:
    """A one-row table beside every row."""
    return frame.crossJoin(F.broadcast(total.limit(1)))


def aligned(scored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Scores joined to rows by id; an error unless each row has exactly one score."""
    out = rows.join(scored, key)
    want, got = rows.count(), out.count()
    if want != got:
        raise ValueError(f"{got} scored rows for {want} rows")
    return out


def compare_profiles(left: DataFrame, right: DataFrame, value: str, key: str = "column") -> DataFrame:
    """Two column profiles side by side with right - left."""
    a, b = left.select(key, F.col(value).alias(f"{value}_a")), right.select(key, F.col(value).alias(f"{value}_b"))
    return a.join(b, key).withColumn("difference", F.col(f"{value}_b") - F.col(f"{value}_a"))


__all__ = [
    "active_at", "active_within", "aligned", "any_like", "carry_last", "compare_profiles", "exclude", "exists_flag", "full_outer", "interval_join", "last_per_column", "last_row",
    "left_with_defaults", "like_candidates", "nearest", "star", "window_join", "window_pairs", "with_total",
]
