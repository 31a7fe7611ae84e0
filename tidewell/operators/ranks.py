"""Exact ranks and quantiles of tables of any size; no task has all rows.

Ranks come from a range-partitioned order and counts per range. Borders of a range partitioning come from a sample, so
the ordered rows are stored before they are counted and used: both then see the same ranges, also after a lost
executor. Quantiles need no order of all values: counts narrow the wanted ranks down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.sources.tables import cut


def numbered(frame: DataFrame, *order: str | Column, rank: str = "__rank", total: str = "__n") -> DataFrame:
    """Adds the global rank from 1 by a full order (nulls first) and the number of rows."""
    ordered = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut(ordered.withColumn("__at", F.monotonically_increasing_id()))  # range number << 33, place in it from 0
    part = F.shiftright("__at", 33).alias("__part")
    counts = stored.groupBy(part).agg(F.count("*").alias("c"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = counts.select("__part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"), F.sum("c").over(Window.partitionBy()).alias(total))
    out = stored.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    place = F.col("__at") - F.shiftleft("__part", 33)
    return out.withColumn(rank, F.col("__before") + place + 1).drop("__at", "__part", "__before")


def running(per: DataFrame, by: Sequence[str], value: str, n: str) -> DataFrame:
    """Adds __below (sum of n over lesser values of the group) and __all (the group's sum); (by, value) must be distinct."""
    stored = cut(per.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = stored.groupBy("__part", *by).agg(F.sum(n).alias("c"))  # a row for each range and group that meet
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *by, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"), F.sum("c").over(Window.partitionBy(*by)).alias("__all"))
    a, b = stored.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0))).alias("a"), offsets.alias("b")
    same = F.col("a.__part") == F.col("b.__part")
    for c in by:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(*[F.col(f"a.`{c}`") for c in per.columns], (F.col("b.__before") + F.col("a.__in")).alias("__below"), F.col("b.__all").alias("__all"))


#: Parts of a doubling in which values are counted first, and parts of such a part in which they are counted next.
COARSE, FINE = 1 << 12, 1 << 20


def _bins(x: Column) -> tuple[Column, Column]:
    """Two whole numbers that grow with x: its place among parts of doublings, and the place inside that part.

    Few values share both, whatever the scale, so counts by them narrow any rank down. Infinities and NaN come last.
    """
    size = F.least((F.log2(F.abs(x)) + 1075) * COARSE, F.lit(1e8)) + 1
    coarse = F.floor(size)
    fine = F.coalesce(F.floor((size - coarse) * FINE), F.lit(0))
    signed = lambda n: F.when(x == 0, 0).when(x < 0, -n - 1).otherwise(n)
    return signed(coarse).cast("bigint"), signed(fine).cast("bigint")


def _at(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left with right's other columns, on equal (also null) values of by."""
    a, b = left.alias("a"), right.alias("b")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return a.join(b, same).select("a.*", *[F.col(f"b.`{c}`") for c in right.columns if c not in by])


def quantiles(
    frame: DataFrame, value: Column | str, points: Sequence[float], by: Sequence[str] = (), weight: Column | None = None, name: str = "q", discrete: bool | Sequence[bool] = False
) -> DataFrame:
    """(by, name): an array of the exact linearly interpolated quantiles of each group's non-null values.

    discrete: the least value that at least this share of the values does not exceed, without interpolation; one flag, or one
    for each point. weight: whole numbers, how often a row counts. Groups without a value have no row; without groups there
    is one row, of nulls where no value is.

    All groups and points at once, by narrowing counts: rows are summed up to distinct values, these are counted by
    coarse bins, those of the few bins that hold a wanted rank by fine bins, and only the values of the fine bins that hold one
    are ordered. Aggregates and joins with what was picked; no sort or task has all values, nothing is stored.
    """
    x = F.col(value) if isinstance(value, str) else value
    flags = [bool(discrete)] * len(points) if isinstance(discrete, bool) else [bool(d) for d in discrete]
    keys = [*by, "__g"]
    rows = frame.select(*by, F.lit(0).alias("__g"), x.cast("double").alias("__x"), (F.lit(1) if weight is None else weight).cast("bigint").alias("__k")).where("__x is not null and __k > 0")
    coarse, fine = _bins(F.col("__x"))
    per = rows.groupBy(*keys, "__x").agg(F.sum("__k").alias("__k")).withColumns({"__b1": coarse, "__b2": fine})
    total = F.col("__all")
    place = [F.greatest(F.ceil(F.lit(float(p)) * total) - 1, F.lit(0)).cast("double") if d else F.lit(float(p)) * (total - 1) for p, d in zip(points, flags, strict=True)]
    wanted = F.array(*[f(i) for i in place for f in (F.floor, F.ceil)])

    def held(parts: DataFrame, within: Sequence[str], order: str, start: Column) -> DataFrame:
        """The bins that hold a wanted rank, with the number of values below."""
        before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        out = parts.withColumn("__below", start + F.coalesce(F.sum("__n").over(before), F.lit(0)))
        return out.where(F.exists(wanted, lambda i: (F.col("__below") <= i) & (i < F.col("__below") + F.col("__n"))))

    first = per.groupBy(*keys, "__b1").agg(F.sum("__k").alias("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    first = held(first, keys, "__b1", F.lit(0)).select(*keys, "__b1", "__all", F.col("__below").alias("__start"))
    second = _at(per, first, [*keys, "__b1"]).groupBy(*keys, "__b1", "__b2", "__all", "__start").agg(F.sum("__k").alias("__n"))
    second = held(second, [*keys, "__b1"], "__b2", F.col("__start")).select(*keys, "__b1", "__b2", "__all", F.col("__below").alias("__start"))
    inside = Window.partitionBy(*keys, "__b1", "__b2").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    last = _at(per, second, [*keys, "__b1", "__b2"]).withColumn("__below", F.col("__start") + F.coalesce(F.sum("__k").over(inside), F.lit(0)))
    here = lambda i: F.max(F.when((F.col("__below") <= i) & (i < F.col("__below") + F.col("__k")), F.col("__x")))
    sides = [here(f(i)).alias(f"{n}{j}") for j, i in enumerate(place) for n, f in (("lo", F.floor), ("hi", F.ceil))]
    found = last.groupBy(*keys).agg(F.max("__all").alias("__all"), *sides)
    between = [F.when(F.col(f"lo{j}") == F.col(f"hi{j}"), F.col(f"lo{j}")).otherwise(F.col(f"lo{j}") + (F.col(f"hi{j}") - F.col(f"lo{j}")) * (i - F.floor(i))) for j, i in enumerate(place)]
    out = found.select(*by, F.array(*between).alias(name))
    return out if by else out.agg(F.coalesce(F.first(name), F.array(*[F.lit(None).cast("double")] * len(points))).alias(name))
