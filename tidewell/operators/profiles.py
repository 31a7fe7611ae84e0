"""Aggregates that describe tables: missingness, bounds, duplicates, numeric and categorical profiles.

Each report reads its table once: one aggregate over all columns, then an unpivot of the one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.operators.ranks import quantiles
from tidewell.sources.tables import cut


def _unpivot(one: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    each = F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows])
    return one.select(F.explode(each).alias("r")).select("r.*")


def duplicate_keys(frame: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one row and their number."""
    return frame.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def null_fractions(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: 1 - count(c) / count(*) of each column."""
    return frame.agg(*[(1 - F.try_divide(F.count(c), F.count("*"))).alias(c) for c in columns])


def missingness(frame: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """(column, missing_n, missing_frac) of each column."""
    one = frame.agg(F.count("*").alias("__n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"__m_{c}") for c in columns])
    return _unpivot(one, [{"column": F.lit(c), "missing_n": F.col(f"__m_{c}"), "missing_frac": F.round(F.try_divide(F.col(f"__m_{c}"), F.col("__n")), digits)} for c in columns])


def out_of_bounds(frame: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(column, n_below, n_above, n_nonnull) against hard bounds."""
    aggs = []
    for c, (low, high) in bounds.items():
        aggs += [F.count(F.when(F.col(c) < low, 1)).alias(f"{c}_b"), F.count(F.when(F.col(c) > high, 1)).alias(f"{c}_a"), F.count(c).alias(f"{c}_n")]
    return _unpivot(frame.agg(*aggs), [{"column": F.lit(c), "n_below": F.col(f"{c}_b"), "n_above": F.col(f"{c}_a"), "n_nonnull": F.col(f"{c}_n")} for c in bounds])


def numeric_profile(frame: DataFrame, columns: Sequence[str], ddof: int = 1) -> DataFrame:
    """(column, n, mean, sd, min, p25, median, p75, max, skew, kurt); skew and kurtosis are bias-corrected, quantiles exact."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts = {"n": F.count(x), "mean": F.avg(x), "sd": F.stddev_samp(x) if ddof else F.stddev_pop(x), "min": F.min(x), "max": F.max(x), "g1": F.skewness(x), "g2": F.kurtosis(x)}
        aggs += [v.alias(f"{k}_{i}") for k, v in parts.items()]
        n, at = F.col(f"n_{i}").cast("double"), lambda k, i=i: F.col(f"{k}_{i}")
        skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * at("g1"))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * at("g2") + 6))
        rows.append({"column": F.lit(c), "n": at("n"), "mean": at("mean"), "sd": at("sd"), "min": at("min"), "p25": F.get(at("q"), F.lit(0)), "median": F.get(at("q"), F.lit(1)), "p75": F.get(at("q"), F.lit(2)), "max": at("max"), "skew": skew, "kurt": kurt})
    # all columns' quantiles at once, by column number
    long = frame.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("i", "x"))
    at = quantiles(long, "x", (0.25, 0.5, 0.75), ["i"]).agg(F.map_from_entries(F.collect_list(F.struct("i", "q"))).alias("__q"))
    one = frame.agg(*aggs).crossJoin(F.broadcast(at)).withColumns({f"q_{i}": F.try_element_at("__q", F.lit(i)) for i in range(len(columns))})
    return _unpivot(one, rows)


def categorical_profile(frame: DataFrame, column: str, top_k: int = 10) -> DataFrame:
    """(value, n, share) of the most frequent values, ties by value; NULL is a value."""
    counts = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = frame.agg(F.count("*").alias("total"))
    top = counts.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(top_k)
    return top.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


#: Values whose counts a task keeps for heavy_hitters, and candidates that are counted exactly.
KEPT_VALUES, MOST_CANDIDATES = 4096, 10_000


def _summaries(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's frequent values: (listed, value, n), n at most what is taken off below a value's own count; and one row (not listed) with what was taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        taken_off = 0
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            found = pc.value_counts(batch.column(0))
            for value, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                held[value] = held.get(value, 0) + n
            if len(held) > 2 * capacity:  # all give up as much as the first that does not fit has
                least = heapq.nlargest(capacity + 1, held.values())[-1]
                held = {v: n - least for v, n in held.items() if n > least}
                taken_off += least
        if kind is not None:
            listed = pa.array([True] * len(held) + [False])
            yield pa.RecordBatch.from_arrays([listed, pa.array([*held, None], kind), pa.array([*held.values(), taken_off], pa.int64())], names=["listed", "value", "n"])

    return run


def heavy_hitters(frame: DataFrame, column: str, k: int, capacity: int = KEPT_VALUES) -> DataFrame:
    """(value, n) of the k most frequent values, ties by value; NULL is a value. Exact.

    Tasks keep the counts of their frequent values only, so that no table of all values is shuffled. Added up, a count is
    too low by at most e, the sum of what tasks took off. Values whose count plus e reaches the k-th largest count are
    candidates, which a second pass counts exactly. Where e reaches that count, as on flat data, or candidates are too
    many, all values are counted.
    """
    rows = frame.select(F.col(column).alias("value"))
    order = (F.col("n").desc(), F.col("value").asc_nulls_last())
    sums = cut(rows.mapInArrow(_summaries(capacity), T.StructType([T.StructField("listed", T.BooleanType()), T.StructField("value", rows.schema["value"].dataType), T.StructField("n", T.LongType())])).groupBy("listed", "value").agg(F.sum("n").alias("n")))
    error = sums.where("not listed").agg(F.sum("n")).first()[0] or 0
    best = [r["n"] for r in sums.where("listed").orderBy(F.col("n").desc()).limit(k).collect()]
    if best and len(best) == k and error < best[-1] or not error:
        candidates = sums.where("listed").where(F.col("n") + error >= (best[-1] if len(best) == k else 0)).select(F.col("value").alias("__value"))
        if candidates.count() <= MOST_CANDIDATES:
            rows = rows.join(F.broadcast(candidates), F.col("value").eqNullSafe(F.col("__value")), "left_semi")
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(*order).limit(k)


def mode(frame: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent non-NULL value, the least of equally frequent ones."""
    return frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(1).select(F.col(column).alias("mode"))


def datetime_profile(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, earliest, latest) as text."""
    one = frame.agg(*[f(c).cast("string").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    return _unpivot(one, [{"column": F.lit(c), "earliest": F.col(f"lo_{c}"), "latest": F.col(f"hi_{c}")} for c in columns])


def column_types(frame: DataFrame, columns: Sequence[str], most: int = 10) -> DataFrame:
    """(column, type, null_frac, n_unique, preview): all values as sorted text where there are at most `most`."""
    kinds = dict(frame.dtypes)
    counts = frame.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("k", F.count), ("u", F.count_distinct))]).first()
    few = [c for c in columns if counts[f"u_{c}"] <= most]
    texts = frame.agg(F.lit(0).alias("_"), *[F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in few])
    share = lambda c: (1 - counts[f"k_{c}"] / counts["n"]) if counts["n"] else None
    return _unpivot(texts, [{"column": F.lit(c), "type": F.lit(kinds[c]), "null_frac": F.lit(share(c)).cast("double"), "n_unique": F.lit(counts[f"u_{c}"]).cast("bigint"), "preview": F.col(c) if c in few else F.lit(None).cast("string")} for c in columns])


def column_role(frame: DataFrame) -> dict[str, str]:
    """numeric, datetime, boolean or categorical, by type."""
    role = {"boolean": "boolean", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime", "string": "categorical"}
    return {c: role.get(t, "numeric" if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else "categorical") for c, t in frame.dtypes}


def dataset_card(frame: DataFrame, top_k: int = 5) -> DataFrame:
    """(column, role, stats): a JSON profile of every column by its role."""
    roles = column_role(frame)
    of = lambda *kinds: [c for c, r in roles.items() if r in kinds]
    parts = []
    if names := of("numeric"):
        parts.append(numeric_profile(frame, names).select("column", F.lit("numeric").alias("role"), F.to_json(F.struct("n", "mean", "sd", "min", "median", "max")).alias("stats")))
    if names := of("datetime"):
        parts.append(datetime_profile(frame, names).select("column", F.lit("datetime").alias("role"), F.to_json(F.struct("earliest", "latest")).alias("stats")))
    for c in of("categorical", "boolean"):
        top = categorical_profile(frame.select(F.col(c).cast("string").alias(c)), c, top_k)
        rows = top.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n"))), lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n")))).alias("stats"))
        parts.append(rows.select(F.lit(c).alias("column"), F.lit(roles[c]).alias("role"), "stats"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_sketches(frame: DataFrame, by: Sequence[str], columns: Sequence[str], lg_k: int = 12) -> DataFrame:
    """(by, columns): a HyperLogLog sketch of each column's distinct non-NULL values, 2^lg_k registers. To be stored, and merged by estimated_distinct."""
    return frame.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c), F.lit(lg_k)).alias(c) for c in columns])


def estimated_distinct(sketches: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, columns): estimated numbers of distinct values of coarser groups, from stored sketches of finer ones; no row of the table is read again.

    The standard error is about 1.04 / sqrt(2^lg_k) of the number: 1.6 % for lg_k 12.
    """
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def arm_rates(frame: DataFrame, t: str, y: str) -> DataFrame:
    """(arm, n, rate): the naive outcome rate by treatment."""
    return frame.groupBy(F.col(t).alias("arm")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))


def units_per_key(frame: DataFrame, key: str, unit: str) -> DataFrame:
    """(n_units, n_keys): how many keys have that many distinct units."""
    return frame.groupBy(key).agg(F.count_distinct(unit).alias("n_units")).groupBy("n_units").agg(F.count("*").alias("n_keys"))


def first_row(frame: DataFrame, key: str | Sequence[str], *order: Column) -> DataFrame:
    """The first row per key by a full order."""
    keys = [key] if isinstance(key, str) else list(key)
    return frame.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_by_abs(frame: DataFrame, column: str, k: int, tiebreak: str) -> DataFrame:
    return frame.orderBy(F.abs(column).desc_nulls_last(), tiebreak).limit(k)


def best_row(frame: DataFrame, column: str, tiebreak: str, largest: bool = False) -> DataFrame:
    """The row with the least (or largest) value."""
    by = F.col(column).desc_nulls_last() if largest else F.col(column).asc_nulls_last()
    return frame.orderBy(by, tiebreak).limit(1)


def differing_ids(expected: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one table has."""
    missing = expected.select(key).distinct().join(received.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    extra = received.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)
