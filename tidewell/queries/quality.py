"""Aggregates and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import profiles, ranks
from tidewell.queries.base import query, table
from tidewell.sources import tables as IO


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumns({"price": F.expr("case when o_orderkey % 7 = 0 then null else o_totalprice end"), "prio": F.expr("nullif(o_orderpriority, '5-LOW')")})


_GAPPY = "g AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, nullif(o_orderpriority, '5-LOW') AS prio FROM orders)"


@query("""SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mean, round(sum(o_totalprice), 2) AS total, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS n_large,
count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent, count(DISTINCT o_custkey) AS n_cust FROM orders GROUP BY 1""", "lo hi mean total")
def grouped_aggregates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.avg(p).alias("mean"), F.round(F.sum(p), 2).alias("total"), F.sum(F.when(p > 200000, 1).otherwise(0)).cast("bigint").alias("n_large"),
        F.expr("count(*) filter (where o_orderpriority = '1-URGENT')").alias("n_urgent"), F.count_distinct("o_custkey").alias("n_cust"),
    )


@query("SELECT count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS prevalence, min(o_orderdate) AS first_day FROM orders", "prevalence")
def global_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("prevalence"), F.min("o_orderdate").alias("first_day"))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return profiles.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("""SELECT user_id, avg(CASE WHEN event_type = 'view' THEN value END) AS view, avg(CASE WHEN event_type = 'click' THEN value END) AS click, CAST(NULL AS DOUBLE) AS refund, max(CASE WHEN event_type = 'error' THEN value END) AS worst FROM events GROUP BY 1""", "view click worst")
def pivots(spark: SparkSession, d: str) -> DataFrame:
    """A static pivot (an item that never occurs is a NULL column) and a manual one."""
    e = table(spark, d, "events")
    wide = e.groupBy("user_id").pivot("event_type", ["view", "click", "refund"]).agg(F.avg("value"))
    return wide.join(e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("worst")), "user_id")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def dynamic_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "events").groupBy("user_id").pivot("event_type").agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query("SELECT o_orderstatus, quantile_cont(o_totalprice, 0.1) AS c10, quantile_cont(o_totalprice, 0.5) AS c50, quantile_cont(o_totalprice, 0.9) AS c90, quantile_disc(o_totalprice, 0.25) AS d25 FROM orders GROUP BY 1", "c10 c50 c90 d25")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    per = ranks.quantiles(orders, "o_totalprice", (0.1, 0.5, 0.9, 0.25), ["o_orderstatus"], discrete=[False, False, False, True])
    return per.select("o_orderstatus", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("c10", "c50", "c90", "d25"))])


@query(f"WITH {_GAPPY} SELECT 1 - count(price) / count(*) AS price, 1 - count(prio) / count(*) AS prio, 1 - count(o_orderkey) / count(*) AS o_orderkey FROM g", "price prio o_orderkey")
def null_fractions(spark: SparkSession, d: str) -> DataFrame:
    return profiles.null_fractions(_gappy(spark, d), ["price", "prio", "o_orderkey"])


@query(f"""WITH {_GAPPY} SELECT 'price' AS "column", count(*) - count(price) AS missing_n, (count(*) - count(price)) / count(*) AS missing_frac FROM g UNION ALL SELECT 'prio', count(*) - count(prio), (count(*) - count(prio)) / count(*) FROM g""", "missing_frac")
def missingness_table(spark: SparkSession, d: str) -> DataFrame:
    return profiles.missingness(_gappy(spark, d), ["price", "prio"])


@query(f"""WITH {_GAPPY} SELECT 'price' AS "column", count(*) FILTER (WHERE price < 50000) AS n_below, count(*) FILTER (WHERE price > 400000) AS n_above, count(price) AS n_nonnull FROM g UNION ALL
SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey < 10), count(*) FILTER (WHERE o_custkey > 1000), count(o_custkey) FROM g""")
def out_of_bounds(spark: SparkSession, d: str) -> DataFrame:
    return profiles.out_of_bounds(_gappy(spark, d), {"price": (50000, 400000), "o_custkey": (10, 1000)})


@query(f"""WITH {_GAPPY}, m AS (SELECT 'price' AS "column", price AS x FROM g WHERE price IS NOT NULL UNION ALL SELECT 'o_custkey', o_custkey FROM g)
SELECT "column", count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS max, skewness(x) AS skew, kurtosis(x) AS kurt FROM m GROUP BY 1""", "mean sd min p25 median p75 max skew kurt")
def numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.numeric_profile(_gappy(spark, d), ["price", "o_custkey"])


@query(f"WITH {_GAPPY} SELECT prio AS value, count(*) AS n, count(*) / (SELECT count(*) FROM g) AS share FROM g GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 4", "share")
def categorical_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.categorical_profile(_gappy(spark, d), "prio", 4)


@query(f"WITH {_GAPPY} SELECT prio AS mode FROM g WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1")
def most_frequent_value(spark: SparkSession, d: str) -> DataFrame:
    return profiles.mode(_gappy(spark, d), "prio")


@query("""SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS latest FROM orders""")
def datetime_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiles.datetime_profile(table(spark, d, "orders"), ["o_orderdate"])


@query()
def dataset_card(spark: SparkSession, d: str) -> DataFrame:
    return profiles.dataset_card(_gappy(spark, d))


@query(f"""WITH {_GAPPY} SELECT 'prio' AS "column", 1 - count(prio) / count(*) AS null_frac, count(DISTINCT prio) AS n_unique, string_agg(DISTINCT prio, ',' ORDER BY prio) AS preview FROM g UNION ALL
SELECT 'o_orderkey', 1 - count(o_orderkey) / count(*), count(DISTINCT o_orderkey), NULL FROM g""", "null_frac")
def column_types(spark: SparkSession, d: str) -> DataFrame:
    return profiles.column_types(_gappy(spark, d), ["prio", "o_orderkey"]).drop("type")


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS arm, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY 1", "rate")
def arm_outcome_rates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return profiles.arm_rates(o, "t", "y")


@query("SELECT n_units, count(*) AS n_keys FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n_units FROM orders GROUP BY 1) GROUP BY 1")
def units_per_subject(spark: SparkSession, d: str) -> DataFrame:
    return profiles.units_per_key(table(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("""SELECT 'part' AS of, CAST(l_partkey AS VARCHAR) AS value, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25)
UNION ALL SELECT 'kind', l_returnflag, n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_returnflag LIMIT 3)
UNION ALL SELECT 'day', strftime(day, '%Y-%m-%d'), n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, day LIMIT 10)""")
def heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent values of a flat column of many values, and of two columns of few."""
    found = lambda frame, column, k, name: profiles.heavy_hitters(frame, column, k).select(F.lit(name).alias("of"), F.col("value").cast("string").alias("value"), "n")
    lines, days = table(spark, d, "lineitem"), table(spark, d, "events").select(F.to_date("ts").alias("day"))
    return found(lines, "l_partkey", 25, "part").unionByName(found(lines, "l_returnflag", 3, "kind")).unionByName(found(days, "day", 10, "day"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT user_id) AS n_users, count(DISTINCT event_id) AS n_events, true AS users_within, true AS events_within FROM events GROUP BY 1")
def distinct_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Daily sketches, stored, merged to weeks: whether each estimate lies within four standard errors of the exact number."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = IO.stored(profiles.distinct_sketches(e, ["day"], ["user_id", "event_id"]), "sketches")
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    about = profiles.estimated_distinct(daily.select(week, "user_id", "event_id"), ["week"], ["user_id", "event_id"])
    exact = e.groupBy(week).agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_id").alias("n_events"))
    near = lambda c, n: F.abs(F.col(c) - F.col(n)) <= 4 * 1.04 / 64 * F.col(n)
    return exact.join(about, "week").select("week", "n_users", "n_events", near("user_id", "n_users").alias("users_within"), near("event_id", "n_events").alias("events_within"))
