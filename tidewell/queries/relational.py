"""Sources, projections, scalar functions, joins, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalar as S
from tidewell.operators import causal, columns, joins, profiles
from tidewell.operators.design import time_zero
from tidewell.queries.base import T0, people, query, table
from tidewell.sources import tables as IO


def _spine(spark: SparkSession, d: str) -> DataFrame:
    return time_zero(people(spark, d), table(spark, d, "events"), "user_id", F.col("event_type") == "error")


def _of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", "c_acctbal")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parquet to CSV.GZ, and read back with a schema and spread again."""
    out = IO.scratch(spark, "csv") + ".csv.gz"
    IO.convert(spark, f"{d}/customer.parquet", out)
    return IO.read_any(spark, out, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").repartition(4)


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer", "c_acctbal")
def csv_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Two CSV files with different columns, united by name; what one lacks is NULL. Types are inferred."""
    c = table(spark, d, "customer")
    paths = [IO.scratch(spark, "csv"), IO.scratch(spark, "csv")]
    IO.write_csv(c.where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal", "c_mktsegment"), paths[0])
    IO.write_csv(c.where("c_custkey % 2 <> 0").select("c_custkey", "c_acctbal"), paths[1])
    out = IO.read_csv(spark, *paths)
    return out.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus", "total")
def parquet_view(spark: SparkSession, d: str) -> DataFrame:
    """Parquet sink, scan under a view name, SQL over the view."""
    path = IO.scratch(spark, "orders")
    table(spark, d, "orders").write.mode("overwrite").parquet(path)
    IO.register_parquet(spark, "orders_view", path)
    IO.require(spark, ["orders_view"])
    return spark.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_view GROUP BY o_orderstatus")


@query("SELECT CAST(to_json({segment: c_mktsegment, n: count(*), least: min(c_custkey)}) AS VARCHAR) AS json FROM customer GROUP BY c_mktsegment")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("least"))
    return IO.json_rows(per)


@query("SELECT CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS data_type, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def result_log(spark: SparkSession, d: str) -> DataFrame:
    """Two batches appended to one log with a folder per data_type."""
    path = IO.scratch(spark, "log")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("data_type"))
    for part in (0, 1):
        IO.append_log(rows.where(F.col("o_orderkey") % 2 == part), path)
    return spark.read.parquet(path).groupBy("data_type").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def idempotent_log(spark: SparkSession, d: str) -> DataFrame:
    """A batch for each status, all appended a second time, which changes nothing."""
    path, rows = IO.scratch(spark, "log"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for batch in ("F", "O", "P") * 2:
        IO.append_once(rows.where(F.col("o_orderstatus") == batch), path, batch)
    return IO.read_appended(spark, path, rows.schema).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT v.codec, c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal FROM customer, (VALUES ('xz'), ('zip')) AS v(codec)", "c_acctbal")
def packed_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """xz and zip parts, the second half appended, and read back."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    out = None
    for codec in ("xz", "zip"):
        path = IO.scratch(spark, codec)
        IO.write_csv(c.where("c_custkey % 2 = 0"), path, codec)
        IO.write_csv(c.where("c_custkey % 2 = 1"), path, codec, append=True)
        back = IO.read_packed(spark, path, c.schema).withColumn("codec", F.lit(codec))
        out = back if out is None else out.unionByName(back)
    return out


@query("""SELECT v.class, count(*) AS n FROM orders JOIN (VALUES ('1-URGENT', 'fast'), ('2-HIGH', 'fast'), ('5-LOW', 'slow')) AS v(priority, class) ON o_orderpriority = v.priority GROUP BY v.class""")
def inline_dimension(spark: SparkSession, d: str) -> DataFrame:
    dim = IO.inline(spark, [("1-URGENT", "fast"), ("2-HIGH", "fast"), ("5-LOW", "slow")], "o_orderpriority string, class string")
    return table(spark, d, "orders").join(F.broadcast(dim), "o_orderpriority").groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) AS n_without_score, 'no_such_table' AS missing FROM customer")
def input_contract(spark: SparkSession, d: str) -> DataFrame:
    """Required tables are checked by name; an optional column that is absent is a typed NULL."""
    c = table(spark, d, "customer")
    c.createOrReplaceTempView("contract_customer")
    missing = ",".join(IO.missing_inputs(spark, ["contract_customer", "no_such_table"]))
    full = IO.with_optional(c, {"c_score": "double", "c_name": "string"})
    return full.agg(F.count("*").alias("n"), F.count(F.when(F.col("c_score").isNull(), 1)).alias("n_without_score")).withColumn("missing", F.lit(missing))


@query("""WITH o AS (SELECT *, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
SELECT c AS "column", ty AS type, (SELECT count(*) FROM o) AS n_rows, f AS null_frac FROM (
  SELECT 'o_orderkey' AS c, lower(any_value(typeof(o_orderkey))) AS ty, avg(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) AS f FROM o UNION ALL
  SELECT 'o_totalprice', lower(any_value(typeof(o_totalprice))), avg(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END) FROM o UNION ALL SELECT 'p', replace(lower(any_value(typeof(p))), 'varchar', 'string'), avg(CASE WHEN p IS NULL THEN 1 ELSE 0 END) FROM o)""", "null_frac")
def inspect_table(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("p", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return IO.inspect(o.select("o_orderkey", "o_totalprice", "p"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7")
def table_head(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a table, for a look at it."""
    return IO.head(table(spark, d, "orders"), 7, "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 1000 ORDER BY 1, 2 LIMIT 1000")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return IO.distinct_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice > 1000")


@query("SELECT c_nationkey AS site, c_custkey, CAST(8.5 AS DOUBLE) AS t0_threshold, 24 AS window_hours, upper(c_mktsegment) AS segment FROM customer", "t0_threshold")
def stamped_projection(spark: SparkSession, d: str) -> DataFrame:
    """Constants stamped, columns dropped, renamed, replaced, then a fixed order."""
    out = columns.stamp(table(spark, d, "customer"), {"t0_threshold": 8.5, "window_hours": 24})
    out = columns.reshape(out, drop=["c_name", "c_acctbal", "absent"], rename={"c_nationkey": "site"}, replace={"segment": F.upper("c_mktsegment")})
    return columns.ordered_subset(out, ["site", "c_custkey", "t0_threshold", "site", "window_hours", "absent", "segment"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_totalprice >= 100000 AND o_totalprice <= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_totalprice")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(S.within(F.col("o_totalprice"), 100000, 200000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%' THEN 'metal' WHEN lower(p_name) LIKE 'red%' THEN 'red' END AS class
FROM part WHERE (lower(p_type) LIKE '%eco%' OR lower(p_type) LIKE 'pro%' OR lower(p_type) LIKE '%ar%') AND lower(p_name) NOT LIKE '%widget%' AND lower(p_name) NOT LIKE 'green%'""")
def label_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where(S.any_like(F.col("p_type"), ["%eco%", "PRO%", "%ar%"]) & S.none_like(F.col("p_name"), ["%widget%", "green%"]))
    return p.select("p_partkey", S.classify(F.col("p_name"), [(["%ring%", "%bolt%"], "metal"), (["red%"], "red")]).alias("class"))


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, CAST(coalesce(NOT (v > 50), false) AS INTEGER) AS kept_sql, CAST(NOT coalesce(v > 55 OR v < 3, false) AS INTEGER) AS kept_frame,
  CAST(ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' AS INTEGER) AS in_day, CAST(ts > TIMESTAMP '2024-01-01 12:00:00' AND ts <= TIMESTAMP '2024-01-02 06:00:00' AS INTEGER) AS around FROM e""")
def null_predicates(spark: SparkSession, d: str) -> DataFrame:
    """NOT with three-valued logic against the data-frame rule; window bounds open and closed."""
    e = table(spark, d, "events").withColumn("v", F.expr("case when event_id % 7 = 0 then null else value end"))
    day = F.expr("timestamp_ntz '2024-01-02 00:00:00'")
    return e.select(
        "event_id", F.coalesce(~(F.col("v") > 50), F.lit(False)).cast("int").alias("kept_sql"), S.keep_unless((F.col("v") > 55) | (F.col("v") < 3)).cast("int").alias("kept_frame"),
        S.in_window(F.col("ts"), day, 0, 24).cast("int").alias("in_day"), S.in_window(F.col("ts"), day, -12, 6, "(]").cast("int").alias("around"),
    )


@query("""SELECT event_id, try_cast(trim(x) AS DOUBLE) AS whole, coalesce(try_cast(trim(props) AS DOUBLE), try_cast(regexp_extract(props, '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE)) AS found, upper(trim(' ' || event_type || ' ')) AS kind
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN ' ' || CAST(event_id AS VARCHAR) || '.5 ' WHEN 1 THEN CAST(event_id AS VARCHAR) || 'd' WHEN 2 THEN '' ELSE '-' || CAST(event_id AS VARCHAR) END AS x FROM events)""", "whole found")
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("x", F.expr("case event_id % 4 when 0 then ' ' || event_id || '.5 ' when 1 then event_id || 'd' when 2 then '' else '-' || event_id end"))
    return e.select("event_id", S.text_to_double(F.col("x")).alias("whole"), S.number_in_text(F.col("props")).alias("found"), F.upper(F.trim(F.concat(F.lit(" "), "event_type", F.lit(" ")))).alias("kind"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_linenumber % 6 AS u, l_returnflag, l_discount FROM lineitem),
m AS (SELECT *, CASE u WHEN 0 THEN q WHEN 1 THEN q * 0.001 WHEN 2 THEN q * 1000.0 WHEN 3 THEN q WHEN 4 THEN NULL ELSE q END AS mg FROM l)
SELECT l_orderkey, l_linenumber, mg, CAST(mg IS NULL AS INTEGER) AS is_unparsed,
  CASE WHEN l_discount > 0.05 THEN mg * (l_linenumber + 1) ELSE mg END AS daily, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 25.0 END AS factor FROM m""", "mg daily factor")
def dose_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Dose texts in mg, mcg, g, no unit or an unknown one; doses a day; equivalence factors."""
    l = table(spark, d, "lineitem").withColumns({"u": F.col("l_linenumber") % 6})
    unit = F.when(F.col("u") == 0, "mg").when(F.col("u") == 1, " MCG").when(F.col("u") == 2, "g").when(F.col("u") == 4, "drops").when(F.col("u") == 5, "")
    dose = F.concat(F.col("l_quantity").cast("string"), F.lit(" per dose"))
    mg, unparsed = S.dose_in_mg(dose, unit)
    per_day = F.when(F.col("l_discount") > 0.05, F.col("l_linenumber") + 1)
    return l.select("l_orderkey", "l_linenumber", mg.alias("mg"), unparsed.alias("is_unparsed"), S.daily_dose(mg, per_day).alias("daily"), S.factor_of(F.col("l_returnflag"), {"A": 1, "R": 25}).alias("factor"))


@query("""SELECT l_orderkey, l_linenumber, o_orderdate + INTERVAL 36 HOUR AS shifted, date_diff('microsecond', o_orderdate, l_shipdate) / 3.6e9 AS hours,
  CAST(abs(date_diff('day', o_orderdate, l_shipdate)) AS INTEGER) AS days, CAST(CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) AS INTEGER) AS is_after, greatest(o_orderdate, l_shipdate) AS latest,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(greatest(0, least(120, 40 + year(l_shipdate) - 1990)) AS INTEGER) END AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", "hours")
def time_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days, after = S.day_distance(F.col("l_shipdate"), F.col("o_orderdate"))
    age = S.age_at(F.when(F.col("l_linenumber") != 3, 40), F.lit(1990), F.col("l_shipdate"))
    return j.select("l_orderkey", "l_linenumber", S.shift(F.col("o_orderdate"), 36).alias("shifted"), S.hours_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("hours"), days.alias("days"), after.alias("is_after"), F.greatest("o_orderdate", "l_shipdate").alias("latest"), age.alias("age"))


@query("""WITH x AS (SELECT p_partkey, nullif(p_size, 7) AS lb, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 40 END AS inch, p_retailprice AS f FROM part),
y AS (SELECT p_partkey, lb * 0.45359237::DOUBLE AS kg, inch * 2.54::DOUBLE AS cm, (f - 32.0) * 5.0 / 9.0 AS c FROM x)
SELECT p_partkey, kg, cm, c, CASE WHEN kg > 0 AND cm > 0 THEN kg / pow(cm / 100.0, 2) END AS bmi, coalesce(cm, kg, c) AS first_set, CASE WHEN kg IS NOT NULL THEN greatest(2.0, least(15.0, kg)) END AS clipped, CAST(kg IS NOT NULL AS INTEGER) AS has_kg FROM y""", "kg cm c bmi first_set clipped")
def units_and_bounds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kg = S.pounds_to_kg(F.expr("nullif(p_size, 7)"))
    cm = S.inches_to_cm(F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") + 40))
    c = S.fahrenheit_to_celsius(F.col("p_retailprice"))
    x = p.select("p_partkey", kg.alias("kg"), cm.alias("cm"), c.alias("c"))
    kg, cm, c = F.col("kg"), F.col("cm"), F.col("c")
    return x.select("p_partkey", kg, cm, c, S.bmi(kg, cm).alias("bmi"), F.coalesce(cm, kg, c).alias("first_set"), S.clip(kg, 2.0, 15.0).alias("clipped"), S.has(kg).alias("has_kg"))


@query("""SELECT c_custkey, CAST(coalesce(a = 1, false) OR coalesce(b = 1, false) AS INTEGER) AS either, 1 / (1 + exp(-greatest(-2.0, least(2.0, c_acctbal / 1000.0)))) AS sig, sqrt(abs(c_acctbal)) AS root, round(c_acctbal, 1) AS short, c_acctbal / (c_nationkey + 1e-12) AS ratio
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 END AS a, CASE WHEN c_custkey % 5 = 0 THEN 1 END AS b FROM customer) WHERE c_nationkey > 0""", "sig root short ratio")
def flags_and_math(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_nationkey > 0").withColumns({"a": F.expr("case when c_custkey % 3 = 0 then null else c_custkey % 2 end"), "b": F.expr("case when c_custkey % 5 = 0 then 1 end")})
    bal = F.col("c_acctbal")
    return c.select("c_custkey", S.either(F.col("a"), F.col("b")).alias("either"), S.sigmoid(bal / 1000.0, 2.0).alias("sig"), F.sqrt(F.abs(bal)).alias("root"), F.round(bal, 1).alias("short"), (bal / (F.col("c_nationkey") + 1e-12)).alias("ratio"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS row_id FROM customer")
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return causal.row_ids(table(spark, d, "customer").select("c_acctbal", "c_custkey"), "c_acctbal", "c_custkey").select("c_custkey", "row_id")


@query("SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3")
def inner_joins(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "nation").join(table(spark, d, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(sites), F.col("c_nationkey") == F.col("n_nationkey"))  # one row a nation
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "r_name")


@query("SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) b USING (l_orderkey, l_suppkey)")
def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.join(l.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")), ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "n")


_STAR = """SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, max_price, coalesce(n_events, 0) AS n_events, last_ts FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS n_events, max(ts) AS last_ts FROM events GROUP BY 1) e ON user_id = c_custkey"""


def assembled_star(customers: DataFrame, orders: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each customer from facts that carry its key as c_custkey."""
    o = orders.groupBy("c_custkey").agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("max_price"))
    e = events.groupBy("c_custkey").agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))
    return joins.star(customers.select("c_custkey"), [o, e], "c_custkey").select("c_custkey", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_orders", "n_events")], "max_price", "last_ts")


def _star_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice"),
        table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), "ts"),
    )


@query(_STAR, "max_price")
def star_assembly(spark: SparkSession, d: str) -> DataFrame:
    return assembled_star(*_star_inputs(spark, d))


#: Buckets of the catalog tables; a cluster takes so many that a bucket of the largest fits a task.
BUCKETS = 16


def catalog_tables(spark: SparkSession, d: str, namespace: str) -> list[DataFrame]:
    """Customers, orders and events as tables of a namespace, bucketed by the customer, and their scans."""
    names = [f"{namespace}.{n}" for n in ("customers", "orders", "events")]
    for name, frame in zip(names, _star_inputs(spark, d), strict=True):
        IO.save_bucketed(frame, name, "c_custkey", BUCKETS)
    return [IO.scan(spark, name) for name in names]


@query(_STAR, "max_price")
def catalog_star(spark: SparkSession, d: str) -> DataFrame:
    """The star over schema-qualified, bucketed catalog tables: aggregates and joins without a shuffle."""
    where = IO.scratch(spark, "catalog")
    namespace = "study_" + where.rpartition("-")[2]
    spark.sql(f"CREATE NAMESPACE {namespace} LOCATION '{where}'")
    out = IO.cut(assembled_star(*catalog_tables(spark, d, namespace)))
    spark.sql(f"DROP NAMESPACE {namespace} CASCADE")
    return out


@query("""SELECT coalesce(a.k, b.k) AS unit, a.kg, b.cm FROM (SELECT o_custkey AS k, max(o_totalprice) AS kg FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
FULL JOIN (SELECT user_id AS k, max(value) AS cm FROM events GROUP BY 1) b ON a.k = b.k""", "kg cm")
def full_outer_measures(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("unit")).agg(F.max("o_totalprice").alias("kg"))
    b = table(spark, d, "events").groupBy(F.col("user_id").alias("unit")).agg(F.max("value").alias("cm"))
    return joins.full_outer(a, b, "unit")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def exclusion_list(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.exclude(table(spark, d, "customer").select("c_custkey"), out, "c_custkey")


@query(f"""WITH {T0} SELECT user_id, CAST(EXISTS (SELECT 1 FROM events e WHERE e.user_id = t0.user_id AND event_type = 'click' AND ts >= t0 AND ts < t0 + INTERVAL 12 HOUR) AS INTEGER) AS clicked FROM t0""")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    return joins.exists_flag(_spine(spark, d), _of(spark, d, "click"), "user_id", 0, 12, "clicked").select("user_id", "clicked")


@query(f"""WITH {T0} SELECT count(*) AS n, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = t0.user_id AND event_type = 'click' AND ts >= t0 AND ts < t0 + INTERVAL 24 HOUR) THEN 1 ELSE 0 END) AS BIGINT) AS n_click,
CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = t0.user_id AND event_type = 'view' AND ts >= t0 AND ts < t0 + INTERVAL 24 HOUR) THEN 1 ELSE 0 END) AS BIGINT) AS n_view FROM t0""")
def exists_in_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = _spine(spark, d)
    for kind in ("click", "view"):
        out = joins.exists_flag(out, _of(spark, d, kind), "user_id", 0, 24, f"f_{kind}")
    return out.agg(F.count("*").alias("n"), F.sum("f_click").cast("bigint").alias("n_click"), F.sum("f_view").cast("bigint").alias("n_view"))


@query("""SELECT v.name, p_partkey FROM part, (VALUES ('round', '%ring%'), ('flat', '%Plate%'), ('flat', '%widget%')) AS v(name, pattern) WHERE lower(p_name) LIKE lower(pattern) AND lower(p_name) NOT LIKE 'red%'""")
def like_join(spark: SparkSession, d: str) -> DataFrame:
    patterns = IO.inline(spark, [("round", "%ring%"), ("flat", "%Plate%"), ("flat", "%widget%")], "name string, pattern string")
    return joins.like_candidates(patterns, table(spark, d, "part"), "pattern", "p_name", ["red%"]).select("name", "p_partkey")


@query(f"WITH {T0} SELECT t0.user_id, event_id, event_type, value FROM t0 JOIN events e ON e.user_id = t0.user_id AND ts >= t0 - INTERVAL 6 HOUR AND ts < t0 + INTERVAL 24 HOUR", "value")
def window_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return joins.window_join(_spine(spark, d), e, "user_id", -6, 24).select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {T0} SELECT user_id, ts, value, event_type FROM (SELECT t0.user_id, ts, value, event_type, row_number() OVER (PARTITION BY t0.user_id ORDER BY ts DESC, event_id DESC) AS rn
FROM t0 JOIN events e ON e.user_id = t0.user_id AND ts <= t0 + INTERVAL 1 HOUR AND ts > t0 - INTERVAL 72 HOUR AND event_type <> 'error') WHERE rn = 1""", "value")
def asof_last_row(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'error'").select("user_id", "event_id", "ts", "event_type", "value")
    j = joins.window_join(_spine(spark, d), e, "user_id", -72, 1, closed="(]")
    return joins.last_row(j, "user_id", "ts", "event_id", ["ts", "value", "event_type"])


@query(f"""WITH {T0}, j AS (SELECT t0.user_id, e.ts, e.event_id, event_type, CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE value END AS v FROM t0 JOIN events e ON e.user_id = t0.user_id AND ts >= t0 - INTERVAL 96 HOUR AND ts <= t0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM j WHERE v IS NOT NULL)
SELECT j.user_id, max(CASE WHEN r.event_type = 'view' THEN r.v END) AS last_view, max(CASE WHEN r.event_type = 'click' THEN r.v END) AS last_click
FROM (SELECT DISTINCT user_id FROM j) j LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (user_id) GROUP BY 1""", "last_view last_click")
def asof_per_column(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.expr("case when event_id % 7 = 0 then null else value end").alias("v"))
    j = joins.window_join(_spine(spark, d), e, "user_id", -96, 0, closed="[]")
    return joins.last_per_column(j, "user_id", "ts", "event_id", {f"last_{k}": F.when(F.col("event_type") == k, F.col("v")) for k in ("view", "click")})


_ERRORS = "er AS (SELECT e.event_id AS index_id, user_id, ts AS t0 FROM events e JOIN customer ON c_custkey = user_id WHERE event_type = 'error')"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Every error of a user as an index time of its own."""
    return _of(spark, d, "error").join(people(spark, d), "user_id").select(F.col("event_id").alias("index_id"), "user_id", F.col("ts").alias("t0"))


@query(f"""WITH {_ERRORS}, j AS (SELECT index_id, e.ts, e.event_id, event_type, CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE value END AS v FROM er JOIN events e ON e.user_id = er.user_id AND ts >= t0 - INTERVAL 96 HOUR AND ts <= t0 + INTERVAL 2 HOUR),
r AS (SELECT *, row_number() OVER (PARTITION BY index_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM j WHERE v IS NOT NULL)
SELECT er.index_id, user_id, max(CASE WHEN event_type = 'view' THEN v END) AS last_view, max(CASE WHEN event_type = 'click' THEN v END) AS last_click FROM er LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (index_id) GROUP BY ALL""", "last_view last_click")
def asof_carried(spark: SparkSession, d: str) -> DataFrame:
    """The last values before each of a user's errors, by union and carry."""
    v = F.expr("case when event_id % 7 = 0 then null else value end")
    measures = {f"last_{k}": F.when(F.col("event_type") == k, v) for k in ("view", "click")}
    return joins.carry_last(_errors(spark, d), table(spark, d, "events"), "user_id", measures, 96, 2).select("index_id", "user_id", "last_view", "last_click")


@query(f"""WITH {_ERRORS} SELECT index_id, user_id, r.event_type, r.event_id, r.value FROM er LEFT JOIN (SELECT * FROM (SELECT index_id, e.event_type, e.event_id, e.value, row_number() OVER (PARTITION BY index_id ORDER BY ts DESC, e.event_id DESC) AS rn
FROM er JOIN events e ON e.user_id = er.user_id AND ts >= t0 - INTERVAL 72 HOUR AND ts <= t0 WHERE e.event_type <> 'error') WHERE rn = 1) r USING (index_id)""", "value")
def asof_carried_row(spark: SparkSession, d: str) -> DataFrame:
    """The whole last row before each of a user's errors; the stream of a user is cut into weeks."""
    e = table(spark, d, "events").where("event_type <> 'error'")
    out = joins.carry_last(_errors(spark, d), e, "user_id", {"r": F.struct("event_type", "event_id", "value")}, 72, bucket_hours=168)
    return out.select("index_id", "user_id", "r.*")


@query(f"WITH {_ERRORS} SELECT index_id, e.event_id FROM er JOIN events e ON e.user_id = er.user_id AND ts >= t0 - INTERVAL 12 HOUR AND ts < t0 + INTERVAL 36 HOUR")
def window_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every event in the window of each of a user's errors, by time buckets."""
    return joins.window_pairs(_errors(spark, d), table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", -12, 36).select("index_id", "event_id")


@query(f"""WITH {_ERRORS}, i AS (SELECT user_id, ts AS s, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS e, value FROM events WHERE event_type IN ('view', 'click'))
SELECT er.user_id, t0, max(CASE WHEN s <= t0 AND (e IS NULL OR t0 < e) THEN 1 ELSE 0 END) AS active, max(CASE WHEN s <= t0 AND (e IS NULL OR t0 < e) THEN value END) AS max_rate FROM (SELECT DISTINCT user_id, t0 FROM er) er LEFT JOIN i ON i.user_id = er.user_id GROUP BY ALL""", "max_rate")
def active_at_each(spark: SparkSession, d: str) -> DataFrame:
    """Whether an interval covers each of a user's errors; intervals run from an event to the next of its kind, the last one is open."""
    kinds = _of(spark, d, "view").unionByName(_of(spark, d, "click"))
    i = kinds.selectExpr("user_id", "ts as start", "lead(ts) over (partition by user_id, event_type order by ts, event_id) as end", "value")
    return joins.active_within(_errors(spark, d), i, "user_id", "start", "end", "value")


@query("""SELECT DISTINCT w.word, p.p_partkey FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) w JOIN part p ON lower(p.p_name) LIKE '%' || lower(w.word) || '%'""")
def word_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns made of the table's own words, as many as there are, against all its labels."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    patterns = words.withColumn("pattern", F.concat(F.lit("%"), "word", F.lit("%")))
    return joins.like_candidates(patterns, part, "pattern", "p_name").select("word", "p_partkey")


@query(f"""WITH {T0} SELECT user_id, event_type, event_id, abs_days, is_after FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs_days, is_after, ts, event_id) AS rn FROM (
SELECT t0.user_id, e.event_type, e.event_id, ts, CAST(abs(date_diff('day', t0, ts)) AS INTEGER) AS abs_days, CAST(CAST(ts AS DATE) > CAST(t0 AS DATE) AS INTEGER) AS is_after
FROM t0 JOIN events e ON e.user_id = t0.user_id WHERE event_type <> 'error')) WHERE rn = 1""")
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'error'").select("user_id", "event_id", "ts", "event_type")
    return joins.nearest(_spine(spark, d), e, "user_id", "ts", "t0", "event_id", ["event_type"]).select("user_id", "event_type", "event_id", "abs_days", "is_after")


@query(f"""WITH {T0}, i AS (SELECT user_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e, value FROM events WHERE event_type IN ('view', 'click'))
SELECT t0.user_id, max(CASE WHEN s <= t0 AND (e IS NULL OR t0 < e) THEN 1 ELSE 0 END) AS active, max(CASE WHEN s <= t0 AND (e IS NULL OR t0 < e) THEN value END) AS max_rate FROM t0 LEFT JOIN i ON i.user_id = t0.user_id GROUP BY 1""", "max_rate")
def active_at_index(spark: SparkSession, d: str) -> DataFrame:
    """Intervals from an event to the user's next one, of two kinds of events united; the last one is open."""
    both = _of(spark, d, "view").unionByName(_of(spark, d, "click"))
    i = both.selectExpr("user_id", "ts as start", "lead(ts) over (partition by user_id order by ts, event_id) as end", "value")
    return joins.active_at(_spine(spark, d), i, "user_id", "start", "end", "value")


@query(f"""WITH {T0}, a AS (SELECT user_id, max_by(value, ts) AS last_click FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max_by(value, ts) AS last_view FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, last_click, last_view FROM t0 LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)""", "last_click last_view")
def two_streams(spark: SparkSession, d: str) -> DataFrame:
    """Each stream is aggregated before the join, so nothing fans out."""
    last = lambda k: joins.last_per_column(_of(spark, d, k), "user_id", "ts", "event_id", {f"last_{k}": F.col("value")})
    return joins.star(_spine(spark, d).select("user_id"), [last("click"), last("view")], "user_id")


@query("SELECT o_orderstatus, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1", "share")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    per = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return joins.with_total(per, o.agg(F.count("*").alias("total"))).select("o_orderstatus", (F.col("n") / F.col("total")).alias("share"))


@query("SELECT o_orderkey, o_totalprice, o_totalprice / 1000 AS score FROM orders WHERE o_orderstatus = 'F'", "o_totalprice score")
def aligned_scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return joins.aligned(o.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("score")), rows, "o_orderkey")


@query("""WITH a AS (SELECT avg(CASE WHEN nullif(o_orderpriority, '5-LOW') IS NULL THEN 1.0 ELSE 0 END) AS f FROM orders), b AS (SELECT avg(CASE WHEN nullif(o_orderpriority, '5-LOW') IS NULL THEN 1.0 ELSE 0 END) AS f FROM orders WHERE o_orderstatus = 'F')
SELECT 'p' AS "column", round(a.f, 6) AS missing_frac_a, round(b.f, 6) AS missing_frac_b, round(b.f, 6) - round(a.f, 6) AS difference FROM a, b""", "missing_frac_a missing_frac_b difference")
def profile_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("p", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return joins.compare_profiles(profiles.missingness(o, ["p"]), profiles.missingness(o.where("o_orderstatus = 'F'"), ["p"]), "missing_frac")


@query("SELECT o_custkey, o_orderkey AS first_order, last_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last_order FROM orders) WHERE rn = 1")
def first_and_last_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    first = profiles.first_row(o, "o_custkey", F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = profiles.first_row(o, "o_custkey", F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 30")
def most_frequent_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(30)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20", "c_acctbal")
def largest_by_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return profiles.top_by_abs(table(spark, d, "customer"), "c_acctbal", 20, "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT 'least' AS which, c_custkey FROM (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1) UNION ALL SELECT 'largest', c_custkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1)")
def best_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    pick = lambda name, largest: profiles.best_row(c, "c_acctbal", "c_custkey", largest).select(F.lit(name).alias("which"), "c_custkey")
    return pick("least", False).unionByName(pick("largest", True))


@query("""SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM (SELECT * FROM events WHERE event_type = 'view' UNION ALL SELECT * FROM events WHERE event_type = 'click')""")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _of(spark, d, "view").unionByName(_of(spark, d, "click")).select("user_id", F.to_date("ts").alias("day")).distinct()


@query("""SELECT o_custkey AS k, 'missing' AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_custkey, 'extra' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return profiles.differing_ids(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")
