"""Study design over events, orders, customers, lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalar as S
from tidewell.operators import design, joins, profiles
from tidewell.plans.study import StudySpec, build
from tidewell.queries.base import T0, people, query, table
from tidewell.sources.tables import inline


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")


def _of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return _events(spark, d).where(F.col("event_type") == kind)


def _spine(spark: SparkSession, d: str) -> DataFrame:
    return design.time_zero(people(spark, d), _events(spark, d), "user_id", F.col("event_type") == "error")


@query("""WITH r AS (SELECT o.*, c_acctbal, n_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn2 FROM r WHERE c_acctbal > 0 AND o_totalprice > 100000)
SELECT 'rank_first' AS variant, o_custkey, o_orderkey, n_name FROM r WHERE rn = 1 AND c_acctbal > 0 AND o_totalprice > 100000 UNION ALL SELECT 'eligible_first', o_custkey, o_orderkey, n_name FROM e WHERE rn2 = 1""")
def first_order_cohort(spark: SparkSession, d: str) -> DataFrame:
    """The first stay per subject: ranked before and after the eligibility filter."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # one row a nation
    stays = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    ok = (F.col("c_acctbal") > 0) & (F.col("o_totalprice") > 100000)
    pick = lambda name, first: design.first_stay(stays, "o_custkey", "o_orderdate", "o_orderkey", ok, first).select(F.lit(name).alias("variant"), "o_custkey", "o_orderkey", "n_name")
    return pick("rank_first", False).unionByName(pick("eligible_first", True))


@query("SELECT o_orderkey, CASE WHEN s IS NOT NULL AND s <= o_orderdate + INTERVAL 365 DAY THEN 1 ELSE 0 END AS y FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def outcome_flag(spark: SparkSession, d: str) -> DataFrame:
    """1 if the terminal event is known and not after the end of the stay."""
    first = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"))
    out = table(spark, d, "orders").join(first, "o_orderkey", "left")
    return out.select("o_orderkey", F.when(F.col("s").isNotNull() & (F.col("s") <= S.shift(F.col("o_orderdate"), 24 * 365)), 1).otherwise(0).alias("y"))


@query(f"WITH {T0} SELECT * FROM t0", "t0_value")
def first_event_timezero(spark: SparkSession, d: str) -> DataFrame:
    return _spine(spark, d)


@query("""WITH b AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1), q AS (SELECT e.user_id, e.ts, e.value, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS rn
FROM events e JOIN b ON b.user_id = e.user_id WHERE e.ts >= b.t AND e.ts <= b.t + INTERVAL 48 HOUR AND value BETWEEN 20 AND 60) SELECT user_id, ts AS t0, value AS t0_value FROM q WHERE rn = 1""", "t0_value")
def range_timezero(spark: SparkSession, d: str) -> DataFrame:
    """The first value in a range within 48 hours of entry."""
    e = _events(spark, d)
    cohort = e.groupBy("user_id").agg(F.min("ts").alias("entry"))
    return design.time_zero(cohort, e, "user_id", S.within(F.col("value"), 20, 60), "entry", 48)


@query("""WITH s AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), c AS (SELECT s.user_id, s.t0, count(*) FILTER (WHERE event_type = 'click') AS n_a, count(*) FILTER (WHERE event_type = 'view') AS n_b
FROM s JOIN events e ON e.user_id = s.user_id AND event_type IN ('click', 'view') AND ts >= t0 AND ts <= t0 + INTERVAL 72 HOUR GROUP BY 1, 2)
SELECT *, CASE WHEN n_a > n_b THEN 'click' ELSE 'view' END AS label FROM c WHERE n_a <> n_b""")
def majority_class_timezero(spark: SparkSession, d: str) -> DataFrame:
    return design.majority_time_zero(_events(spark, d), "user_id", ("click", "view"), 72)


@query("""WITH b AS (SELECT user_id, min(ts) AS entry FROM events GROUP BY 1) SELECT b.user_id, min(ts) AS onset, min(ts) + INTERVAL 6 HOUR AS t0, min(ts) + INTERVAL 36 HOUR AS exposure_end
FROM b JOIN events e ON e.user_id = b.user_id AND event_type = 'error' AND ts >= entry AND ts <= entry + INTERVAL 96 HOUR GROUP BY 1""")
def landmark_timezero(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return design.landmark(e.groupBy("user_id").agg(F.min("ts").alias("entry")), _of(spark, d, "error").select("user_id", "ts"), "user_id", "entry", 96, 6, 30)


@query(f"""WITH {T0}, x AS (SELECT t0.user_id, min(ts) AS first_at, count(*) AS n FROM t0 JOIN events e ON e.user_id = t0.user_id AND event_type = 'purchase' AND ts >= t0 AND ts < t0 + INTERVAL 24 HOUR GROUP BY 1)
SELECT user_id, CAST(first_at IS NOT NULL AS INTEGER) AS treated, first_at, date_diff('microsecond', t0, first_at) / 3.6e9 AS hours_to_first, coalesce(n, 0) AS n_events FROM t0 LEFT JOIN x USING (user_id)""", "hours_to_first")
def treatment_window(spark: SparkSession, d: str) -> DataFrame:
    return design.exposure(_spine(spark, d), _of(spark, d, "purchase"), "user_id", 24)


@query(f"""WITH {T0}, x AS (SELECT t0.user_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE regexp_extract(props, '([0-9]+)', 1) END AS DOUBLE) AS a FROM t0 JOIN events e ON e.user_id = t0.user_id AND event_type = 'purchase' AND ts >= t0 AND ts < t0 + INTERVAL 72 HOUR),
g AS (SELECT user_id, sum(coalesce(a, 1.0)) AS v1, CASE WHEN sum(a) > 0 THEN sum(a) ELSE count(*) END AS v2, count(*) FILTER (WHERE a IS NULL) AS n FROM x GROUP BY 1)
SELECT user_id, coalesce(v1, 0.0) AS amount_v1, coalesce(v2, 0.0) AS amount_v2, coalesce(n, 0) AS n_unparsed FROM t0 LEFT JOIN g USING (user_id)""", "amount_v1 amount_v2")
def amount_proxy(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("case when event_id % 5 = 0 then 'n/a' else regexp_extract(props, '([0-9]+)', 1) end")
    return design.amounts(_spine(spark, d), _of(spark, d, "purchase"), "user_id", 72, text)


@query("""WITH x AS (SELECT o_custkey, l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 5.0 END AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE lower(p_name) LIKE '%ring%' AND l_discount > 0.08),
g AS (SELECT o_custkey, sum(q) AS dose, count(*) AS n, count(*) FILTER (WHERE q IS NULL) AS u FROM x GROUP BY 1), f AS (SELECT c_custkey, coalesce(dose, 0.0) AS dose, coalesce(n, 0) AS n_doses, coalesce(u, 0) AS n_unparsed FROM customer LEFT JOIN g ON o_custkey = c_custkey)
SELECT *, CASE WHEN dose >= 160 THEN 1 WHEN dose = 0 THEN 0 END AS treated FROM f""", "dose")
def dose_threshold_treatment(spark: SparkSession, d: str) -> DataFrame:
    """Summed equivalent doses against a threshold: treated, untreated, or between (NULL)."""
    rings = table(spark, d, "part").where(S.any_like(F.col("p_name"), ["%ring%"])).select(F.col("p_partkey").alias("l_partkey"))
    l = table(spark, d, "lineitem").where("l_discount > 0.08").join(rings, "l_partkey")
    j = l.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    mg = F.col("l_quantity") * S.factor_of(F.col("l_returnflag"), {"A": 1, "R": 5})
    doses = j.select(F.col("o_custkey").alias("c_custkey"), mg.alias("mg"), mg.isNull().cast("int").alias("bad"))
    return design.dose_threshold(table(spark, d, "customer"), doses, "c_custkey", "mg", "bad", 160)


@query(f"""WITH {T0}, x AS (SELECT t0.user_id, min(ts) AS first_at FROM t0 JOIN events e ON e.user_id = t0.user_id AND event_type = 'purchase' AND ts >= t0 AND ts <= t0 + INTERVAL 96 HOUR GROUP BY 1)
SELECT user_id, first_at, CASE WHEN first_at < t0 + INTERVAL 12 HOUR THEN 1 WHEN first_at IS NOT NULL THEN 0 END AS early FROM t0 LEFT JOIN x USING (user_id)""")
def early_vs_delayed(spark: SparkSession, d: str) -> DataFrame:
    return design.early_or_delayed(_spine(spark, d), _of(spark, d, "purchase"), "user_id", 12, 96)


@query(f"WITH {T0} SELECT user_id, t0 FROM t0 WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = t0.user_id AND event_type = 'purchase' AND ts < t0 - INTERVAL 10 HOUR)")
def washout_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return design.washed_out(_spine(spark, d), _of(spark, d, "purchase"), "user_id", 10).select("user_id", "t0")


@query(f"WITH {T0} SELECT t0.user_id, count(e.ts) AS n_before FROM t0 LEFT JOIN events e ON e.user_id = t0.user_id AND event_type = 'view' AND ts < t0 GROUP BY 1")
def pre_exposure_count(spark: SparkSession, d: str) -> DataFrame:
    return design.prior_count(_spine(spark, d), _of(spark, d, "view"), "user_id")


@query(f"""WITH {T0}, x AS (SELECT t0.user_id, min(ts) AS outcome_at FROM t0 JOIN events e ON e.user_id = t0.user_id AND event_type = 'purchase' AND ts > t0 AND ts <= t0 + INTERVAL 168 HOUR GROUP BY 1)
SELECT user_id, CAST(outcome_at IS NOT NULL AS INTEGER) AS y, outcome_at, coalesce(CAST(outcome_at <= t0 + INTERVAL 24 HOUR AS INTEGER), 0) AS early_exit FROM t0 LEFT JOIN x USING (user_id)""")
def outcome_horizon(spark: SparkSession, d: str) -> DataFrame:
    return design.outcome_in_horizon(_spine(spark, d), _of(spark, d, "purchase"), "user_id", 168, 24)


@query(f"""WITH {T0} SELECT t0.user_id, CAST(max(CASE WHEN e.event_type IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS y, min(CASE WHEN event_type = 'click' THEN ts END) AS first_a, min(CASE WHEN event_type IN ('view', 'signup') THEN ts END) AS first_b
FROM t0 LEFT JOIN events e ON e.user_id = t0.user_id AND event_type IN ('click', 'view', 'signup') AND ts >= t0 AND ts <= t0 + INTERVAL 48 HOUR GROUP BY 1""")
def outcome_per_class(spark: SparkSession, d: str) -> DataFrame:
    return design.outcome_per_class(_spine(spark, d), _events(spark, d), "user_id", {"a": ["click"], "b": ["view", "signup"]}, 48)


_SHIP = "j AS (SELECT l_orderkey, l_linenumber, o_orderdate AS s, l_shipdate AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _stays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_orderdate").alias("s"), F.col("l_shipdate").alias("e"))


@query(f"WITH {_SHIP}, h AS (SELECT CASE WHEN s > e THEN date_diff('microsecond', e, s) / 3.6e9 END AS late FROM j) SELECT count(*) AS n, count(late) AS n_late, min(late) AS late_min, avg(late) AS late_mean, max(late) AS late_max FROM h", "late_min late_mean late_max")
def time_alignment(spark: SparkSession, d: str) -> DataFrame:
    return design.time_alignment(_stays(spark, d), "s", "e")


@query(f"WITH {_SHIP} SELECT l_orderkey, l_linenumber FROM j WHERE NOT (s > e)")
def clean_times(spark: SparkSession, d: str) -> DataFrame:
    return design.clean_times(_stays(spark, d), "s", "e").select("l_orderkey", "l_linenumber")


_BASE = """j AS (SELECT t0.user_id, e.ts, e.event_id, event_type, value FROM t0 JOIN events e ON e.user_id = t0.user_id AND ts >= t0 - INTERVAL 72 HOUR AND ts <= t0 AND event_type IN ('view', 'click')),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM j),
b AS (SELECT t0.user_id, max(CASE WHEN event_type = 'view' THEN value END) AS last_view, max(CASE WHEN event_type = 'click' THEN value END) AS last_click FROM t0 LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (user_id) GROUP BY 1)"""


@query(f"WITH {T0}, {_BASE} SELECT *, CAST(last_view IS NOT NULL AS INTEGER) AS has_last_view, CAST(last_click IS NOT NULL AS INTEGER) AS has_last_click FROM b", "last_view last_click")
def baseline_covariates(spark: SparkSession, d: str) -> DataFrame:
    return design.baseline(_spine(spark, d), _events(spark, d), "user_id", 72, 0, {"last_view": "view", "last_click": "click"})


@query(f"""WITH {T0}, r AS (SELECT t0.user_id, event_type, value, row_number() OVER (PARTITION BY t0.user_id, event_type ORDER BY ts, event_id) AS rn FROM t0 JOIN events e ON e.user_id = t0.user_id AND ts >= t0 AND ts < t0 + INTERVAL 48 HOUR)
SELECT t0.user_id, max(CASE WHEN rn = 1 AND event_type = 'view' THEN value END) AS view, max(CASE WHEN rn = 1 AND event_type = 'click' THEN value END) AS click, CAST(NULL AS DOUBLE) AS refund, avg(CASE WHEN event_type = 'view' THEN value END) AS mean_view
FROM t0 LEFT JOIN r USING (user_id) GROUP BY 1""", "view click mean_view")
def early_values(spark: SparkSession, d: str) -> DataFrame:
    """First values by static pivot, and mean values, of the first 48 hours."""
    spine, e = _spine(spark, d), _events(spark, d)
    first = design.early_values(spine, e, "user_id", 48, ["view", "click", "refund"])
    mean = design.early_values(spine, e, "user_id", 48, ["view"], "mean").withColumnRenamed("view", "mean_view")
    return first.join(mean, "user_id")


@query(f"""WITH {T0}, w AS (SELECT t0.user_id, ts, event_id, value, ts >= t0 AND ts < t0 + INTERVAL 24 HOUR AS d FROM t0 JOIN events e ON e.user_id = t0.user_id AND event_type = 'view'),
k AS (SELECT user_id, coalesce(arg_min(value, ts) FILTER (WHERE d), arg_min(value, ts)) AS kg FROM w GROUP BY 1), h AS (SELECT user_id, arg_min(value, ts) AS cm FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT t0.user_id, kg, cm, CASE WHEN kg > 0 AND cm > 0 THEN kg / pow(cm / 100.0, 2) END AS bmi FROM t0 LEFT JOIN k USING (user_id) LEFT JOIN h USING (user_id)""", "kg cm bmi")
def anthropometrics(spark: SparkSession, d: str) -> DataFrame:
    return design.anthropometrics(_spine(spark, d), _of(spark, d, "view"), _of(spark, d, "click"), "user_id")


@query("""WITH c AS (SELECT v.name, p_partkey FROM part, (VALUES ('ring', '%ring%'), ('bolt', '%bolt%'), ('red', 'red%')) AS v(name, pattern) WHERE lower(p_name) LIKE pattern),
n AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.02 GROUP BY 1)
SELECT name, p_partkey, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, p_partkey) AS rn FROM c JOIN n ON l_partkey = p_partkey) WHERE rn = 1""")
def canonical_item(spark: SparkSession, d: str) -> DataFrame:
    """Name patterns to candidate items to the one that occurs most."""
    patterns = inline(spark, [("ring", "%ring%"), ("bolt", "%bolt%"), ("red", "red%")], "name string, pattern string")
    found = joins.like_candidates(patterns, table(spark, d, "part"), "pattern", "p_name").select("name", "p_partkey")
    n = table(spark, d, "lineitem").where("l_discount > 0.02").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return design.canonical_items(found, n, "name", "p_partkey")


@query(f"""WITH {T0}, j AS (SELECT t0.user_id, event_type, value FROM t0 JOIN events e ON e.user_id = t0.user_id AND ts >= t0 - INTERVAL 24 HOUR AND ts < t0 + INTERVAL 24 HOUR)
SELECT event_type, count(DISTINCT user_id) / (SELECT count(*) FROM t0) AS coverage, count(*) / count(DISTINCT user_id) AS avg_measures, min(value) AS min_value, max(value) AS max_value FROM j GROUP BY 1""", "coverage avg_measures min_value max_value")
def item_coverage(spark: SparkSession, d: str) -> DataFrame:
    return design.item_coverage(_spine(spark, d), _events(spark, d), "user_id", "event_type", "value", -24, 24)


@query("""WITH g AS (SELECT * FROM (VALUES (10.0), (40.0), (90.0)) AS a(threshold)), s AS (SELECT user_id, threshold, min(ts) AS t0 FROM events, g WHERE event_type = 'view' AND value > threshold GROUP BY ALL),
w AS (SELECT s.user_id, s.threshold, min(CASE WHEN ts >= t0 THEN date_diff('microsecond', t0, ts) / 3.6e9 END) AS wait FROM s LEFT JOIN events e ON e.user_id = s.user_id AND event_type = 'purchase' GROUP BY ALL), h AS (SELECT * FROM (VALUES (6.0), (24.0), (72.0)) AS b(hours))
SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(hours AS DOUBLE) AS hours, count(*) AS eligible, count(*) FILTER (WHERE wait < hours) AS treated, count(*) - count(*) FILTER (WHERE wait < hours) AS control, count(*) FILTER (WHERE wait < hours) / count(*) AS treated_share FROM w, h GROUP BY ALL""", "treated_share")
def design_sweep(spark: SparkSession, d: str) -> DataFrame:
    return design.design_sweep(_of(spark, d, "view").select("user_id", "ts", "value"), _of(spark, d, "purchase"), "user_id", [10, 40, 90], [6, 24, 72])


@query(f"""WITH {T0}, c AS (SELECT * FROM t0 WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = t0.user_id AND event_type = 'purchase' AND ts >= t0 AND ts < t0 + INTERVAL 24 HOUR)), v AS (SELECT * FROM (VALUES ('click'), ('view'), ('refund')) AS x(class))
SELECT v.class, count(DISTINCT e.user_id) AS n_with, (SELECT count(*) FROM c) AS n_controls, count(DISTINCT e.user_id) / (SELECT count(*) FROM c) AS share FROM v LEFT JOIN (SELECT c.user_id, event_type FROM c JOIN events e ON e.user_id = c.user_id AND ts >= t0 AND ts < t0 + INTERVAL 24 HOUR) e ON event_type = class GROUP BY 1""", "share")
def co_interventions(spark: SparkSession, d: str) -> DataFrame:
    spine = _spine(spark, d)
    treated = design.exposure(spine, _of(spark, d, "purchase"), "user_id", 24).where("treated = 1").select("user_id")
    return design.co_interventions(joins.exclude(spine, treated, "user_id"), _events(spark, d), "user_id", ["click", "view", "refund"], 24)


@query("SELECT event_type, CASE WHEN value > 50 THEN 'high' WHEN value > 5 THEN 'mid' ELSE 'low' END AS level, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL", "lo hi")
def item_audit(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("value") > 50, "high").when(F.col("value") > 5, "mid").otherwise("low")
    return table(spark, d, "events").groupBy("event_type", level.alias("level")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(f"""WITH {T0}, x AS (SELECT t0.user_id, 1 AS treated FROM t0 JOIN events e ON e.user_id = t0.user_id AND event_type = 'purchase' AND ts >= t0 AND ts < t0 + INTERVAL 24 HOUR GROUP BY 1)
SELECT count(*) AS n_units, count(t0) AS n_assigned, count(*) - count(t0) AS n_missing FROM (SELECT c_custkey AS user_id FROM customer) LEFT JOIN t0 USING (user_id)""")
def skeleton_check(spark: SparkSession, d: str) -> DataFrame:
    treated = design.exposure(_spine(spark, d), _of(spark, d, "purchase"), "user_id", 24)
    return design.skeleton(people(spark, d), treated, "user_id")[1]


@query(f"""WITH {T0}, {_BASE} SELECT user_id, CASE WHEN last_view IS NOT NULL THEN greatest(5.0, least(60.0, last_view)) END AS last_view, CASE WHEN last_click IS NOT NULL THEN greatest(5.0, least(60.0, last_click)) END AS last_click,
CAST(last_view IS NOT NULL AS INTEGER) AS has_last_view, CAST(last_click IS NOT NULL AS INTEGER) AS has_last_click, c_mktsegment FROM b JOIN customer ON c_custkey = user_id""", "last_view last_click")
def analytic_table(spark: SparkSession, d: str) -> DataFrame:
    base = design.baseline(_spine(spark, d), _events(spark, d), "user_id", 72, 0, {"last_view": "view", "last_click": "click"}).select("user_id", "last_view", "last_click")
    clipped = design.clip_and_flag(base, {"last_view": (5.0, 60.0), "last_click": (5.0, 60.0)})
    return joins.star(clipped, [table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")], "user_id")


@query("""SELECT c_custkey, CAST(coalesce(c_mktsegment = 'BUILDING', false) OR coalesce(c_nationkey = 3, false) AS INTEGER) AS y, c_acctbal FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer)
WHERE NOT coalesce(b > 9000 OR b < 0, false)""", "c_acctbal")
def refined_table(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion that keeps rows with unknown values, a composite outcome and a fixed column order."""
    from tidewell.operators.columns import ordered_subset

    c = table(spark, d, "customer").withColumn("b", F.expr("case when c_custkey % 7 = 0 then null else c_acctbal end"))
    kept = c.where(S.keep_unless((F.col("b") > 9000) | (F.col("b") < 0)))
    y = S.either((F.col("c_mktsegment") == "BUILDING").cast("int"), (F.col("c_nationkey") == 3).cast("int"))
    return ordered_subset(kept.withColumn("y", y), ["c_custkey", "y", "c_acctbal", "absent"])


@query(f"""WITH {T0}, x AS (SELECT t0.user_id, min(ts) AS first_at, count(*) AS n FROM t0 JOIN events e ON e.user_id = t0.user_id AND event_type = 'purchase' AND ts >= t0 AND ts < t0 + INTERVAL 24 HOUR GROUP BY 1),
o AS (SELECT t0.user_id, min(ts) AS outcome_at FROM t0 JOIN events e ON e.user_id = t0.user_id AND event_type = 'purchase' AND ts > t0 AND ts <= t0 + INTERVAL 168 HOUR GROUP BY 1), {_BASE}
SELECT t0.user_id, t0, t0_value, CAST(first_at IS NOT NULL AS INTEGER) AS treated, first_at, date_diff('microsecond', t0, first_at) / 3.6e9 AS hours_to_first, coalesce(n, 0) AS n_events, CAST(outcome_at IS NOT NULL AS INTEGER) AS y, outcome_at,
coalesce(CAST(outcome_at <= t0 + INTERVAL 24 HOUR AS INTEGER), 0) AS early_exit, last_view, last_click, CAST(last_view IS NOT NULL AS INTEGER) AS has_last_view, CAST(last_click IS NOT NULL AS INTEGER) AS has_last_click
FROM t0 LEFT JOIN x USING (user_id) LEFT JOIN o USING (user_id) LEFT JOIN b USING (user_id)""", "t0_value hours_to_first last_view last_click")
def study_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """One spec: time-zero, treatment, outcome and covariates of every unit in one plan."""
    spec = StudySpec(lookback_hours=72, measures={"last_view": "view", "last_click": "click"})
    return build(people(spark, d), _events(spark, d), spec)


@query("SELECT e.event_type AS item, count(*) AS n FROM events e GROUP BY 1 ORDER BY n DESC, item LIMIT 3")
def dominant_items(spark: SparkSession, d: str) -> DataFrame:
    return profiles.categorical_profile(table(spark, d, "events"), "event_type", 3).select(F.col("value").alias("item"), "n")
