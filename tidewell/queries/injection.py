"""Bias injection over customers and orders, and model fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import bias, causal, models
from tidewell.plans.reports import confounding_report, selection_report
from tidewell.queries.base import ORACLE_SQL, long_report, long_sql, query, table
from tidewell.queries.effects import SEED, _uniform, _units

_WEIGHTS = {"bal": 1.0, "n_orders": -0.5}


def _people(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("n_orders"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), (F.col("c_nationkey") % 2).cast("int").alias("t"))
    return c.join(o, "id")


_P = """p AS (SELECT c_custkey AS id, c_acctbal AS bal, CAST(c_nationkey % 2 AS INTEGER) AS t, CAST(n AS DOUBLE) AS n_orders, y FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS y FROM orders GROUP BY 1) ON o_custkey = c_custkey),
mo AS (SELECT avg(bal) AS mb, stddev_pop(bal) AS sb, avg(n_orders) AS mn, stddev_pop(n_orders) AS sn FROM p), z AS (SELECT p.*, (bal - mb) / sb AS bal_scaled, (n_orders - mn) / sn AS n_orders_scaled FROM p, mo)"""
#: The calibrated intercept by bisection in SQL: 60 halvings of [-50, 50].
_CAL = """sc AS (SELECT *, bal_scaled * 1.0 + n_orders_scaled * -0.5 + t * 0.25 AS score FROM z), it AS (
  SELECT 0 AS i, CAST(-50 AS DOUBLE) AS lo, CAST(50 AS DOUBLE) AS hi UNION ALL
  SELECT i + 1, CASE WHEN m < 0.4 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m < 0.4 THEN hi ELSE (lo + hi) / 2 END FROM (SELECT i, lo, hi, (SELECT avg(1 / (1 + exp(-(score + (it.lo + it.hi) / 2)))) FROM sc) AS m FROM it WHERE i < 60)),
al AS (SELECT (lo + hi) / 2 AS a FROM it WHERE i = 60)"""


def _selection(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, float]:
    return bias.selection_pipeline(_people(spark, d), "id", _WEIGHTS, 0.4, "t", 0.25, seed=SEED, tol=1e-13)


def _flag_sql(column: str, binary: bool) -> str:
    checks = {"not_all_missing": f"count({column}) > 0", "not_constant": f"count(DISTINCT {column}) > 1"}
    checks |= {"binary": f"count(*) FILTER ({column} NOT IN (0, 1)) = 0"} if binary else {"numeric": f"count(TRY_CAST({column} AS DOUBLE)) = count({column})"}
    return " UNION ALL ".join(f"SELECT '{name}', '{column}', {test} FROM p" for name, test in checks.items())


@query(f"""WITH {_P}, c(name) AS (SELECT unnest(json_keys(to_json(p))) FROM p LIMIT 1000) SELECT 'present' AS "check", v.name AS "column", v.name IN (SELECT name FROM c) AS ok FROM (VALUES ('bal'), ('absent')) AS v(name)
UNION ALL SELECT 'unique_names', NULL, true UNION ALL SELECT 'not_empty', NULL, count(*) > 0 FROM p UNION ALL {_flag_sql("bal", False)} UNION ALL {_flag_sql("n_orders", True)} UNION ALL {_flag_sql("t", True)}""")
def validate_inputs(spark: SparkSession, d: str) -> DataFrame:
    return bias.validate(_people(spark, d), ["bal", "absent"], ["bal"], ["n_orders", "t"])


@query(f"""WITH {_P}, g AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE bal END AS bal FROM p) SELECT id, coalesce(bal, (SELECT avg(bal) FROM g)) AS bal, (SELECT count(*) FROM g) AS n_before, (SELECT count(*) FROM g) AS n_after, (SELECT count(*) - count(bal) FROM g) AS n_missing FROM g""", "bal")
def missing_policy(spark: SparkSession, d: str) -> DataFrame:
    g = _people(spark, d).select("id", F.expr("case when id % 9 = 0 then null else bal end").alias("bal"))
    rows, counts = bias.apply_missing_policy(g, ["bal"], "mean")
    return rows.crossJoin(F.broadcast(counts))


@query(f"WITH {_P} SELECT id, bal_scaled, n_orders_scaled, CAST(t AS DOUBLE) AS t_scaled, bal_scaled * 2 - n_orders_scaled + t * 0.25 AS score FROM z", "bal_scaled n_orders_scaled t_scaled score")
def standardised_score(spark: SparkSession, d: str) -> DataFrame:
    """z-scores (binary columns skipped), weights from texts, a linear score."""
    rows, _ = bias.standardise(_people(spark, d), ["bal", "n_orders", "t"])
    score = bias.linear_score(bias.parse_weights(["bal=2", "n_orders=-1"]), "t", 0.25)
    return rows.select("id", "bal_scaled", "n_orders_scaled", "t_scaled", score.alias("score"))


@query(f"WITH RECURSIVE {_P}, {_CAL} SELECT round(avg(1 / (1 + exp(-(score + a)))), 6) AS mean_probability, 1 AS n FROM sc, al", "mean_probability")
def calibrated_intercept(spark: SparkSession, d: str) -> DataFrame:
    """The mean selection probability reaches its target."""
    return _selection(spark, d)[0].agg(F.avg("selection_probability").alias("mean_probability")).withColumn("n", F.lit(1))


@query(f"WITH RECURSIVE {_P}, {_CAL} SELECT id, 1 / (1 + exp(-(score + a))) AS selection_probability, CASE WHEN {_uniform('id')} < 1 / (1 + exp(-(score + a))) THEN 1 ELSE 0 END AS selection_indicator FROM sc, al", "selection_probability")
def selection_sample(spark: SparkSession, d: str) -> DataFrame:
    return _selection(spark, d)[0].select("id", "selection_probability", "selection_indicator")


@query(f"""WITH {_P}, l AS (SELECT 'bal' AS "column", bal AS x, t FROM p UNION ALL SELECT 'n_orders', n_orders, t FROM p), g AS (SELECT "column", avg(x) AS m0, avg(x) FILTER (WHERE t = 1) AS m1, var_pop(x) AS v0, var_pop(x) FILTER (WHERE t = 1) AS v1 FROM l GROUP BY 1)
SELECT "column", m0 AS mean_before, m1 AS mean_after, CASE WHEN v0 + v1 > 0 THEN (m1 - m0) / sqrt((v0 + v1) / 2) WHEN m1 = m0 THEN 0.0 END AS smd FROM g""", "mean_before mean_after smd")
def shift_balance(spark: SparkSession, d: str) -> DataFrame:
    p = _people(spark, d)
    return bias.shift_balance(p, p.where("t = 1"), ["bal", "n_orders"])


@query(f"""WITH {_P} SELECT 'bal' AS "column", count(*) AS n_rows, count(*) - count(bal) AS n_missing, false AS is_binary, avg(bal) AS mean, stddev_pop(bal) AS sd, min(bal) AS min, max(bal) AS max FROM p UNION ALL
SELECT 't', count(*), count(*) - count(t), true, avg(t), stddev_pop(t), min(t), max(t) FROM p""", "mean sd min max")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return bias.dataset_summary(_people(spark, d), ["bal", "t"])


_PS = "greatest(0.05, least(0.95, 1 / (1 + exp(-(bal_scaled * 1.0 + n_orders_scaled * -0.5 - 0.2)))))"


def _observed(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = bias.standardise(_people(spark, d), ["bal", "n_orders"], skip_binary=False)
    raw, clipped = bias.artificial_propensity({"bal_scaled": 1.0, "n_orders_scaled": -0.5}, -0.2)
    return bias.assign_treatment(rows.withColumns({"ps_raw": raw, "ps": clipped}), "id", "ps", SEED)


@query(f"WITH {_P} SELECT id, 1 / (1 + exp(-(bal_scaled * 1.0 + n_orders_scaled * -0.5 - 0.2))) AS ps_raw, {_PS} AS ps, CASE WHEN {_uniform('id')} < {_PS} THEN 1 ELSE 0 END AS treat_obs FROM z", "ps_raw ps")
def artificial_treatment(spark: SparkSession, d: str) -> DataFrame:
    return _observed(spark, d).select("id", "ps_raw", "ps", "treat_obs")


@query(f"""WITH {_P}, o AS (SELECT *, CASE WHEN {_uniform('id')} < {_PS} THEN 1 ELSE 0 END AS tr FROM z), l AS (SELECT 'bal' AS "column", bal AS x, tr FROM o UNION ALL SELECT 'n_orders', n_orders, tr FROM o),
g AS (SELECT "column", avg(x) FILTER (WHERE tr = 1) AS a, avg(x) FILTER (WHERE tr = 0) AS b, sqrt((var_samp(x) FILTER (WHERE tr = 1) + var_samp(x) FILTER (WHERE tr = 0)) / 2) AS sd FROM l GROUP BY 1)
SELECT "column", a AS mean_treated, b AS mean_control, CASE WHEN sd = 0 THEN 0.0 ELSE (a - b) / sd END AS smd FROM g""", "mean_treated mean_control smd")
def arm_balance(spark: SparkSession, d: str) -> DataFrame:
    return bias.arm_balance(_observed(spark, d), ["bal", "n_orders"], "treat_obs")


@query(f"WITH {_P} SELECT id, bal, CASE WHEN {_uniform('id')} < {_PS} THEN 1 ELSE 0 END AS t, n_orders, y, t AS t_original FROM z".replace("t AS t_original", "z.t AS t_original"), "bal n_orders")
def harmonised(spark: SparkSession, d: str) -> DataFrame:
    reference = _people(spark, d).select("id", "bal", "t", "n_orders", "y")
    return bias.harmonise(reference, _observed(spark, d), "t", "treat_obs", "t_original")


_CHOSEN = f"ch AS (SELECT *, 1 / (1 + exp(-(score + a))) AS pr, CASE WHEN {_uniform('id')} < 1 / (1 + exp(-(score + a))) THEN 1 ELSE 0 END AS ind FROM sc, al)"


def _summary_sql(rows: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(*) FILTER (WHERE {c} NOT IN (0, 1)) = 0 AS is_binary, avg({c}) AS mean, stddev_pop({c}) AS sd, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM {rows}""" for c in ("bal", "n_orders", "t"))


_SHIFT = " UNION ALL ".join(f"""SELECT '{c}' AS "column", m0 AS mean_before, m1 AS mean_after, CASE WHEN v0 + v1 > 0 THEN (m1 - m0) / sqrt((v0 + v1) / 2) WHEN m1 = m0 THEN 0.0 END AS smd FROM (SELECT avg({c}) AS m0, avg({c}) FILTER (WHERE ind = 1) AS m1, var_pop({c}) AS v0, var_pop({c}) FILTER (WHERE ind = 1) AS v1 FROM ch)""" for c in ("bal", "n_orders", "t"))
_SELECTION = long_sql(
    input=("column", f"WITH {_P} {_summary_sql('p')}"),
    selected=("column", f"WITH RECURSIVE {_P}, {_CAL}, {_CHOSEN} {_summary_sql('(SELECT * FROM ch WHERE ind = 1)')}"),
    selection=(None, f"WITH RECURSIVE {_P}, {_CAL}, {_CHOSEN} SELECT count(*) AS n, sum(ind) AS n_selected, avg(pr) AS mean_probability FROM ch"),
    shift=("column", f"WITH RECURSIVE {_P}, {_CAL}, {_CHOSEN} {_SHIFT}"),
)


@query(_SELECTION, "value")
def selection_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of the selection report, one row each."""
    annotated, selected, _ = _selection(spark, d)
    return long_report(selection_report(_people(spark, d), annotated, selected, ["bal", "n_orders", "t"]))


_CONFOUNDING = long_sql(
    rates=(None, f"WITH {_P}, o AS (SELECT *, {_PS} AS ps, CASE WHEN {_uniform('id')} < {_PS} THEN 1 ELSE 0 END AS tr FROM z) SELECT count(*) AS n, avg(t) AS original_rate, avg(tr) AS new_rate, quantile_cont(ps, 0.05) AS p05, quantile_cont(ps, 0.25) AS p25, quantile_cont(ps, 0.5) AS p50, quantile_cont(ps, 0.75) AS p75, quantile_cont(ps, 0.95) AS p95 FROM o"),
    balance=("column", ORACLE_SQL["arm_balance"]),
)


@query(_CONFOUNDING, "value")
def confounding_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of the confounding report, one row each."""
    return long_report(confounding_report(_observed(spark, d), ["bal", "n_orders"], "t", "treat_obs", "ps"))


@query()
def logistic_auc(spark: SparkSession, d: str) -> DataFrame:
    return models.assignment_strength(_observed(spark, d), ["bal_scaled", "n_orders_scaled"], "treat_obs")


#: The numeric and the categorical features of the five model queries.
_NUMERIC, _CATEGORICAL, _FOLDS, _REPLICATES = ["price", "bal"], ["seg"], 5, 20
#: Fewer and longer steps than models.BOOSTING, whose 400 rounds take minutes a query on one machine (README has figures); the
#: bootstrap's 120 fits have the fewest, and two folds.
_ROUNDS, _BOOTSTRAP = {"maxIter": 30, "stepSize": 0.25}, {"k": 2, "maxIter": 6, "stepSize": 0.5}


@query()
def gbt_propensity(spark: SparkSession, d: str) -> DataFrame:
    """Boosted propensity over numeric and categorical features with missing values, of the test split by a model of the training split."""
    u = causal.split_by_subject(_units(spark, d), "subject", SEED)
    return models.fit_predict(u.where("split = 'train'"), u.where("split = 'test'"), "t", _NUMERIC, _CATEGORICAL, "ps", **_ROUNDS).select("id", "t", "ps")


@query()
def gbt_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold propensity and outcome predictions of every row."""
    return models.cross_fit(_units(spark, d), "id", _NUMERIC, _CATEGORICAL, _FOLDS, SEED, **_ROUNDS).select("id", "fold", "ps", "m1", "m0")


@query()
def gbt_aipw(spark: SparkSession, d: str) -> DataFrame:
    return models.aipw(models.cross_fit(_units(spark, d), "id", _NUMERIC, _CATEGORICAL, _FOLDS, SEED, **_ROUNDS))


@query()
def gbt_aipw_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return models.bootstrap_aipw(_units(spark, d), "id", _NUMERIC, _CATEGORICAL, _REPLICATES, seed=SEED, **_BOOTSTRAP)


@query()
def dr_learner(spark: SparkSession, d: str) -> DataFrame:
    return models.dr_learner(_units(spark, d), "id", _NUMERIC, _CATEGORICAL, _FOLDS, **_ROUNDS)[0].select("id", "ps", "m1", "m0", "phi", "tau")
