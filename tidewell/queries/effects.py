"""Causal estimation and policy over orders: t = urgent priority, y = finished, strata = market segment and nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.uniform import POISSON_STEPS
from tidewell.operators import causal, policy
from tidewell.plans.reports import baseline_report, policy_report
from tidewell.plans.study import config
from tidewell.queries.base import ORACLE_SQL, long_report, long_sql, query, table

#: Replicates: of weighted effects, of policy values and curves, of the comparison, of the policy report.
B, B_POLICY, B_COMPARISON, B_REPORT, SEED = 20, 50, 100, 200, 42


def _units(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("c_acctbal")).alias("bal"),
    )


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return causal.stratum_scores(_units(spark, d), ["seg", "nat"])


_UNITS = """u AS (SELECT o_orderkey AS id, o_custkey AS subject, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
c_mktsegment AS seg, c_nationkey AS nat, o_totalprice AS price, CASE WHEN o_orderkey % 7 <> 0 THEN c_acctbal END AS bal FROM orders JOIN customer ON c_custkey = o_custkey)"""
_S = f"""{_UNITS}, st AS (SELECT seg, nat, avg(t) AS ps, avg(y) FILTER (WHERE t = 1) AS a1, avg(y) FILTER (WHERE t = 0) AS a0 FROM u GROUP BY ALL), al AS (SELECT avg(y) FILTER (WHERE t = 1) AS g1, avg(y) FILTER (WHERE t = 0) AS g0, avg(t) AS pt FROM u),
s AS (SELECT u.*, ps, coalesce(a1, g1) AS m1, coalesce(a0, g0) AS m0, coalesce(a1, g1) - coalesce(a0, g0) AS tau, greatest(0.01, least(0.99, ps)) AS e, pt FROM u JOIN st USING (seg, nat), al)"""
_UNIFORM = "CAST('0x' || substr(md5('{seed}:' || {keys}), 1, 8) AS BIGINT) / 4294967296.0"
_W = "w AS (SELECT *, CASE WHEN t = 1 THEN pt / e ELSE (1 - pt) / (1 - e) END AS w FROM s)"


def _uniform(*keys: str) -> str:
    return _UNIFORM.format(seed=SEED, keys=" || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys))


#: Replicates with their Poisson multiplicity k.
def _reps(n: int) -> str:
    return f"""rp AS (SELECT *, {" + ".join(f"CASE WHEN uu >= {p!r} THEN 1 ELSE 0 END" for p in POISSON_STEPS)} AS k FROM (SELECT s.*, rep, {_uniform("id", "rep")} AS uu FROM s, range(1, {n + 1}) AS r(rep))), r AS (SELECT * FROM rp WHERE k > 0)"""


def _score(pi: str) -> str:
    return f"(({pi}) * m1 + (1 - ({pi})) * m0 + CASE WHEN t = ({pi}) THEN 1.0 ELSE 0.0 END / (t * e + (1 - t) * (1 - e) + 1e-12) * (y - (t * m1 + (1 - t) * m0)))"


def _ate(w: str, y: str = "y") -> str:
    return f"(sum(CASE WHEN t = 1 THEN {w} * {y} END) / (sum(CASE WHEN t = 1 THEN {w} END) + 1e-12) - sum(CASE WHEN t = 0 THEN {w} * {y} END) / (sum(CASE WHEN t = 0 THEN {w} END) + 1e-12))"


@query(f"""WITH {_UNITS}, c AS (SELECT v.name, v.kind, v.parsed FROM (SELECT avg(CASE WHEN TRY_CAST(seg AS DOUBLE) IS NULL THEN 0 ELSE 1 END) AS seg, avg(CASE WHEN TRY_CAST(CAST(price AS VARCHAR) AS DOUBLE) IS NULL THEN 0 ELSE 1 END) AS price_text FROM u),
LATERAL (VALUES ('id', 'number', 1.0), ('subject', 'number', 1.0), ('t', 'number', 1.0), ('y', 'number', 1.0), ('seg', 'text', seg), ('nat', 'number', 1.0), ('price', 'number', 1.0), ('bal', 'number', 1.0), ('text_number', 'text', price_text), ('day', 'time', 0.0), ('o_orderkey', 'number', 1.0)) AS v(name, kind, parsed))
SELECT name AS "column", CASE WHEN name IN ('id', 'subject', 't', 'y') OR kind = 'time' OR regexp_matches(name, '_id|id_|uuid|key') THEN 'dropped' WHEN kind = 'text' AND parsed < 0.95 THEN 'categorical' ELSE 'numeric' END AS role FROM c""")
def feature_roles(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d).withColumns({"text_number": F.col("price").cast("string"), "day": F.current_date(), "o_orderkey": F.col("id")})
    return causal.feature_roles(u, ["id", "subject", "t", "y"])


@query(f"""WITH {_UNITS}, q AS (SELECT subject, row_number() OVER (ORDER BY {_uniform("subject")}, subject) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM u))
SELECT u.id, CASE WHEN rk <= round(n * 0.7) THEN 'train' WHEN rk <= round(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM u JOIN q USING (subject)""")
def subject_split(spark: SparkSession, d: str) -> DataFrame:
    return causal.split_by_subject(_units(spark, d), "subject", SEED).select("id", "split")


@query(f"WITH {_UNITS} SELECT id, CAST((row_number() OVER (ORDER BY {_uniform('id')}, id) - 1) % 5 AS INTEGER) AS fold FROM u")
def k_folds(spark: SparkSession, d: str) -> DataFrame:
    return causal.k_folds(_units(spark, d), "id", 5, SEED).select("id", "fold")


@query(f"WITH {_S} SELECT id, t, y, ps, m1, m0, tau, e AS ps_clipped FROM s", "ps m1 m0 tau ps_clipped")
def stratum_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id", "t", "y", "ps", "m1", "m0", "tau", causal.clip_ps(F.col("ps")).alias("ps_clipped"))


@query(f"""WITH {_UNITS} SELECT id, CASE WHEN seg = 'BUILDING' THEN 1 ELSE 0 END AS "seg=BUILDING", CASE WHEN seg = 'MACHINERY' THEN 1 ELSE 0 END AS "seg=MACHINERY" FROM u""")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return causal.one_hot(_units(spark, d), "seg", ["AUTOMOBILE", "BUILDING", "MACHINERY"], drop_first=True).select("id", "`seg=BUILDING`", "`seg=MACHINERY`")


@query(f"""WITH {_S}, q AS (SELECT list_distinct(quantile_cont(tau, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM s), i AS (SELECT list_sort(e)[2 : len(e) - 1] AS e FROM q)
SELECT id, CAST(len(list_filter(i.e, lambda x: x < tau)) AS INTEGER) AS bin FROM s, i""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    return causal.quantile_bins(_scored(spark, d), "tau", 10).select("id", "bin")


@query(f"""WITH {_S}, {_W}, q AS (SELECT quantile_cont(w, 0.05) AS lo, quantile_cont(w, 0.95) AS hi FROM w), x AS (SELECT w.*, greatest(lo, least(hi, w)) AS wt, CASE WHEN t = 1 THEN 1 - e ELSE e END AS o FROM w, q)
SELECT avg(w) AS mean_w, max(wt) AS max_trimmed, pow(sum(wt), 2) / (sum(wt * wt) + 1e-12) AS ess, {_ate("wt")} AS ate_iptw, {_ate("o")} AS ate_ato, sum(wt * price) / (sum(wt) + 1e-12) AS mean_price FROM x""", "mean_w max_trimmed ess ate_iptw ate_ato mean_price")
def weighted_effects(spark: SparkSession, d: str) -> DataFrame:
    """Stabilised and overlap weights, trimming, effective sample size, weighted means and effects."""
    s = _scored(spark, d).withColumn("e", causal.clip_ps(F.col("ps")))
    w = causal.iptw(s, F.col("e")).withColumn("wt", F.col("w"))
    x = causal.trim_to_quantiles(w, "wt", 0.05, 0.95)
    t, y, wt = F.col("t"), F.col("y"), F.col("wt")
    return x.agg(F.avg("w").alias("mean_w"), F.max("wt").alias("max_trimmed"), causal.ess(wt).alias("ess"), causal.ate(y, t, wt).alias("ate_iptw"), causal.ate(y, t, causal.overlap_weight(F.col("e"), t)).alias("ate_ato"), causal.weighted_mean(F.col("price"), wt).alias("mean_price"))


_TRIMMED = "w0 AS (SELECT *, CASE WHEN t = 1 THEN pt / e ELSE (1 - pt) / (1 - e) END AS w9 FROM s), wq AS (SELECT quantile_cont(w9, 0.05) AS lo, quantile_cont(w9, 0.95) AS hi FROM w0), w AS (SELECT w0.*, greatest(lo, least(hi, w9)) AS w FROM w0, wq)"
_SMD = f"""WITH {_S}, {_W}, l AS (SELECT 'price' AS feature, t, w, price AS x FROM w UNION ALL SELECT 'bal', t, w, bal FROM w WHERE bal IS NOT NULL UNION ALL SELECT 'nat', t, w, nat FROM w),
c AS (SELECT feature, avg(x) AS c FROM l GROUP BY 1), g AS (SELECT feature, t, avg(x - c) AS m, var_pop(x - c) AS v, sum(w * (x - c)) / (sum(w) + 1e-12) AS wm FROM l JOIN c USING (feature) GROUP BY ALL),
h AS (SELECT l.feature, l.t, sum(w * pow(x - c - wm, 2)) / (sum(w) + 1e-12) AS wv FROM l JOIN c USING (feature) JOIN g ON g.feature = l.feature AND g.t = l.t GROUP BY ALL),
z AS (SELECT a.feature, (a.m - b.m) / sqrt(0.5 * (a.v + b.v) + 1e-12) AS smd_pre, (a.wm - b.wm) / sqrt(0.5 * (ha.wv + hb.wv) + 1e-12) AS smd_post FROM g a JOIN g b ON a.feature = b.feature AND a.t = 1 AND b.t = 0 JOIN h ha ON ha.feature = a.feature AND ha.t = 1 JOIN h hb ON hb.feature = a.feature AND hb.t = 0)"""


def _smd(spark: SparkSession, d: str) -> DataFrame:
    w = causal.iptw(_scored(spark, d), causal.clip_ps(F.col("ps")))
    return causal.smd_table(w, ["price", "bal", "nat"], w="w")


@query(f"{_SMD} SELECT * FROM z", "smd_pre smd_post")
def smd_table(spark: SparkSession, d: str) -> DataFrame:
    return _smd(spark, d)


@query(f"{_SMD} SELECT count(smd_post) AS n_features, max(abs(smd_post)) AS max_abs_smd, avg(CASE WHEN abs(smd_post) > 0.1 THEN 1 ELSE 0 END) AS frac_gt_01, avg(CASE WHEN abs(smd_post) > 0.2 THEN 1 ELSE 0 END) AS frac_gt_02, string_agg(feature, ',' ORDER BY abs(smd_post) DESC, feature) AS top FROM z", "max_abs_smd frac_gt_01 frac_gt_02")
def balance_summary(spark: SparkSession, d: str) -> DataFrame:
    return causal.balance_summary(_smd(spark, d))


@query(f"""WITH {_S}, a AS (SELECT 'all' AS arm, ps FROM s UNION ALL SELECT CASE WHEN t = 1 THEN 'treated' ELSE 'control' END, ps FROM s),
g AS (SELECT arm, count(*) AS n, quantile_cont(ps, 0.01) AS p01, quantile_cont(ps, 0.05) AS p05, quantile_cont(ps, 0.5) AS p50, quantile_cont(ps, 0.95) AS p95, quantile_cont(ps, 0.99) AS p99, avg(CASE WHEN ps < 0.01 THEN 1 ELSE 0 END) AS frac_below, avg(CASE WHEN ps > 0.99 THEN 1 ELSE 0 END) AS frac_above FROM a GROUP BY 1)
SELECT *, (SELECT p05 FROM g WHERE arm = 'treated') > 0.8 AND (SELECT p95 FROM g WHERE arm = 'control') < 0.2 AS possible_separation FROM g""", "p01 p05 p50 p95 p99 frac_below frac_above")
def ps_overlap(spark: SparkSession, d: str) -> DataFrame:
    return causal.ps_overlap(_scored(spark, d))


@query(f"WITH {_S}, {_W} SELECT count(*) AS n, pow(sum(w), 2) / (sum(w * w) + 1e-12) AS ess, pow(sum(w), 2) / (sum(w * w) + 1e-12) / count(*) AS ess_ratio, quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.9) AS p90, quantile_cont(w, 0.95) AS p95, quantile_cont(w, 0.99) AS p99, min(w) AS min, avg(w) AS mean, stddev_pop(w) AS sd, max(w) AS max FROM w", "ess ess_ratio p50 p90 p95 p99 min mean sd max")
def weights_summary(spark: SparkSession, d: str) -> DataFrame:
    return causal.weights_summary(causal.iptw(_scored(spark, d), causal.clip_ps(F.col("ps"))))


@query(f"""WITH {_S}, g AS (SELECT round(price / 1000) AS sc, sum(t) AS p, count(*) AS n FROM s GROUP BY 1), k AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM g)
SELECT (sum(p * rk) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))) AS auc FROM k""", "auc")
def auc_exact(spark: SparkSession, d: str) -> DataFrame:
    return causal.auc(_scored(spark, d).withColumn("sc", F.round(F.col("price") / 1000)), "sc", "t")


_PHI = f"WITH {_S}, p AS (SELECT *, m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) AS phi FROM s)"


def _phi(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.withColumn("phi", causal.pseudo_outcome(F.col("y"), F.col("t"), causal.clip_ps(F.col("ps")), F.col("m1"), F.col("m0")))


@query(f"{_PHI} SELECT id, phi FROM p", "phi")
def dr_pseudo_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _phi(spark, d).select("id", "phi")


@query(f"{_PHI} SELECT count(*) AS n, avg(CASE WHEN ps < 0.01 OR ps > 0.99 THEN 1 ELSE 0 END) AS clip_share, avg(phi) AS mean, stddev_samp(phi) AS sd, quantile_cont(phi, 0.01) AS p01, quantile_cont(phi, 0.5) AS p50, quantile_cont(phi, 0.99) AS p99 FROM p", "clip_share mean sd p01 p50 p99")
def aipw_stratum(spark: SparkSession, d: str) -> DataFrame:
    """AIPW effect (mean) and the pseudo-outcome's diagnostics."""
    return causal.phi_summary(_phi(spark, d))


@query(f"""WITH {_S}, q AS (SELECT list_sort(list_distinct(quantile_cont(tau, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM s), b AS (SELECT s.*, CASE WHEN t = 1 THEN 1 - e ELSE e END AS o, len(list_filter(q.e[2 : len(q.e) - 1], lambda x: x < tau)) AS bin FROM s, q)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, CAST(sum(t) AS BIGINT) AS n_treated, CAST(sum(1 - t) AS BIGINT) AS n_control, avg(tau) AS tau_mean, quantile_cont(tau, 0.1) AS tau_p10, quantile_cont(tau, 0.5) AS tau_p50, quantile_cont(tau, 0.9) AS tau_p90,
avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0) AS diff_unweighted, CASE WHEN sum(t) > 0 AND sum(1 - t) > 0 THEN {_ate("o")} END AS ate_ato, CASE WHEN sum(t) > 0 AND sum(1 - t) > 0 THEN pow(sum(o), 2) / (sum(o * o) + 1e-12) END AS ess_ato FROM b GROUP BY bin""".replace("s.*, CASE WHEN t = 1 THEN 1 - e ELSE e END", "s.*, CASE WHEN t = 1 THEN 1 - s.e ELSE s.e END"), "tau_mean tau_p10 tau_p50 tau_p90 diff_unweighted ate_ato ess_ato")
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    return causal.calibration_table(_scored(spark, d), 5)


@query(f"""WITH {_S}, p AS (SELECT *, m1 - m0 + t * (y - m1) / (e + 1e-12) - (1 - t) * (y - m0) / (1 - e + 1e-12) AS dr, t * y / (e + 1e-12) - (1 - t) * y / (1 - e + 1e-12) AS ipw FROM s),
g AS (SELECT avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0) AS naive_ate, avg(ipw) AS ipw_ate, avg(dr) AS dr_ate, stddev_samp(dr) / sqrt(count(*)) AS dr_ate_se, avg(tau) AS mean_tau, stddev_samp(tau) AS sd_tau, avg(CASE WHEN tau < 0 THEN 1 ELSE 0 END) AS frac_benefit, quantile_cont(tau, 0.05) AS p05_tau, quantile_cont(tau, 0.95) AS p95_tau FROM p)
SELECT *, sd_tau / (abs(dr_ate) + 1e-9) AS het_snr, naive_ate - dr_ate AS bias_reduction FROM g""", "naive_ate ipw_ate dr_ate dr_ate_se mean_tau sd_tau frac_benefit p05_tau p95_tau het_snr bias_reduction")
def cate_vs_ate(spark: SparkSession, d: str) -> DataFrame:
    return causal.cate_vs_ate(_scored(spark, d))


_BOOT = f"""WITH {_S}, {_reps(B)}, p AS (SELECT rep, sum(k * t) / sum(k) AS pr FROM r GROUP BY 1), w AS (SELECT r.*, CASE WHEN t = 1 THEN pr / e ELSE (1 - pr) / (1 - e) END AS w, CASE WHEN t = 1 THEN 1 - e ELSE e END AS o FROM r JOIN p USING (rep)),
m AS (SELECT w.rep, w.w FROM w, range(1, 13) AS c(i) WHERE i <= k), q AS (SELECT rep, quantile_cont(w, 0.05) AS lo, quantile_cont(w, 0.95) AS hi FROM m GROUP BY 1), x AS (SELECT w.*, greatest(lo, least(hi, w)) AS wt FROM w JOIN q USING (rep)),
f AS (SELECT rep, {_ate("k * wt")} AS iptw, {_ate("k * o")} AS ato FROM x GROUP BY rep)"""


@query(f"{_BOOT} SELECT CAST(rep AS INTEGER) AS rep, iptw, ato FROM f", "iptw ato")
def bootstrap_effects(spark: SparkSession, d: str) -> DataFrame:
    return causal.bootstrap_effects(_scored(spark, d), "id", B, SEED, (0.05, 0.95))


@query(f"{_BOOT} SELECT count(iptw) AS n_boot, avg(iptw) AS mean, stddev_samp(iptw) AS sd, quantile_cont(iptw, 0.025) AS ci_lo, quantile_cont(iptw, 0.975) AS ci_hi FROM f", "mean sd ci_lo ci_hi")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return causal.interval(causal.bootstrap_effects(_scored(spark, d), "id", B, SEED, (0.05, 0.95)), "iptw")


@query(f"""WITH {_S.replace(chr(10) + "s AS (", chr(10) + "s9 AS (")}, s AS (SELECT id, round(tau, 12) AS tau FROM s9) SELECT id, CASE WHEN tau < 0 THEN 1 ELSE 0 END AS lt0, CASE WHEN tau > 0 THEN 1 ELSE 0 END AS gt0, CASE WHEN tau <= (SELECT quantile_cont(tau, 0.2) FROM s) THEN 1 ELSE 0 END AS top, CASE WHEN tau >= 0.05 THEN 1 ELSE 0 END AS ge,
CASE WHEN row_number() OVER (ORDER BY tau, id) <= ceil((SELECT count(*) FROM s) * 0.15) THEN 1 ELSE 0 END AS ranked FROM s""")
def policies(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("id", F.round("tau", 12).alias("tau"))
    out = policy.policy_from_tau(s, "tau_lt_0", name="lt0")
    out = policy.policy_from_tau(out, "tau_gt_0", name="gt0")
    out = policy.policy_from_tau(out, "top_frac_benefit", 0.2, name="top").withColumn("ge", policy.decide(F.col("tau"), 0.05, "tau_ge_thr"))
    return policy.top_fraction(out, "id", 0.15, "ranked").select("id", "lt0", "gt0", "top", "ge", "ranked")


@query(f"""WITH {_S}, p AS (SELECT *, CASE WHEN tau < 0 THEN 1 ELSE 0 END AS pi FROM s), w AS (SELECT *, CASE WHEN t = pi THEN 1.0 / (t * e + (1 - t) * (1 - e) + 1e-12) END AS ipw FROM p), q AS (SELECT quantile_cont(ipw, 0.05) AS lo, quantile_cont(ipw, 0.95) AS hi FROM w)
SELECT avg({_score("pi")}) AS value, avg(pi * m1 + (1 - pi) * m0 + coalesce(greatest(lo, least(hi, ipw)), 0) * (y - (t * m1 + (1 - t) * m0))) AS trimmed FROM w, q""", "value trimmed")
def policy_value(spark: SparkSession, d: str) -> DataFrame:
    p = policy.policy_from_tau(_scored(spark, d))
    return policy.dr_value(p).crossJoin(F.broadcast(policy.dr_value(p, trim=(0.05, 0.95)).withColumnRenamed("value", "trimmed")))


def _paired(n: int, pi: str = "CASE WHEN tau < 0 THEN 1 ELSE 0 END") -> str:
    return f"""WITH {_S}, {_reps(n)}, v AS (SELECT rep, sum(k * {_score(pi)}) / sum(k) AS value, sum(k * {_score("0")}) / sum(k) AS v0, sum(k * {_score("1")}) / sum(k) AS v1 FROM r GROUP BY rep),
d AS (SELECT rep, value, v0 AS none, v1 AS every, value - v0 AS delta_none, value - v1 AS delta_all FROM v)"""


def _summary(*quantities: str) -> str:
    return f"""l AS ({" UNION ALL ".join(f"SELECT '{q}' AS quantity, {q} AS x FROM d" for q in quantities)})
SELECT quantity, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.025) AS ci_lo, quantile_cont(x, 0.975) AS ci_hi, avg(CASE WHEN x < 0 THEN 1 ELSE 0 END) AS p_negative FROM l GROUP BY 1"""


@query(f"""{_paired(B_POLICY)}, {_summary("value", "delta_none", "delta_all")}""", "mean sd ci_lo ci_hi p_negative")
def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    return policy.paired_summary(policy.bootstrap_values(policy.policy_from_tau(_scored(spark, d)), "id", B_POLICY, seed=SEED))


@query(f"{_paired(B_POLICY)} SELECT CAST(rep AS INTEGER) AS rep, value, delta_none, delta_all FROM d", "value delta_none delta_all")
def bootstrap_policy(spark: SparkSession, d: str) -> DataFrame:
    return policy.bootstrap_values(policy.policy_from_tau(_scored(spark, d)), "id", B_POLICY, seed=SEED).drop("none", "every")


_GRID = [round(-0.3 + 0.9 * i / 19, 4) for i in range(20)]
_FINE_GRID = [round(0.05 + 0.9 * i / 49, 4) for i in range(50)]
_CURVE = """SELECT threshold, round(avg(pi), 4) AS treat_rate, round(avg(v), 4) AS value_dr, round(avg(v) - avg(v0), 4) AS delta_vs_none, round(avg(v) - avg(v1), 4) AS delta_vs_all
FROM (SELECT threshold, CASE WHEN tau <= threshold THEN 1 ELSE 0 END AS pi, {v} AS v, {v0} AS v0, {v1} AS v1 FROM s, {g}) GROUP BY threshold""".replace("{v}", _score("CASE WHEN tau <= threshold THEN 1 ELSE 0 END")).replace("{v0}", _score("0")).replace("{v1}", _score("1"))
_G0 = f"(SELECT CAST(unnest({_GRID}) AS DOUBLE) AS threshold)"
_G1 = f"(SELECT CAST(unnest({_FINE_GRID}) AS DOUBLE) AS threshold)"
_REFINED = f"""c AS ({_CURVE.replace("{g}", _G0 + " g0")}), b AS (SELECT threshold AS best FROM c ORDER BY value_dr, threshold LIMIT 1),
g AS (SELECT threshold FROM {_G0} UNION SELECT round(best - 0.05 + 0.01 * i, 4) FROM b, range(11) AS k(i))"""


@query(f"""WITH {_S}, {_REFINED} {_CURVE.replace("{g}", "g")}""", "treat_rate value_dr delta_vs_none delta_vs_all")
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    return policy.threshold_curve(_scored(spark, d), _GRID)


def _intervals(grid: str) -> str:
    return f"""v AS (SELECT threshold, rep, sum(k * {_score("CASE WHEN tau <= threshold THEN 1 ELSE 0 END")}) / sum(k) AS v FROM r, {grid} GROUP BY ALL),
ci AS (SELECT threshold, avg(v) AS boot_mean, stddev_samp(v) AS boot_sd, quantile_cont(v, 0.025) AS ci_lo, quantile_cont(v, 0.975) AS ci_hi FROM v GROUP BY 1)"""


@query(f"""WITH {_S}, {_reps(B_POLICY)}, {_intervals(_G0 + " g")} SELECT * FROM ci""", "boot_mean boot_sd ci_lo ci_hi")
def curve_intervals(spark: SparkSession, d: str) -> DataFrame:
    return policy.curve_with_intervals(_scored(spark, d), "id", _GRID, B_POLICY, seed=SEED)


@query(f"""WITH {_S}, {_REFINED}, f AS ({_CURVE.replace("{g}", "g")}), {_reps(B_POLICY)}, {_intervals("g")} SELECT * FROM f JOIN ci USING (threshold)""", "treat_rate value_dr delta_vs_none delta_vs_all boot_mean boot_sd ci_lo ci_hi")
def full_threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    """Grid and refinement, each threshold with its value, deltas and bootstrap interval."""
    return policy.full_curve(_scored(spark, d), "id", _GRID, B_POLICY, seed=SEED)


def _group_sql(tau: str, m0: str, m1: str) -> str:
    return f"""g AS (SELECT CAST(risk_bin AS INTEGER) AS risk_bin, count(*) AS n, avg({m0}) AS risk0_mean, avg({tau}) AS tau_mean, quantile_cont({tau}, 0.5) AS tau_median, avg(pi) AS treat_rate, avg(CASE WHEN pi = 1 THEN {m1} ELSE {m0} END) AS mort_policy, avg({m0}) AS mort_none, avg({m1}) AS mort_treat_all FROM b GROUP BY risk_bin)
SELECT *, mort_policy - mort_treat_all AS delta_policy_vs_treat_all, mort_policy - mort_none AS delta_policy_vs_none, -(mort_policy - mort_none) AS benefit_abs, -(mort_policy - mort_none) * n AS benefit_total FROM g"""


_GROUP_DOUBLES = "risk0_mean tau_mean tau_median treat_rate mort_policy mort_none mort_treat_all delta_policy_vs_treat_all delta_policy_vs_none benefit_abs benefit_total"


@query(f"""WITH {_S}, q AS (SELECT list_sort(list_distinct(quantile_cont(m0, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS ed FROM s), b AS (SELECT s.*, len(list_filter(ed[2 : len(ed) - 1], lambda x: x < m0)) AS risk_bin, CASE WHEN tau <= 0 THEN 1 ELSE 0 END AS pi FROM s, q), {_group_sql("tau", "m0", "m1")}""", _GROUP_DOUBLES)
def risk_bins(spark: SparkSession, d: str) -> DataFrame:
    return policy.risk_bins(_scored(spark, d), 0.0)


@query(f"""WITH {_S}, b AS (SELECT 2 * t + y AS risk_bin, tau, CAST(y AS DOUBLE) AS mm0, greatest(0.0, least(1.0, y + tau)) AS mm1, CASE WHEN tau <= 0 THEN 1 ELSE 0 END AS pi FROM s), {_group_sql("tau", "mm0", "mm1")}""", _GROUP_DOUBLES)
def outcome_arm_groups(spark: SparkSession, d: str) -> DataFrame:
    return policy.outcome_arm_groups(_scored(spark, d), 0.0)


_REPORT = f"""SELECT *, CASE WHEN v_policy = least(v_policy, v_none, v_all) THEN 'policy' WHEN v_none = least(v_policy, v_none, v_all) THEN 'none' ELSE 'all' END AS best, least(v_none, v_all) - v_policy AS gain_over_uniform
FROM (SELECT count(*) AS n, CAST(sum(pi) AS BIGINT) AS n_treat, avg(pi) AS treat_rate, avg(CASE WHEN pi = t THEN 1 ELSE 0 END) AS agreement, avg(tau) AS tau_mean, stddev_samp(tau) AS tau_sd, avg({_score("pi")}) AS v_policy, avg({_score("0")}) AS v_none, avg({_score("1")}) AS v_all
FROM (SELECT *, CASE WHEN tau <= 0 THEN 1 ELSE 0 END AS pi FROM s))"""
_VALUES = {"v_policy": "value", "v_none": "none", "v_all": "every"}
_SIDES = ", ".join(f"stddev_samp({c}) AS {n}_sd, quantile_cont({c}, 0.025) AS {n}_lo, quantile_cont({c}, 0.975) AS {n}_hi" for n, c in _VALUES.items())


@query(f"""{_paired(B_POLICY, "CASE WHEN tau <= 0 THEN 1 ELSE 0 END")} SELECT * FROM ({_REPORT}), (SELECT {_SIDES} FROM d)""", "treat_rate agreement tau_mean tau_sd v_policy v_none v_all gain_over_uniform " + " ".join(f"{n}_{x}" for n in _VALUES for x in ("sd", "lo", "hi")))
def personalised_report(spark: SparkSession, d: str) -> DataFrame:
    return policy.personalised_report(_scored(spark, d), 0.0, key="id", n_boot=B_POLICY, seed=SEED)


_IPW = "(CASE WHEN tau > {c} THEN 1.0 ELSE 0.0 END * t / {p} * y + (1 - CASE WHEN tau > {c} THEN 1.0 ELSE 0.0 END) * (1 - t) / (1 - {p}) * y)"


@query(f"WITH {_S} SELECT threshold, avg(CASE WHEN tau > threshold THEN 1 ELSE 0 END) AS treat_rate, avg({_IPW.format(c='threshold', p='greatest(0.01, least(0.99, pt))')}) AS value FROM s, {_G1} g GROUP BY 1", "treat_rate value")
def simple_ipw_curve(spark: SparkSession, d: str) -> DataFrame:
    return policy.simple_ipw_curve(_scored(spark, d), _FINE_GRID)


@query(f"""WITH {_S}, {_reps(B_COMPARISON)}, p AS (SELECT rep, sum(k * t) / sum(k) AS pr FROM r GROUP BY 1), v AS (SELECT rep, sum(k * {_IPW.format(c="0", p="pr")}) / sum(k) AS a, sum(k * t / pr * y) / sum(k) AS b, sum(k * (1 - t) / (1 - pr) * y) / sum(k) AS c FROM r JOIN p USING (rep) GROUP BY rep),
l AS (SELECT 'personalised' AS method, a AS x FROM v UNION ALL SELECT 'treat_all', b FROM v UNION ALL SELECT 'treat_none', c FROM v) SELECT method, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.025) AS ci_lo, quantile_cont(x, 0.975) AS ci_hi FROM l GROUP BY 1""", "mean sd ci_lo ci_hi")
def simple_ipw_comparison(spark: SparkSession, d: str) -> DataFrame:
    return policy.simple_ipw_comparison(_scored(spark, d), "id", B_COMPARISON, SEED)


@query(f"WITH {_S} SELECT t AS arm, count(tau) AS n, avg(tau) AS mean, stddev_samp(tau) AS sd, min(tau) AS min, quantile_cont(tau, 0.25) AS p25, quantile_cont(tau, 0.5) AS p50, quantile_cont(tau, 0.75) AS p75, max(tau) AS max FROM s GROUP BY 1", "mean sd min p25 p50 p75 max")
def tau_by_arm(spark: SparkSession, d: str) -> DataFrame:
    return policy.tau_by_arm(_scored(spark, d))


@query(f"WITH {_UNITS} SELECT id, coalesce(bal, avg(bal) OVER (PARTITION BY t, y), avg(bal) OVER (), 0.0) AS bal FROM u", "bal")
def group_impute(spark: SparkSession, d: str) -> DataFrame:
    return causal.group_impute(_units(spark, d), ["bal"]).select("id", "bal")


@query(f"WITH {_UNITS}, q AS (SELECT min(bal) AS lo, max(bal) AS hi FROM u) SELECT id, coalesce((bal - lo) / (hi - lo + 1e-12), 0.0) AS bal, 0.0::DOUBLE AS constant FROM u, q", "bal")
def min_max(spark: SparkSession, d: str) -> DataFrame:
    return causal.min_max(_units(spark, d).withColumn("constant", F.lit(3.0)), ["bal", "constant"]).select("id", "bal", "constant")


@query(f"WITH {_UNITS}, g AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE y END AS yy FROM u) SELECT id, CAST(coalesce(yy, (SELECT yy FROM g WHERE yy IS NOT NULL GROUP BY yy ORDER BY count(*) DESC, yy LIMIT 1)) AS INTEGER) AS y FROM g")
def mode_fill(spark: SparkSession, d: str) -> DataFrame:
    return causal.mode_fill(_units(spark, d).withColumn("y", F.expr("case when id % 5 = 0 then null else y end")), "y").select("id", "y")


_BASELINE = long_sql(
    overlap=("arm", ORACLE_SQL["ps_overlap"]),
    weights=(None, f"WITH {_S}, {_TRIMMED} SELECT count(*) AS n, pow(sum(w), 2) / (sum(w * w) + 1e-12) AS ess, pow(sum(w), 2) / (sum(w * w) + 1e-12) / count(*) AS ess_ratio, quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.9) AS p90, quantile_cont(w, 0.95) AS p95, quantile_cont(w, 0.99) AS p99, min(w) AS min, avg(w) AS mean, stddev_pop(w) AS sd, max(w) AS max FROM w"),
    effects=(None, f"WITH {_S}, {_TRIMMED} SELECT {_ate('w')} AS iptw, {_ate('CASE WHEN t = 1 THEN 1 - e ELSE e END')} AS ato, avg(m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e)) AS aipw FROM w"),
    balance=(None, ORACLE_SQL["balance_summary"].replace(_W, _TRIMMED)),
    smd=("feature", ORACLE_SQL["smd_table"].replace(_W, _TRIMMED)),
    iptw_interval=(None, ORACLE_SQL["bootstrap_interval"]),
    ato_interval=(None, ORACLE_SQL["bootstrap_interval"].replace("(iptw)", "(ato)").replace("(iptw, ", "(ato, ")),
)


@query(_BASELINE, "value")
def baseline_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of the baseline report, one row each."""
    return long_report(baseline_report(_scored(spark, d), "id", ["price", "bal", "nat"], config("wide_trim"), B))


_AT_MOST_0 = "CASE WHEN tau <= 0 THEN 1 ELSE 0 END"
_POLICY = long_sql(
    report=(None, f"WITH {_S} {_REPORT}"),
    curve=("threshold", f"WITH {_S} {_CURVE.replace('{g}', _G0 + ' g0')}"),
    risk_bins=("risk_bin", ORACLE_SQL["risk_bins"]),
    paired=("quantity", f"{_paired(B_REPORT, _AT_MOST_0)}, {_summary('value', 'delta_none', 'delta_all')}"),
    tau=(None, f"WITH {_S} SELECT quantile_cont(tau, 0.01) AS p01, quantile_cont(tau, 0.25) AS p25, quantile_cont(tau, 0.5) AS p50, quantile_cont(tau, 0.75) AS p75, quantile_cont(tau, 0.99) AS p99, count(*) FILTER (WHERE tau < 0) AS n_negative, count(*) FILTER (WHERE tau >= 0) AS n_positive FROM s"),
    values=("quantity", f"{_paired(B_REPORT, _AT_MOST_0)}, {_summary('value', 'none', 'every')}"),
)


@query(_POLICY, "value")
def policy_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every measure of the policy report, one row each."""
    return long_report(policy_report(_scored(spark, d), "id", config("default", seed=SEED), B_REPORT))
