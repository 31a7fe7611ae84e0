"""Treatment policies from effect scores: decisions, doubly-robust values, curves, risk groups.

Lower values are better (the outcome is a harm). Frames carry id, t, y, ps, m1, m0, tau.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import clip
from tidewell.operators.causal import EPS, beside, clip_ps, drawn_sums, quantile_bins, spread
from tidewell.operators.ranks import numbered, quantiles
from tidewell.sources.tables import cut


def policy_from_tau(frame: DataFrame, kind: str = "tau_lt_0", top_frac: float = 0.2, name: str = "pi") -> DataFrame:
    """Adds a 0/1 decision: tau_lt_0, tau_gt_0, or top_frac_benefit (tau at most its top_frac quantile)."""
    tau = F.col("tau")
    if kind == "tau_lt_0":
        return frame.withColumn(name, (tau < 0).cast("int"))
    if kind == "tau_gt_0":
        return frame.withColumn(name, (tau > 0).cast("int"))
    if kind != "top_frac_benefit" or not 0 < top_frac < 1:
        raise ValueError("unknown kind, or top_frac outside (0, 1)")
    bound = F.broadcast(quantiles(frame, "tau", [top_frac], name="__q"))  # one row
    return frame.crossJoin(bound).withColumn(name, (tau <= F.get("__q", F.lit(0))).cast("int")).drop("__q")


def decide(tau: Column, threshold: float | Column, rule: str) -> Column:
    """tau_le_thr or tau_ge_thr."""
    if rule not in ("tau_le_thr", "tau_ge_thr"):
        raise ValueError(f"unknown rule {rule}")
    return (tau <= threshold if rule == "tau_le_thr" else tau >= threshold).cast("int")


def top_fraction(frame: DataFrame, key: str, frac: float, name: str = "pi") -> DataFrame:
    """1 for the ceil(n * frac) least tau, ties by id."""
    ranked = numbered(frame.select(key, "tau"), "tau", key)
    return frame.join(ranked.select(key, (F.col("__rank") <= F.ceil(F.col("__n") * F.lit(frac))).cast("int").alias(name)), key)


def _parts(pi: Column, low: float, high: float) -> tuple[Column, Column, Column]:
    """(value under pi, inverse probability of a matching action, residual)."""
    t, e = F.col("t"), clip_ps(F.col("ps"), low, high)
    under = pi * F.col("m1") + (1 - pi) * F.col("m0")
    observed = t * F.col("m1") + (1 - t) * F.col("m0")
    return under, F.when(t == pi, 1.0).otherwise(0.0) / (t * e + (1 - t) * (1 - e) + EPS), F.col("y") - observed


def dr_score(pi: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Per row: its mean is the doubly-robust value of the policy."""
    under, ipw, residual = _parts(pi, low, high)
    return under + ipw * residual


def dr_value(frame: DataFrame, pi: str = "pi", trim: tuple[float, float] | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row (value): the doubly-robust value; trim clips the inverse probabilities of matched rows to their quantiles."""
    under, ipw, residual = _parts(F.col(pi), low, high)
    if not trim:
        return frame.agg(F.avg(under + ipw * residual).alias("value"))
    rows = frame.withColumn("__ipw", ipw)
    matched = F.when(F.col("t") == F.col(pi), F.col("__ipw"))
    rows = rows.crossJoin(F.broadcast(quantiles(rows, matched, trim, name="__q")))  # one row
    weight = F.when(matched.isNotNull(), clip(F.col("__ipw"), F.get("__q", F.lit(0)), F.get("__q", F.lit(1)))).otherwise(0.0)
    return rows.agg(F.avg(under + weight * residual).alias("value"))


def bootstrap_values(frame: DataFrame, key: str, n_boot: int, pi: str = "pi", seed: int = 42) -> DataFrame:
    """(rep, value, none, every, delta_none, delta_all): all three policies on the same resample."""
    names = ("value", "none", "every")
    scores = spread(frame, key, *[dr_score(p).alias(c) for c, p in zip(names, (F.col(pi), F.lit(0), F.lit(1)), strict=True)])
    sums = drawn_sums(scores, key, n_boot, seed, [], {c: F.col(c) for c in names})
    per = sums.where("k > 0").select("rep", *[(F.col(c) / F.col("k")).alias(c) for c in names])
    return per.select("rep", "value", "none", "every", (F.col("value") - F.col("none")).alias("delta_none"), (F.col("value") - F.col("every")).alias("delta_all"))


def paired_summary(reps: DataFrame, alpha: float = 0.05, quantities: Sequence[str] = ("value", "delta_none", "delta_all")) -> DataFrame:
    """(quantity, mean, sd, ci_lo, ci_hi, p_negative) of columns of bootstrap_values."""
    long = reps.select(F.explode(F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).alias("x")) for c in quantities])).alias("r")).select("r.*")
    q = F.percentile("x", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    per = long.groupBy("quantity").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), q.alias("q"), F.avg((F.col("x") < 0).cast("int")).alias("p_negative"))
    return per.select("quantity", "mean", "sd", F.get("q", F.lit(0)).alias("ci_lo"), F.get("q", F.lit(1)).alias("ci_hi"), "p_negative")


def _each(thresholds: Sequence[float]) -> list[float]:
    return sorted({round(float(x), 4) for x in thresholds})


def _parted(grid: Sequence[float], rule: str) -> Column:
    """Where tau parts the ordered thresholds into those that treat it and those that do not: rows are summed up by that place."""
    edges = F.array(*[F.lit(float(x)) for x in grid])
    return F.size(F.filter(edges, (lambda g: g <= F.col("tau")) if rule == "tau_ge_thr" else (lambda g: g < F.col("tau"))))


def _by_threshold(per: DataFrame, grid: Sequence[float], rule: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, rate, v): share treated and mean score under each threshold. per: by, b (see _parted), n and the sums of s0 and s1 (scores untreated and treated)."""
    places = F.broadcast(per.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(grid)], "i int, threshold double"))
    treated = F.col("i") >= F.col("b") if rule == "tau_le_thr" else F.col("i") < F.col("b")
    pick = lambda yes, no: F.sum(F.when(treated, yes).otherwise(no)) / F.sum("n")
    return per.crossJoin(places).groupBy(*by, "threshold").agg(pick(F.col("n"), 0).alias("rate"), pick(F.col("s1"), F.col("s0")).alias("v"))


def _scores(frame: DataFrame, *keep: str) -> DataFrame:
    return frame.select(*keep, "tau", dr_score(F.lit(0)).alias("s0"), dr_score(F.lit(1)).alias("s1"))


def _summed(rows: DataFrame, grid: Sequence[float], rule: str) -> DataFrame:
    return rows.where("tau is not null").groupBy(_parted(grid, rule).alias("b")).agg(F.count("*").alias("n"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))


def threshold_values(frame: DataFrame, thresholds: Sequence[float], rule: str = "tau_le_thr") -> DataFrame:
    """(threshold, treat_rate, value_dr, delta_vs_none, delta_vs_all) of each threshold, all in one pass; rounded to 4 digits."""
    decide(F.col("tau"), 0.0, rule)  # rejects an unknown rule
    rows = _scores(frame)
    per = _by_threshold(_summed(rows, _each(thresholds), rule), _each(thresholds), rule).crossJoin(F.broadcast(rows.agg(F.avg("s0").alias("v0"), F.avg("s1").alias("v1"))))
    return per.select("threshold", F.round("rate", 4).alias("treat_rate"), F.round("v", 4).alias("value_dr"), F.round(F.col("v") - F.col("v0"), 4).alias("delta_vs_none"), F.round(F.col("v") - F.col("v1"), 4).alias("delta_vs_all"))


def threshold_curve(frame: DataFrame, thresholds: Sequence[float], rule: str = "tau_le_thr", objective: str = "min") -> DataFrame:
    """The grid, refined by steps of 0.01 within 0.05 of its best threshold."""
    coarse = threshold_values(frame, thresholds, rule)
    order = F.col("value_dr").asc() if objective == "min" else F.col("value_dr").desc()
    best = coarse.orderBy(order, "threshold").first()["threshold"]
    fine = [best - 0.05 + 0.01 * i for i in range(11)]
    return threshold_values(frame, [*thresholds, *fine], rule)


def curve_with_intervals(frame: DataFrame, key: str, thresholds: Sequence[float], n_boot: int, rule: str = "tau_le_thr", seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(threshold, boot_mean, boot_sd, ci_lo, ci_hi): every replicate of every threshold in one pass over the rows."""
    decide(F.col("tau"), 0.0, rule)  # rejects an unknown rule
    grid = _each(thresholds)
    rows = spread(_scores(frame, key).where("tau is not null"), key, _parted(grid, rule).alias("b"), F.col("s0"), F.col("s1"))
    sums = drawn_sums(rows, key, n_boot, seed, ["b"], {"s0": F.col("s0"), "s1": F.col("s1")}).withColumnRenamed("k", "n")
    reps = _by_threshold(sums.where("n > 0"), grid, rule, ["rep"])
    q = F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))  # of n_boot values
    per = reps.groupBy("threshold").agg(F.avg("v").alias("boot_mean"), F.stddev_samp("v").alias("boot_sd"), q.alias("q"))
    return per.select("threshold", "boot_mean", "boot_sd", F.get("q", F.lit(0)).alias("ci_lo"), F.get("q", F.lit(1)).alias("ci_hi"))


def full_curve(frame: DataFrame, key: str, thresholds: Sequence[float], n_boot: int, rule: str = "tau_le_thr", objective: str = "min", seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """threshold_curve (grid and refinement) with boot_mean, boot_sd, ci_lo and ci_hi of every threshold beside it."""
    curve = cut(threshold_curve(frame, thresholds, rule, objective))
    grid = [r["threshold"] for r in curve.select("threshold").collect()]  # the grid and eleven more
    return curve.join(curve_with_intervals(frame, key, grid, n_boot, rule, seed, alpha), "threshold")


def _groups(frame: DataFrame, group: str, tau: str, m0: str, m1: str) -> DataFrame:
    policy = F.when(F.col("pi") == 1, F.col(m1)).otherwise(F.col(m0))
    per = frame.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(m0).alias("risk0_mean"), F.avg(tau).alias("tau_mean"), F.avg("pi").alias("treat_rate"),
        F.avg(policy).alias("mort_policy"), F.avg(m0).alias("mort_none"), F.avg(m1).alias("mort_treat_all"),
    )
    middle = quantiles(frame, tau, [0.5], [group]).select(F.col(group).alias("__g"), F.get("q", F.lit(0)).alias("tau_median"))
    per = per.join(middle, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    none = F.col("mort_policy") - F.col("mort_none")
    return per.withColumns({"delta_policy_vs_treat_all": F.col("mort_policy") - F.col("mort_treat_all"), "delta_policy_vs_none": none, "benefit_abs": -none, "benefit_total": -none * F.col("n")})


def risk_bins(frame: DataFrame, threshold: float, n_bins: int = 5, rule: str = "tau_le_thr") -> DataFrame:
    """Per quantile bin of baseline risk m0: sizes, means, treat rate, deltas and total benefit of the policy."""
    whole = frame.where("tau is not null and m0 is not null and m1 is not null")
    return _groups(quantile_bins(whole, "m0", n_bins, "risk_bin").withColumn("pi", decide(F.col("tau"), threshold, rule)), "risk_bin", "tau", "m0", "m1")


def outcome_arm_groups(frame: DataFrame, threshold: float, rule: str = "tau_le_thr") -> DataFrame:
    """As risk_bins, by group 2t + y, with y as the risk and clip(y + tau, 0, 1) as its counterfactual."""
    y = F.col("y").cast("double")
    rows = frame.where("tau is not null").withColumns({"risk_bin": (2 * F.col("t") + F.col("y")).cast("int"), "__m0": y, "__m1": clip(y + F.col("tau"), 0.0, 1.0), "pi": decide(F.col("tau"), threshold, rule)})
    return _groups(rows, "risk_bin", "tau", "__m0", "__m1")


def simple_ipw_score(threshold: float | Column, p: Column, direction: str = "gt") -> Column:
    """Per row: inverse-probability value of treating beyond a threshold, with a constant propensity p."""
    t, y, e = F.col("t"), F.col("y"), clip_ps(p)
    pi = (F.col("tau") > threshold if direction == "gt" else F.col("tau") < threshold).cast("double")
    return pi * t / e * y + (1 - pi) * (1 - t) / (1 - e) * y


def simple_ipw_curve(frame: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, treat_rate, value) under simple_ipw_score with p the treated share."""
    rows = beside(frame, F.avg("t").alias("p")).select("tau", *[simple_ipw_score(x, F.col("p")).alias(c) for c, x in (("s0", float("inf")), ("s1", float("-inf")))])
    return _by_threshold(_summed(rows, _each(thresholds), "tau_gt_thr"), _each(thresholds), "tau_gt_thr").select("threshold", F.col("rate").alias("treat_rate"), F.col("v").alias("value"))


def simple_ipw_comparison(frame: DataFrame, key: str, n_boot: int, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(method, mean, sd, ci_lo, ci_hi) of personalised, treat_all and treat_none over replicates; p is the replicate's own."""
    k = F.col("k")
    rows = spread(frame, key, F.col("t"), F.col("y"), (F.col("tau") > 0).cast("int").alias("tau"))
    rows = cut(drawn_sums(rows, key, n_boot, seed, ["t", "y", "tau"], {}).where("k > 0"))  # eight rows a replicate at most
    rows = rows.join(F.broadcast(rows.groupBy("rep").agg((F.sum(k * F.col("t")) / F.sum(k)).alias("p"))), "rep")
    score = {"personalised": simple_ipw_score(0.0, F.col("p")), "treat_all": simple_ipw_score(float("-inf"), F.col("p")), "treat_none": simple_ipw_score(float("inf"), F.col("p"))}
    reps = rows.groupBy("rep").agg(*[(F.sum(k * s) / F.sum(k)).alias(n) for n, s in score.items()])
    long = reps.select(F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("v")) for n in score])).alias("r")).select("r.*")
    q = F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    per = long.groupBy("method").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), q.alias("q"))
    return per.select("method", "mean", "sd", F.get("q", F.lit(0)).alias("ci_lo"), F.get("q", F.lit(1)).alias("ci_hi"))


def tau_by_arm(frame: DataFrame) -> DataFrame:
    """(arm, n, mean, sd, min, p25, p50, p75, max) of tau."""
    per = frame.groupBy(F.col("t").alias("arm")).agg(F.count("tau").alias("n"), F.avg("tau").alias("mean"), F.stddev_samp("tau").alias("sd"), F.min("tau").alias("min"), F.max("tau").alias("max"))
    at = quantiles(frame, "tau", (0.25, 0.5, 0.75), ["t"]).withColumnRenamed("t", "__t")
    per = per.join(at, F.col("arm").eqNullSafe(F.col("__t")), "left")
    return per.select("arm", "n", "mean", "sd", "min", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def tau_quantiles(frame: DataFrame) -> DataFrame:
    """One row (p01, p25, p50, p75, p99, n_negative, n_positive) of tau; 0 counts as positive."""
    q = F.broadcast(quantiles(frame, "tau", (0.01, 0.25, 0.5, 0.75, 0.99)))
    one = frame.agg(F.count_if(F.col("tau") < 0).alias("n_negative"), F.count_if(F.col("tau") >= 0).alias("n_positive")).crossJoin(q)
    return one.select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p01", "p25", "p50", "p75", "p99"))], "n_negative", "n_positive")


def personalised_report(frame: DataFrame, threshold: float = 0.0, rule: str = "tau_le_thr", key: str | None = None, n_boot: int = 0, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row: allocation, tau summary, values of the policy and of treating none or all, and the best of them.

    With a key and n_boot, each value also has its bootstrap sd and interval (v_policy_sd, v_policy_lo, v_policy_hi, ...).
    """
    pi = decide(F.col("tau"), threshold, rule)
    one = frame.agg(
        F.count("*").alias("n"), F.sum(pi).cast("bigint").alias("n_treat"), F.avg(pi).alias("treat_rate"), F.avg((pi == F.col("t")).cast("int")).alias("agreement"), F.avg("tau").alias("tau_mean"), F.stddev_samp("tau").alias("tau_sd"),
        F.avg(dr_score(pi)).alias("v_policy"), F.avg(dr_score(F.lit(0))).alias("v_none"), F.avg(dr_score(F.lit(1))).alias("v_all"),
    )
    least = F.least("v_policy", "v_none", "v_all")
    best = F.when(F.col("v_policy") == least, "policy").when(F.col("v_none") == least, "none").otherwise("all")
    one = one.withColumns({"best": best, "gain_over_uniform": F.least("v_none", "v_all") - F.col("v_policy")})
    if not (key and n_boot):
        return one
    reps = bootstrap_values(frame.withColumn("__pi", pi), key, n_boot, "__pi", seed)
    sides = []
    for column, name in (("value", "v_policy"), ("none", "v_none"), ("every", "v_all")):
        q = F.percentile(column, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))  # of n_boot values
        sides += [F.stddev_samp(column).alias(f"{name}_sd"), F.get(q, F.lit(0)).alias(f"{name}_lo"), F.get(q, F.lit(1)).alias(f"{name}_hi")]
    return one.crossJoin(F.broadcast(reps.agg(*sides)))
