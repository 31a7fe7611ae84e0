"""Reports that gather several operators over one scored frame as (section, json) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import bias, causal, policy, ranks
from tidewell.plans.study import EffectConfig
from tidewell.sources.tables import json_rows, stored


def _section(name: str, frame: DataFrame) -> DataFrame:
    return json_rows(frame).select(F.lit(name).alias("section"), "json")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def baseline_report(scored: DataFrame, key: str, features: Sequence[str], settings: EffectConfig, n_boot: int = 20) -> DataFrame:
    """Overlap, weights, effects, balance and bootstrap intervals of one scope. scored: key, t, y, ps, m1, m0, tau, features."""
    scored = scored.persist()
    rows = scored.withColumn("e", causal.clip_ps(F.col("ps"), *settings.ps_clip))
    weighted = causal.trim_to_quantiles(causal.iptw(rows, F.col("e")), "w", *settings.weight_trim)
    t, y = F.col("t"), F.col("y")
    effects = weighted.agg(causal.ate(y, t, F.col("w")).alias("iptw"), causal.ate(y, t, causal.overlap_weight(F.col("e"), t)).alias("ato"), F.avg(causal.pseudo_outcome(y, t, F.col("e"), F.col("m1"), F.col("m0"))).alias("aipw"))
    smd = causal.smd_table(weighted, features, w="w")
    reps = causal.bootstrap_effects(scored, key, n_boot, settings.seed, settings.weight_trim, *settings.ps_clip).persist()
    return _all(
        [
            _section("overlap", causal.ps_overlap(scored, low=settings.ps_clip[0], high=settings.ps_clip[1])), _section("weights", causal.weights_summary(weighted)), _section("effects", effects),
            _section("balance", causal.balance_summary(smd)), _section("smd", smd), _section("iptw_interval", causal.interval(reps, "iptw")), _section("ato_interval", causal.interval(reps, "ato")),
        ]
    )


def policy_report(scored: DataFrame, key: str, settings: EffectConfig, n_boot: int = 200) -> DataFrame:
    """Allocation, tau, values, curve, risk bins, and intervals of the values and paired differences of the threshold-0 policy. The scored rows are stored once: ten passes read them."""
    scored = stored(scored.select(key, "t", "y", "ps", "m1", "m0", "tau"), "scored")
    rows = scored.withColumn("pi", policy.decide(F.col("tau"), 0.0, settings.policy_rule))
    reps = policy.bootstrap_values(rows, key, n_boot, seed=settings.seed).persist()
    return _all(
        [
            _section("report", policy.personalised_report(scored, 0.0, settings.policy_rule)), _section("curve", policy.threshold_values(scored, settings.thresholds, settings.policy_rule)),
            _section("risk_bins", policy.risk_bins(scored, 0.0, 5, settings.policy_rule)), _section("paired", policy.paired_summary(reps)),
            _section("tau", policy.tau_quantiles(scored)), _section("values", policy.paired_summary(reps, quantities=("value", "none", "every"))),
        ]
    )


def selection_report(before: DataFrame, annotated: DataFrame, selected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Summaries of input and selection, selection rates, and the covariate shift."""
    rates = annotated.agg(F.count("*").alias("n"), F.sum("selection_indicator").alias("n_selected"), F.avg("selection_probability").alias("mean_probability"))
    return _all([_section("input", bias.dataset_summary(before, columns)), _section("selected", bias.dataset_summary(selected, columns)), _section("selection", rates), _section("shift", bias.shift_balance(before, selected, columns))])


def confounding_report(frame: DataFrame, columns: Sequence[str], original: str, new: str, ps: str) -> DataFrame:
    """Treatment rates, propensity quantiles and the ten largest arm differences."""
    q = F.broadcast(ranks.quantiles(frame, ps, (0.05, 0.25, 0.5, 0.75, 0.95)))
    one = frame.agg(F.count("*").alias("n"), F.avg(original).alias("original_rate"), F.avg(new).alias("new_rate")).crossJoin(q)
    rates = one.select("n", "original_rate", "new_rate", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))])
    balance = bias.arm_balance(frame, columns, new)
    return _all([_section("rates", rates), _section("balance", balance.orderBy(F.abs("smd").desc_nulls_last(), "column").limit(10))])
