"""Controlled bias injection: make a randomised table look observational, reproducibly."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import clip, sigmoid
from tidewell.functions.uniform import uniform


def validate(frame: DataFrame, required: Sequence[str] = (), numeric: Sequence[str] = (), binary: Sequence[str] = ()) -> DataFrame:
    """(check, column, ok) rows: presence, not empty, no repeated names, not all missing, not constant, numeric, 0/1. One pass over the data."""
    rows: list[tuple[str, str | None, bool]] = [("present", c, c in frame.columns) for c in required]
    rows.append(("unique_names", None, len(set(frame.columns)) == len(frame.columns)))
    kinds, there = dict(frame.dtypes), [c for c in dict.fromkeys([*required, *numeric, *binary]) if c in frame.columns]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(there):
        aggs += [F.count(c).alias(f"k{i}"), F.count_distinct(c).alias(f"u{i}"), F.count(F.when(~F.col(c).cast("string").isin("0", "1", "0.0", "1.0", "true", "false"), 1)).alias(f"b{i}")]
    one = frame.agg(*aggs).first()
    rows.append(("not_empty", None, one["n"] > 0))
    for i, c in enumerate(there):
        rows += [("not_all_missing", c, one[f"k{i}"] > 0), ("not_constant", c, one[f"u{i}"] > 1)]
        if c in numeric:
            rows.append(("numeric", c, kinds[c] in ("int", "bigint", "smallint", "tinyint", "float", "double", "boolean") or kinds[c].startswith("decimal")))
        if c in binary:
            rows.append(("binary", c, one[f"b{i}"] == 0 and one[f"k{i}"] > 0))
    return frame.sparkSession.createDataFrame(rows, "check string, column string, ok boolean")


def require_valid(report: DataFrame) -> None:
    """An error that names every failed check."""
    if bad := [f"{r['check']}({r['column'] or ''})" for r in report.where("not ok").collect()]:
        raise ValueError("; ".join(bad))


def apply_missing_policy(frame: DataFrame, columns: Sequence[str], policy: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(rows, one row: n_before, n_after, n_missing): drop rows with a NULL in columns, or put the column's mean."""
    if policy not in ("drop", "mean"):
        raise ValueError("policy must be drop or mean")
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    counts = frame.agg(F.count("*").alias("n_before"), (F.count("*") - F.count(F.when(gap, 1)) if policy == "drop" else F.count("*")).alias("n_after"), F.count(F.when(gap, 1)).alias("n_missing"))
    if policy == "drop":
        return frame.dropna(subset=list(columns)), counts
    means = frame.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    out = frame.crossJoin(F.broadcast(means))
    return out.withColumns({c: F.coalesce(c, f"__m_{c}") for c in columns}).drop(*[f"__m_{c}" for c in columns]), counts


def standardise(frame: DataFrame, columns: Sequence[str], skip_binary: bool = True, suffix: str = "_scaled") -> tuple[DataFrame, list[str]]:
    """Adds z-scores (population sd); binary columns are copied if skip_binary. Zero variance is an error."""
    one = frame.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.count(F.when(~F.col(c).isin(0, 1), 1)).alias(f"o_{c}"))]).first()
    out = {}
    for c in columns:
        if skip_binary and one[f"o_{c}"] == 0:
            out[f"{c}{suffix}"] = F.col(c).cast("double")
            continue
        if not one[f"s_{c}"]:
            raise ValueError(f"{c} has no variance")
        out[f"{c}{suffix}"] = (F.col(c) - one[f"m_{c}"]) / one[f"s_{c}"]
    return frame.withColumns(out), list(out)


def parse_weights(raw: Sequence[str], suffix: str = "_scaled") -> dict[str, float]:
    """`column=value` texts to weights of scaled columns; a malformed or repeated one is an error."""
    out: dict[str, float] = {}
    for text in raw:
        name, mark, value = text.partition("=")
        if not mark or not name.strip() or name.strip() + suffix in out:
            raise ValueError(f"bad weight: {text}")
        out[name.strip() + suffix] = float(value)
    return out


def linear_score(weights: Mapping[str, float], treatment: str | None = None, treatment_weight: float = 0.0) -> Column:
    score = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])
    return score + F.col(treatment) * treatment_weight if treatment else score


def calibrate_intercept(frame: DataFrame, score: str, target: float, strength: float = 1.0, low: float = -50.0, high: float = 50.0, tol: float = 1e-8) -> float:
    """The intercept at which mean sigmoid(intercept + strength * score) is the target.

    Newton steps inside a bracket, halved where a step would leave it; every pass is one aggregate (a mean and its
    slope) over the cached scores. An unreachable target is an error.
    """
    if not 0 < target < 1:
        raise ValueError("target must lie in (0, 1)")
    scores = frame.select((F.col(score).cast("double") * strength).alias("s")).persist()
    at = lambda x: sigmoid(F.col("s") + x, 500.0)
    try:
        least, most = scores.agg(F.avg(at(low)), F.avg(at(high))).first()
        if least is None or not least <= target <= most:
            raise ValueError("the target rate is outside the bracket")
        x = (low + high) / 2
        for _ in range(100):
            mean, slope = scores.agg(F.avg(at(x)), F.avg(at(x) * (1 - at(x)))).first()
            if abs(mean - target) <= tol or high - low < 1e-12:
                break
            low, high = (x, high) if mean < target else (low, x)
            step = x + (target - mean) / slope if slope else low
            x = step if low < step < high else (low + high) / 2
        return x
    finally:
        scores.unpersist()


def select_rows(frame: DataFrame, key: str, probability: Column, seed: int = 42) -> DataFrame:
    """Adds selection_probability and selection_indicator: 1 if the row's seeded uniform is below it."""
    out = frame.withColumn("selection_probability", probability)
    return out.withColumn("selection_indicator", (uniform(seed, F.col(key)) < F.col("selection_probability")).cast("int"))


def selection_pipeline(frame: DataFrame, key: str, weights: Mapping[str, float], target: float, treatment: str | None = None, treatment_weight: float = 0.0, strength: float = 1.0, seed: int = 42, tol: float = 1e-8) -> tuple[DataFrame, DataFrame, float]:
    """(annotated, selected, intercept) from raw covariates: scale, score, calibrate, sample."""
    scaled, _ = standardise(frame.dropna(subset=list(weights)), list(weights))
    scored = scaled.withColumn("selection_linear_score", linear_score({f"{c}_scaled": w for c, w in weights.items()}, treatment, treatment_weight))
    intercept = calibrate_intercept(scored, "selection_linear_score", target, strength, tol=tol)
    annotated = select_rows(scored, key, sigmoid(F.col("selection_linear_score") * strength + intercept, 500.0), seed)
    return annotated, annotated.where("selection_indicator = 1"), intercept


def shift_balance(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean_before, mean_after, smd): population variances; 0 if sd and difference are 0, NULL if only the sd is."""

    def moments(frame: DataFrame, tag: str) -> DataFrame:
        one = frame.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias(f"m{tag}"), F.col(f"v_{c}").alias(f"v{tag}")) for c in columns])).alias("r")).select("r.*")

    both = moments(before, "0").join(moments(after, "1"), "column")
    sd, gap = F.sqrt((F.col("v0") + F.col("v1")) / 2), F.col("m1") - F.col("m0")
    return both.select("column", F.col("m0").alias("mean_before"), F.col("m1").alias("mean_after"), F.when(sd > 0, gap / sd).when(gap == 0, 0.0).alias("smd"))


def dataset_summary(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_missing, is_binary, mean, sd, min, max): sd with the population divisor."""
    one = frame.agg(F.count("*").alias("n"), *[x for i, c in enumerate(columns) for x in (F.count(c).alias(f"k{i}"), F.count(F.when(~F.col(c).isin(0, 1), 1)).alias(f"o{i}"), F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"), F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"))])
    rows = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"k{i}")).alias("n_missing"), ((F.col(f"o{i}") == 0) & (F.col(f"k{i}") > 0)).alias("is_binary"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def artificial_propensity(weights: Mapping[str, float], intercept: float, low: float = 0.05, high: float = 0.95) -> tuple[Column, Column]:
    """(raw, clipped) sigmoid of a weighted sum of scaled covariates."""
    raw = sigmoid(linear_score(weights) + intercept, 500.0)
    return raw, clip(raw, low, high)


def assign_treatment(frame: DataFrame, key: str, ps: str, seed: int = 42, name: str = "treat_obs") -> DataFrame:
    return frame.withColumn(name, (uniform(seed, F.col(key)) < F.col(ps)).cast("int"))


def arm_balance(frame: DataFrame, columns: Sequence[str], t: str) -> DataFrame:
    """(column, mean_treated, mean_control, smd) with sample variances; 0 where the pooled sd is 0."""
    long = frame.select(F.col(t).alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("t", "r.*")
    arm = lambda a: F.when(F.col("t") == a, F.col("x"))
    per = long.groupBy("column").agg(F.avg(arm(1)).alias("mean_treated"), F.avg(arm(0)).alias("mean_control"), F.var_samp(arm(1)).alias("v1"), F.var_samp(arm(0)).alias("v0"))
    sd = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return per.select("column", "mean_treated", "mean_control", F.when(sd == 0, 0.0).otherwise((F.col("mean_treated") - F.col("mean_control")) / sd).alias("smd"))


def harmonise(reference: DataFrame, transformed: DataFrame, treatment: str, new_treatment: str, backup: str | None = None) -> DataFrame:
    """transformed in the reference's columns and order, its treatment replaced by the new one; a missing column is an error."""
    lacking = [c for c in [*reference.columns, new_treatment] if c not in transformed.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    out = transformed.withColumn(backup, F.col(treatment)) if backup else transformed
    out = out.withColumn(treatment, F.col(new_treatment).cast(reference.schema[treatment].dataType))
    return out.select(*reference.columns, *([backup] if backup else []))


def logit(p: float) -> float:
    return math.log(p / (1 - p))
