"""Target-trial design: eligibility, time-zero, exposure, outcome, exclusions, covariates.

Spines have one row per unit with its key and t0; events have the key, ts, an item and maybe
a value. Every operator returns one row per unit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import bmi, clip, has, hours_between, in_window, shift, text_to_double
from tidewell.operators.joins import last_per_column, left_with_defaults, window_join
from tidewell.operators.profiles import first_row


def first_stay(stays: DataFrame, subject: str, start: str, tiebreak: str, eligible: Column, eligibility_first: bool = False) -> DataFrame:
    """The first stay of each subject that is eligible.

    eligibility_first filters before ranking (the first eligible stay); otherwise a subject whose first stay is
    not eligible drops out.
    """
    order = (F.col(start).asc_nulls_last(), F.col(tiebreak))
    return first_row(stays.where(eligible), subject, *order) if eligibility_first else first_row(stays, subject, *order).where(eligible)


def time_zero(cohort: DataFrame, events: DataFrame, key: str, is_start: Column, entry: str | None = None, hours: float | None = None, tiebreak: str = "event_id") -> DataFrame:
    """(key, t0, t0_value): the first qualifying event, within hours of entry where those are given."""
    joined = cohort.join(events.where(is_start), key)
    if entry:
        joined = joined.where(in_window(F.col("ts"), F.col(entry), 0, hours, "[]"))
    row = F.min_by(F.struct(F.col("ts").alias("t0"), F.col("value").alias("t0_value")), F.struct("ts", tiebreak))
    return joined.groupBy(key).agg(row.alias("r")).select(key, "r.*")


def majority_time_zero(events: DataFrame, key: str, classes: tuple[str, str], hours: float, column: str = "event_type") -> DataFrame:
    """(key, t0, n_a, n_b, label): t0 is the first event of either class, the label the more frequent class in the next hours; ties drop out."""
    of_class = events.where(F.col(column).isin(*classes))
    start = of_class.groupBy(key).agg(F.min("ts").alias("t0"))
    counts = window_join(start, of_class, key, 0, hours, closed="[]").groupBy(key, "t0").agg(
        F.count(F.when(F.col(column) == classes[0], 1)).alias("n_a"), F.count(F.when(F.col(column) == classes[1], 1)).alias("n_b")
    )
    label = F.when(F.col("n_a") > F.col("n_b"), classes[0]).when(F.col("n_b") > F.col("n_a"), classes[1])
    return counts.withColumn("label", label).where("label is not null")


def landmark(cohort: DataFrame, onset: DataFrame, key: str, entry: str, within_hours: float, lag_hours: float, exposure_hours: float) -> DataFrame:
    """(key, onset, t0, exposure_end): the first onset within hours of entry, the landmark behind it and the end of exposure."""
    first = cohort.join(onset, key).where(in_window(F.col("ts"), F.col(entry), 0, within_hours, "[]")).groupBy(key).agg(F.min("ts").alias("onset"))
    t0 = shift(F.col("onset"), lag_hours)
    return first.withColumns({"t0": t0, "exposure_end": shift(t0, exposure_hours)})


def exposure(spine: DataFrame, events: DataFrame, key: str, hours: float) -> DataFrame:
    """(key, treated, first_at, hours_to_first, n_events) from events in [t0, t0 + hours)."""
    found = window_join(spine.select(key, "t0"), events.select(key, "ts"), key, 0, hours).groupBy(key).agg(F.min("ts").alias("first_at"), F.count("*").alias("n_events"))
    out = left_with_defaults(spine.select(key, "t0"), found, key, {"n_events": 0})
    return out.select(key, has(F.col("first_at")).alias("treated"), "first_at", hours_between(F.col("first_at"), F.col("t0")).alias("hours_to_first"), "n_events")


def amounts(spine: DataFrame, events: DataFrame, key: str, hours: float, amount: Column) -> DataFrame:
    """(key, amount_v1, amount_v2, n_unparsed): sums of a text amount in the window.

    v1 counts an event without a readable amount as 1; v2 is the sum if positive, else the number of events.
    """
    value = text_to_double(amount)
    joined = window_join(spine.select(key, "t0"), events.withColumn("__amount", value).select(key, "ts", "__amount"), key, 0, hours)
    total = F.sum("__amount")
    per = joined.groupBy(key).agg(
        F.sum(F.coalesce("__amount", F.lit(1.0))).alias("amount_v1"), F.when(total > 0, total).otherwise(F.count("*").cast("double")).alias("amount_v2"), F.count(F.when(F.col("__amount").isNull(), 1)).alias("n_unparsed")
    )
    return left_with_defaults(spine.select(key), per, key, {"amount_v1": 0.0, "amount_v2": 0.0, "n_unparsed": 0})


def dose_threshold(spine: DataFrame, doses: DataFrame, key: str, dose: str, unparsed: str, threshold: float) -> DataFrame:
    """(key, dose, n_doses, n_unparsed, treated): 1 from the threshold on, 0 at no dose at all, NULL between."""
    per = doses.groupBy(key).agg(F.sum(dose).alias("dose"), F.count("*").alias("n_doses"), F.sum(unparsed).cast("bigint").alias("n_unparsed"))
    out = left_with_defaults(spine.select(key), per, key, {"dose": 0.0, "n_doses": 0, "n_unparsed": 0})
    return out.withColumn("treated", F.when(F.col("dose") >= threshold, 1).when(F.col("dose") == 0, 0))


def early_or_delayed(spine: DataFrame, events: DataFrame, key: str, early_hours: float, end_hours: float) -> DataFrame:
    """(key, first_at, early): 1 if the first event in [t0, t0 + end] comes before early_hours, 0 if later, NULL without any."""
    first = window_join(spine.select(key, "t0"), events.select(key, "ts"), key, 0, end_hours, closed="[]").groupBy(key).agg(F.min("ts").alias("first_at"))
    early = F.when(F.col("first_at") < shift(F.col("t0"), early_hours), 1).when(F.col("first_at").isNotNull(), 0)
    return spine.select(key, "t0").join(first, key, "left").select(key, "first_at", early.alias("early"))


def washed_out(spine: DataFrame, events: DataFrame, key: str, gap_hours: float) -> DataFrame:
    """The spine without units that have an event before t0 - gap."""
    first = events.groupBy(key).agg(F.min("ts").alias("ts"))  # whether any is before is whether the first one is
    before = spine.select(key, "t0").join(first, key).where(F.col("ts") < shift(F.col("t0"), -gap_hours)).select(key)
    return spine.join(before, key, "left_anti")


def prior_count(spine: DataFrame, events: DataFrame, key: str, name: str = "n_before") -> DataFrame:
    """(key, n): events before t0."""
    per = spine.select(key, "t0").join(events.select(key, "ts"), key).where("ts < t0").groupBy(key).agg(F.count("*").alias(name))
    return left_with_defaults(spine.select(key), per, key, {name: 0})


def outcome_in_horizon(spine: DataFrame, events: DataFrame, key: str, hours: float, exit_hours: float) -> DataFrame:
    """(key, y, outcome_at, early_exit): an event in (t0, t0 + hours]; early_exit if it comes before the enrolment ends."""
    first = window_join(spine.select(key, "t0"), events.select(key, "ts"), key, 0, hours, closed="(]").groupBy(key).agg(F.min("ts").alias("outcome_at"))
    out = spine.select(key, "t0").join(first, key, "left")
    early = F.coalesce((F.col("outcome_at") <= shift(F.col("t0"), exit_hours)).cast("int"), F.lit(0))
    return out.select(key, has(F.col("outcome_at")).alias("y"), "outcome_at", early.alias("early_exit"))


def outcome_per_class(spine: DataFrame, events: DataFrame, key: str, classes: Mapping[str, Sequence[str]], hours: float, column: str = "event_type") -> DataFrame:
    """(key, y, first time per class) of events in [t0, t0 + hours]; the window is part of the left join."""
    every = [x for ids in classes.values() for x in ids]
    joined = window_join(spine.select(key, "t0"), events.where(F.col(column).isin(*every)).select(key, "ts", column), key, 0, hours, closed="[]", how="left")
    firsts = [F.min(F.when(F.col(column).isin(*ids), F.col("ts"))).alias(f"first_{name}") for name, ids in classes.items()]
    return joined.groupBy(key).agg(F.max(F.col(column).isNotNull().cast("int")).alias("y"), *firsts)


def clean_times(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose start is not after their end; rows with an unknown time go (three-valued NOT)."""
    return frame.where(~(F.col(start) > F.col(end)))


def time_alignment(frame: DataFrame, start: str, end: str) -> DataFrame:
    """One row: how many starts lie after the end, and the hours in between."""
    hours = hours_between(F.col(end), F.col(start))
    late = F.when(hours < 0, -hours)
    return frame.agg(F.count("*").alias("n"), F.count(late).alias("n_late"), F.min(late).alias("late_min"), F.avg(late).alias("late_mean"), F.max(late).alias("late_max"))


def baseline(spine: DataFrame, events: DataFrame, key: str, lookback_hours: float, grace_hours: float, measures: Mapping[str, str], item: str = "event_type", value: str = "value", tiebreak: str = "event_id") -> DataFrame:
    """Wide covariates: per item the last non-NULL value in [t0 - lookback, t0 + grace], and has_ flags."""
    wanted = events.where(F.col(item).isin(*measures.values())).select(key, "ts", item, value, tiebreak)
    joined = window_join(spine.select(key, "t0"), wanted, key, -lookback_hours, grace_hours, closed="[]")
    per = last_per_column(joined, key, "ts", tiebreak, {n: F.when(F.col(item) == i, F.col(value)) for n, i in measures.items()})
    out = spine.select(key).join(per, key, "left")
    return out.withColumns({f"has_{n}": has(F.col(n)) for n in measures})


def early_values(spine: DataFrame, events: DataFrame, key: str, hours: float, items: Sequence[str], how: str = "first", item: str = "event_type", value: str = "value", tiebreak: str = "event_id") -> DataFrame:
    """One column per item (static pivot): the first or the mean value in [t0, t0 + hours); absent items are NULL."""
    joined = window_join(spine.select(key, "t0"), events.select(key, "ts", item, value, tiebreak), key, 0, hours)
    one = F.min_by(value, F.struct("ts", tiebreak)) if how == "first" else F.avg(value)
    return spine.select(key).join(joined.groupBy(key).pivot(item, list(items)).agg(one), key, "left")


def anthropometrics(spine: DataFrame, weights: DataFrame, heights: DataFrame, key: str) -> DataFrame:
    """(key, kg, cm, bmi): the first-day weight, else the first one; the first height. weights: key, ts, value, event_id."""
    order = F.struct("ts", "event_id")
    w = spine.select(key, "t0").join(weights.select(key, "ts", "value", "event_id"), key)
    day = in_window(F.col("ts"), F.col("t0"), 0, 24)
    w = w.groupBy(key).agg(F.coalesce(F.min_by(F.when(day, F.col("value")), F.when(day, order)), F.min_by("value", order)).alias("kg"))
    h = heights.groupBy(key).agg(F.min_by("value", order).alias("cm"))
    return spine.select(key).join(w, key, "left").join(h, key, "left").withColumn("bmi", bmi(F.col("kg"), F.col("cm")))


def canonical_items(candidates: DataFrame, counts: DataFrame, name: str, item: str) -> DataFrame:
    """(name, item, n): of each name's candidate items the one with most events; ties to the least item."""
    best = F.min(F.struct(F.col("n").isNull().alias("none"), (-F.col("n")).alias("less"), F.col(item).alias("item"), F.col("n").alias("n")))  # a name's candidates are no task's rows
    return candidates.join(counts, item).groupBy(name).agg(best.alias("__best")).select(name, F.col("__best.item").alias(item), F.col("__best.n").alias("n"))


def item_coverage(spine: DataFrame, events: DataFrame, key: str, item: str, value: str, low_hours: float, high_hours: float) -> DataFrame:
    """(item, coverage, avg_measures, min_value, max_value): share of the spine that has the item in its window."""
    joined = window_join(spine.select(key, "t0"), events.select(key, "ts", item, value), key, low_hours, high_hours)
    total = spine.agg(F.count_distinct(key).alias("__units"))
    per = joined.groupBy(item).agg(F.count_distinct(key).alias("__with"), F.count("*").alias("__n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    per = per.crossJoin(F.broadcast(total))
    return per.select(item, (F.col("__with") / F.col("__units")).alias("coverage"), (F.col("__n") / F.col("__with")).alias("avg_measures"), "min_value", "max_value")


def design_sweep(measures: DataFrame, exposures: DataFrame, key: str, thresholds: Sequence[float], hours: Sequence[float]) -> DataFrame:
    """(threshold, hours, eligible, treated, control, treated_share) of every design, in one job.

    Eligible: the first measure above the threshold; treated: an exposure within hours of it. The grid is a literal.
    """
    spark = measures.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    start = measures.crossJoin(F.broadcast(grid)).where(F.col("value") > F.col("threshold")).groupBy(key, "threshold").agg(F.min("ts").alias("t0"))
    e = exposures.select(F.col(key).alias("__key"), "ts")
    soon = (F.col(key) == F.col("__key")) & (F.col("ts") >= F.col("t0")) & (hours_between(F.col("ts"), F.col("t0")) < float(max(hours)))
    next_ = start.join(e, soon, "left").groupBy(key, "threshold", "t0").agg(F.min(hours_between(F.col("ts"), F.col("t0"))).alias("wait"))
    windows = F.broadcast(spark.createDataFrame([(float(h),) for h in hours], "hours double"))
    out = next_.crossJoin(windows).groupBy("threshold", "hours").agg(F.count("*").alias("eligible"), F.count(F.when(F.col("wait") < F.col("hours"), 1)).alias("treated"))
    return out.withColumn("control", F.col("eligible") - F.col("treated")).withColumn("treated_share", F.col("treated") / F.col("eligible"))


def co_interventions(controls: DataFrame, events: DataFrame, key: str, classes: Sequence[str], hours: float, column: str = "event_type") -> DataFrame:
    """(class, n_with, n_controls, share): how many controls have an event of each class in [t0, t0 + hours)."""
    joined = window_join(controls.select(key, "t0"), events.where(F.col(column).isin(*classes)).select(key, "ts", column), key, 0, hours)
    per = joined.groupBy(F.col(column).alias("class")).agg(F.count_distinct(key).alias("n_with"))
    names = controls.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    out = left_with_defaults(names, per, "class", {"n_with": 0})
    return out.crossJoin(F.broadcast(controls.agg(F.count("*").alias("n_controls")))).withColumn("share", F.try_divide(F.col("n_with"), F.col("n_controls")))


def skeleton(cohort: DataFrame, treatment: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(ids, outcome and treatment per unit; one row: units, with treatment, missing)."""
    out = cohort.join(treatment, key, "left")
    return out, out.agg(F.count("*").alias("n_units"), F.count("treated").alias("n_assigned"), F.count(F.when(F.col("treated").isNull(), 1)).alias("n_missing"))


def clip_and_flag(frame: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Columns clipped to hard bounds, with has_ flags."""
    out = frame.withColumns({c: clip(F.col(c), low, high) for c, (low, high) in bounds.items()})
    return out.withColumns({f"has_{c}": has(F.col(c)) for c in bounds})
