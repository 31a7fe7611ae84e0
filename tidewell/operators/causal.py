"""Causal estimation on one scored frame: splits, weights, balance, effects, calibration, bootstrap.

Frames carry an id, t and y (0/1) and the nuisance columns ps, m1, m0 by name; nothing depends on row order. Scalars
that all rows need (means, quantiles) are one-row aggregates joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.functions.scalar import NUMBER, clip, finite
from tidewell.functions.uniform import drawn, poisson_counts, uniform
from tidewell.operators.ranks import numbered, quantiles, running
from tidewell.sources.tables import cut

EPS = 1e-12


def beside(frame: DataFrame, *aggs: Column) -> DataFrame:
    """Whole-table aggregates (one row) beside every row."""
    return frame.crossJoin(F.broadcast(frame.agg(*aggs)))


# --- roles and splits ---------------------------------------------------------------------------

# Parts of names that mark identifiers.
ID_LIKE = ("_id", "id_", "uuid", "key")


def feature_roles(frame: DataFrame, reserved: Sequence[str], drop: Sequence[str] = (), least_parsed: float = 0.95) -> DataFrame:
    """(column, role): numeric, categorical or dropped.

    Reserved columns, the drop list, datetimes and id-like names are dropped; booleans and texts are
    categorical, but for texts of which at least 95 % of the non-NULL values read as numbers.
    """
    kinds = dict(frame.dtypes)
    texts = [c for c, t in kinds.items() if t == "string"]
    parsed = frame.agg(F.lit(0).alias("_"), *[F.avg(F.col(c).rlike(NUMBER).cast("int")).alias(c) for c in texts]).first()

    def role(c: str) -> str:
        if c in reserved or c in drop or kinds[c].startswith(("date", "timestamp")) or any(p in c.lower() for p in ID_LIKE):
            return "dropped"
        if kinds[c] == "boolean" or (kinds[c] == "string" and (parsed[c] or 0) < least_parsed):
            return "categorical"
        return "numeric"

    return frame.sparkSession.createDataFrame([(c, role(c)) for c in kinds], "column string, role string")


def split_by_subject(frame: DataFrame, subject: str, seed: int = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Adds split (train, val, test); a subject is in one of them. Subjects are ranked by a seeded hash and cut at shares of their number."""
    subjects = frame.select(subject).distinct().withColumn("u", uniform(seed, F.col(subject)))
    ranked = numbered(subjects, "u", subject)
    n = F.col("__n")
    part = F.when(F.col("__rank") <= F.round(n * train), "train").when(F.col("__rank") <= F.round(n * (train + validation)), "val").otherwise("test")
    return frame.join(ranked.select(subject, part.alias("split")), subject)


def k_folds(frame: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1 in turn by a seeded hash rank: sizes differ by one at most."""
    ranked = numbered(frame.select(key).withColumn("u", uniform(seed, F.col(key))), "u", key)
    return frame.join(ranked.select(key, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias("fold")), key)


def row_ids(frame: DataFrame, *order: str, start: int = 1) -> DataFrame:
    """Adds row_id by a stable order: consecutive numbers over a range-partitioned sort."""
    ranked = numbered(frame, *order)
    return ranked.select(*frame.columns, (F.col("__rank") - 1 + start).alias("row_id"))


def stratum_scores(frame: DataFrame, strata: Sequence[str], t: str = "t", y: str = "y") -> DataFrame:
    """Closed-form nuisances: ps, m1, m0 as means within strata (an arm that a stratum lacks takes its overall mean), tau = m1 - m0."""
    one, none = F.when(F.col(t) == 1, F.col(y)), F.when(F.col(t) == 0, F.col(y))
    per = frame.groupBy(*strata).agg(F.avg(t).alias("ps"), F.avg(one).alias("m1"), F.avg(none).alias("m0"))
    overall = frame.agg(F.avg(one).alias("__m1"), F.avg(none).alias("__m0"))
    out = frame.join(per, list(strata)).crossJoin(F.broadcast(overall))
    out = out.withColumns({"m1": F.coalesce("m1", "__m1"), "m0": F.coalesce("m0", "__m0")}).drop("__m1", "__m0")
    return out.withColumn("tau", F.col("m1") - F.col("m0"))


# --- binning, encoding, scaling -----------------------------------------------------------------


def quantile_bins(frame: DataFrame, column: str, n_bins: int, name: str = "bin") -> DataFrame:
    """Adds a quantile bin from 0: right-closed, the least value included, repeated edges dropped; NULL values get NULL."""
    edges = quantiles(frame, column, [i / n_bins for i in range(n_bins + 1)], name="__edges").select(F.array_distinct("__edges").alias("__edges"))
    inner = F.slice("__edges", F.lit(2), F.greatest(F.size("__edges") - 2, F.lit(0)))
    number = F.size(F.filter(inner, lambda e: e < F.col(column)))
    return frame.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), number)).drop("__edges")


def one_hot(frame: DataFrame, column: str, values: Sequence[str], drop_first: bool = False) -> DataFrame:
    """A 0/1 column per value; unknown and NULL values are 0 throughout."""
    return frame.withColumns({f"{column}={v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values[int(drop_first) :]})


def group_impute(frame: DataFrame, columns: Sequence[str], t: str = "t", y: str = "y") -> DataFrame:
    """NULLs by the (t, y) group's mean, else the column's mean, else 0; non-finite values count as NULL."""
    clean = frame.withColumns({c: finite(F.col(c)) for c in columns})
    per = clean.groupBy(t, y).agg(*[F.avg(c).alias(f"__g_{c}") for c in columns])
    every = clean.agg(*[F.avg(c).alias(f"__a_{c}") for c in columns])
    out = clean.join(F.broadcast(per), [t, y], "left").crossJoin(F.broadcast(every))  # four groups at most
    return out.withColumns({c: F.coalesce(c, f"__g_{c}", f"__a_{c}", F.lit(0.0)) for c in columns}).drop(*[f"__{k}_{c}" for k in "ga" for c in columns])


def min_max(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in [0, 1]; constant ones and ones without a finite value are 0, as are missing values."""
    clean = frame.withColumns({c: finite(F.col(c)) for c in columns})
    out = beside(clean, *[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.coalesce(F.when(F.col(f"__hi_{c}") - F.col(f"__lo_{c}") >= EPS, clip((F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}") + EPS), 0.0, 1.0)), F.lit(0.0)) for c in columns}
    return out.withColumns(scaled).drop(*[f"__{k}_{c}" for k in ("lo", "hi") for c in columns])


def mode_fill(frame: DataFrame, column: str) -> DataFrame:
    """NULLs by the most frequent value (least of equals), then int."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    top = counts.agg(F.max_by(column, F.struct("n", -F.col(column))).alias("__mode"))
    return frame.crossJoin(F.broadcast(top)).withColumn(column, F.coalesce(column, "__mode").cast("int")).drop("__mode")


# --- weights ------------------------------------------------------------------------------------


def clip_ps(ps: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return clip(ps, low, high)


def iptw(frame: DataFrame, ps: Column, t: str = "t", name: str = "w") -> DataFrame:
    """Stabilised weights P(T) / P(T | X)."""
    p = F.col("__p")
    weight = F.when(F.col(t) == 1, p / ps).otherwise((1 - p) / (1 - ps))
    return beside(frame, F.avg(t).alias("__p")).withColumn(name, weight).drop("__p")


def overlap_weight(ps: Column, t: Column) -> Column:
    return F.when(t == 1, 1 - ps).otherwise(ps)


def trim_to_quantiles(frame: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Clips a column to its own quantiles."""
    out = frame.crossJoin(F.broadcast(quantiles(frame, column, [low, high], name="__q")))  # one row
    return out.withColumn(column, clip(F.col(column), F.get("__q", F.lit(0)), F.get("__q", F.lit(1)))).drop("__q")


def ess(w: Column) -> Column:
    return F.pow(F.sum(w), F.lit(2.0)) / (F.sum(w * w) + EPS)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / (F.sum(w) + EPS)


def ate(y: Column, t: Column, w: Column) -> Column:
    """Difference of weighted means."""
    arm = lambda a: F.sum(F.when(t == a, w * y)) / (F.sum(F.when(t == a, w)) + EPS)
    return arm(1) - arm(0)


# --- balance ------------------------------------------------------------------------------------


def smd_table(frame: DataFrame, features: Sequence[str], t: str = "t", w: str | None = None, mode: str = "population", max_features: int | None = None) -> DataFrame:
    """(feature, smd_pre, smd_post): standardised mean differences, unweighted and weighted, the largest |smd_pre| first.

    population: population variances + 1e-12; sample: sample variances, 0 where the pooled sd is 0. Only
    finite values count; a feature without values in an arm is NULL. max_features: so many of the features given, in their
    order. Two passes over the rows as they are: means, then moments per arm about them.
    """
    features = list(features)[:max_features]
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = frame.where(F.col(t).isin(0, 1)).select(F.col(t).alias("t"), weight.alias("w"), *[finite(F.col(c)).alias(f"x{i}") for i, c in enumerate(features)])
    rows = beside(rows, *[F.avg(f"x{i}").alias(f"c{i}") for i in range(len(features))])
    moments = []
    for i in range(len(features)):
        x, has = F.col(f"x{i}") - F.col(f"c{i}"), F.when(F.col(f"x{i}").isNotNull(), F.col("w"))
        all_ = F.sum(has) + EPS
        moments.append(F.struct(F.lit(features[i]).alias("feature"), F.avg(x).alias("m"), (F.var_pop(x) if mode == "population" else F.var_samp(x)).alias("v"), (F.sum(has * x) / all_).alias("wm"), (F.sum(has * x * x) / all_).alias("w2"), F.sum(has).alias("sw")))
    sums = rows.groupBy("t").agg(F.array(*moments).alias("r")).select("t", F.explode("r").alias("r")).select("t", "r.*").where("m is not null")
    side = lambda a: sums.where(F.col("t") == a).select("feature", *[F.col(c).alias(f"{c}{a}") for c in ("m", "v", "wm", "w2", "sw")])
    both = side(1).join(side(0), "feature", "full_outer")
    # the variance about the weighted mean mu is E[x^2] - 2 mu E[x] + mu^2 E[1], with E over sw / (sw + eps)
    var = lambda a: F.col(f"w2{a}") - 2 * F.col(f"wm{a}") * F.col(f"wm{a}") + F.pow(f"wm{a}", F.lit(2.0)) * F.col(f"sw{a}") / (F.col(f"sw{a}") + EPS)
    if mode == "population":
        pre = (F.col("m1") - F.col("m0")) / F.sqrt(0.5 * (F.col("v1") + F.col("v0")) + EPS)
    else:
        sd = F.sqrt(0.5 * (F.col("v1") + F.col("v0")))
        pre = F.when(sd == 0, 0.0).otherwise((F.col("m1") - F.col("m0")) / sd)
    post = F.when((F.col("sw1") > 0) & (F.col("sw0") > 0), (F.col("wm1") - F.col("wm0")) / F.sqrt(0.5 * (F.greatest(var(1), F.lit(0.0)) + F.greatest(var(0), F.lit(0.0))) + EPS))
    out = both.select("feature", pre.alias("smd_pre"), (post if w else F.lit(None).cast("double")).alias("smd_post"))
    return out.orderBy(F.abs("smd_pre").desc_nulls_last(), "feature")


def balance_summary(smd: DataFrame, column: str = "smd_post", top_k: int = 10) -> DataFrame:
    """One row: largest |SMD|, the shares above 0.1 and 0.2, and the names of the top_k features by |SMD|, comma-joined."""
    a = F.abs(column)
    ranked = F.slice(F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct((-a).alias("o"), "feature")))), 1, top_k)  # one entry a feature
    top = F.array_join(F.transform(ranked, lambda r: r["feature"]), ",")
    return smd.agg(F.count(column).alias("n_features"), F.max(a).alias("max_abs_smd"), F.avg((a > 0.1).cast("int")).alias("frac_gt_01"), F.avg((a > 0.2).cast("int")).alias("frac_gt_02"), top.alias("top"))


_POINTS = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def ps_overlap(frame: DataFrame, ps: str = "ps", t: str = "t", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows all, treated, control: n, quantiles, shares outside the clip range; possible_separation on each."""
    arms = frame.select(ps, F.explode(F.array(F.lit("all"), F.when(F.col(t) == 1, "treated").otherwise("control"))).alias("arm"))
    per = arms.groupBy("arm").agg(F.count("*").alias("n"), F.avg((F.col(ps) < low).cast("int")).alias("frac_below"), F.avg((F.col(ps) > high).cast("int")).alias("frac_above"))
    per = per.join(quantiles(arms, ps, list(_POINTS.values()), ["arm"]), "arm", "left")
    apart = per.agg(F.coalesce((F.max(F.when(F.col("arm") == "treated", F.get("q", F.lit(1)))) > 0.8) & (F.max(F.when(F.col("arm") == "control", F.get("q", F.lit(3)))) < 0.2), F.lit(False)).alias("possible_separation"))
    return per.crossJoin(F.broadcast(apart)).select("arm", "n", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(_POINTS)], "frac_below", "frac_above", "possible_separation")


def weights_summary(frame: DataFrame, w: str = "w") -> DataFrame:
    """One row: n, ess, ess_ratio, quantiles, min, mean, sd (population), max of finite weights."""
    x = finite(F.col(w))
    q = F.broadcast(quantiles(frame, x, (0.5, 0.9, 0.95, 0.99)))
    one = frame.agg(F.count(x).alias("n"), ess(x).alias("ess"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.max(x).alias("max")).crossJoin(q)
    return one.select("n", "ess", F.try_divide(F.col("ess"), F.col("n")).alias("ess_ratio"), *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))], "min", "mean", "sd", "max")


def auc(frame: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve with ties counted half, exact.

    Scores are first summed up to distinct values; ranks come from counts over ranges of them.
    """
    per = frame.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n"))
    rank = F.col("__below") + (F.col("n") + 1) / 2.0
    one = running(per, [], "s", "n").agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return one.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


# --- effects ------------------------------------------------------------------------------------


def pseudo_outcome(y: Column, t: Column, ps: Column, m1: Column, m0: Column) -> Column:
    """Doubly-robust pseudo-outcome."""
    return m1 - m0 + t * (y - m1) / ps - (1 - t) * (y - m0) / (1 - ps)


def phi_summary(frame: DataFrame, phi: str = "phi", ps: str = "ps", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: n, share of clipped propensities, mean, sd, p01, p50, p99 of the pseudo-outcome."""
    q = F.broadcast(quantiles(frame, phi, (0.01, 0.5, 0.99)))
    outside = ((F.col(ps) < low) | (F.col(ps) > high)).cast("int")
    one = frame.agg(F.count("*").alias("n"), F.avg(outside).alias("clip_share"), F.avg(phi).alias("mean"), F.stddev_samp(phi).alias("sd")).crossJoin(q)
    return one.select("n", "clip_share", "mean", "sd", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p01", "p50", "p99"))])


def calibration_table(frame: DataFrame, n_bins: int = 10, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per quantile bin of tau: n, arms, tau mean and quantiles, raw difference, overlap-weighted effect and its ESS.

    Bins with one arm only have NULL effects. Columns: tau, t, y, ps.
    """
    binned = quantile_bins(frame.withColumn("__w", overlap_weight(clip_ps(F.col("ps"), low, high), F.col("t"))), "tau", n_bins)
    t, y = F.col("t"), F.col("y")
    per = binned.groupBy("bin").agg(
        F.count("*").alias("n"), F.sum((t == 1).cast("bigint")).alias("n_treated"), F.sum((t == 0).cast("bigint")).alias("n_control"), F.avg("tau").alias("tau_mean"),
        (F.avg(F.when(t == 1, y)) - F.avg(F.when(t == 0, y))).alias("diff_unweighted"), ate(y, t, F.col("__w")).alias("ate_ato"), ess(F.col("__w")).alias("ess_ato"),
    )
    at = quantiles(binned, "tau", (0.1, 0.5, 0.9), ["bin"])
    per = per.alias("p").join(at.alias("q"), F.col("p.bin").eqNullSafe(F.col("q.bin")), "left").select("p.*", "q.q")
    both = (F.col("n_treated") > 0) & (F.col("n_control") > 0)
    return per.select("bin", "n", "n_treated", "n_control", "tau_mean", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("tau_p10", "tau_p50", "tau_p90"))], "diff_unweighted", F.when(both, F.col("ate_ato")).alias("ate_ato"), F.when(both, F.col("ess_ato")).alias("ess_ato"))


def cate_vs_ate(frame: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: naive, IPW and DR effect with its standard error, tau's spread, heterogeneity and bias signals."""
    t, y, e, m1, m0 = F.col("t"), F.col("y"), clip_ps(F.col("ps"), low, high), F.col("m1"), F.col("m0")
    dr = m1 - m0 + t * (y - m1) / (e + EPS) - (1 - t) * (y - m0) / (1 - e + EPS)
    ipw = t * y / (e + EPS) - (1 - t) * y / (1 - e + EPS)
    one = frame.agg(
        (F.avg(F.when(t == 1, y)) - F.avg(F.when(t == 0, y))).alias("naive_ate"), F.avg(ipw).alias("ipw_ate"), F.avg(dr).alias("dr_ate"), (F.stddev_samp(dr) / F.sqrt(F.count("*"))).alias("dr_ate_se"),
        F.avg("tau").alias("mean_tau"), F.stddev_samp("tau").alias("sd_tau"), F.avg((F.col("tau") < 0).cast("int")).alias("frac_benefit"),
    ).crossJoin(F.broadcast(quantiles(frame, "tau", (0.05, 0.95))))
    derived = {"p05_tau": F.get("q", F.lit(0)), "p95_tau": F.get("q", F.lit(1)), "het_snr": F.col("sd_tau") / (F.abs("dr_ate") + 1e-9), "bias_reduction": F.col("naive_ate") - F.col("dr_ate")}
    return one.withColumns(derived).drop("q")


# --- bootstrap ----------------------------------------------------------------------------------


def multiplicities(key: str, n_boot: int, seed: int = 42) -> Column:
    """How often a row is in each of n_boot resamples: an array of Poisson(1) counts, replicate by replicate. Each draw is worked out once."""
    return poisson_counts(seed, F.col(key), n_boot)


def spread(frame: DataFrame, key: str, *columns: Column) -> DataFrame:
    """key and the columns, dealt by key to as many partitions as a shuffle has.

    Drawing costs far more than moving a narrow row; a scan may have few partitions, and what is small in bytes is not merged again.
    """
    return frame.select(key, *columns).repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def resampled_sums(frame: DataFrame, by: Sequence[str], counts: Column, measures: Mapping[str, Column], whole: bool = True) -> DataFrame:
    """(by, rep, k, measures): per group and replicate the rows drawn and the sums of k times each measure; replicates count from 1.

    whole: counts are whole numbers, and so is k (the vectors' sums are means times weights, right to the last digits only).
    A row adds to all replicates at once, as a vector: no row is repeated, tasks add their vectors up first, and what is
    shuffled is one vector for each task and group. NULL measures add nothing.
    """
    names = ["k", *measures]
    held = frame.select(*by, counts.alias("__k"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__v{i}") for i, c in enumerate(measures.values())])
    times = lambda v: F.transform("__k", lambda k: k * v)
    wide = F.concat(times(F.lit(1.0)), *[times(F.col(f"__v{i}")) for i in range(len(measures))])
    n = F.lit(len(names))
    total = vector_to_array(Summarizer.sum(array_to_vector(wide)))
    per = held.groupBy(*by, F.lit(0).alias("__all")).agg(total.alias("__s")).withColumn("__b", F.floor(F.size("__s") / n).cast("int"))
    each = F.transform(F.sequence(F.lit(1), F.col("__b")), lambda r: F.struct(r.alias("rep"), *[F.get("__s", r - 1 + F.col("__b") * i).alias(c) for i, c in enumerate(names)]))
    out = per.select(*by, F.explode(each).alias("__r")).select(*by, "__r.*")
    return out.withColumn("k", F.round("k")) if whole else out


def drawn_sums(frame: DataFrame, key: str, n_boot: int, seed: int, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """resampled_sums of multiplicities(key, n_boot, seed): the same hashes and counts, drawn in the tasks as matrices.

    A task draws for some thousand rows at a time and adds them up, so that no row ever holds an array of its counts; what is
    shuffled is one row for each task, group and replicate. For few groups.
    """
    by, names = list(by), ["k", *measures]
    prefix = F.concat(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), F.lit(":"))
    rows = frame.select(*by, prefix.cast("binary").alias("__prefix"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__v{i}") for i, c in enumerate(measures.values())])
    values = [f"__v{i}" for i in range(len(measures))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            held = np.array(batch.column("__prefix").to_pylist(), "S")
            group = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True)) if by else [()] * len(held)
            place = {g: i for i, g in enumerate(dict.fromkeys(group))}
            of = np.array([place[g] for g in group], int)
            wide = np.vstack([np.ones(len(held)), *[batch.column(c).to_numpy(zero_copy_only=False) for c in values]])
            for rows, counts in drawn(held, n_boot):
                for g, i in place.items():
                    own = of[rows] == i
                    if own.any():
                        total[g] = total.get(g, 0.0) + np.einsum("mr,nr->mn", wide[:, rows[own]], counts[:, own].astype(float))  # in this thread, unlike @
        for g, sums in total.items():
            columns = [pa.array([x] * n_boot, kind) for x, kind in zip(g, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(1, n_boot + 1), pa.int32()), *[pa.array(x) for x in sums]], names=[*by, "rep", *names])

    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("rep", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    return rows.mapInArrow(summed, schema).groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in names])


def interval(frame: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """One row over replicates: n_boot, mean, sd, ci_lo, ci_hi."""
    q = F.percentile(column, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    one = frame.agg(F.count(column).alias("n_boot"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), q.alias("q"))
    return one.select("n_boot", "mean", "sd", F.get("q", F.lit(0)).alias("ci_lo"), F.get("q", F.lit(1)).alias("ci_hi"))


#: Bins of the propensity in which the places of trimming bounds are counted first.
PS_BINS = 1024


def _trim_bounds(cells: DataFrame, share: DataFrame, points: Sequence[float]) -> DataFrame:
    """(rep, q): the exact quantiles of each replicate's weights. cells: t, e, k (array of counts); share: rep, p, n.

    All replicates share one order of propensities: within an arm a weight is monotone in e, whatever the replicate's p.
    Counts by arm and bin of e, as vectors, enclose each bound; only the cells of the few bins that meet the enclosure are
    then looked at one by one.
    """
    width = 1.0 / PS_BINS
    binned = cells.withColumn("bin", F.least(F.floor(F.col("e") * PS_BINS), F.lit(PS_BINS - 1)).cast("int"))
    p, t = F.col("p"), F.col("t")
    weight = lambda e: F.when(t == 1, p / e).otherwise((1 - p) / (1 - e))
    edge = lambda e: F.least(F.greatest(e, F.lit(1e-300)), F.lit(1 - 1e-16))
    low, high = edge(F.col("bin") * width), edge((F.col("bin") + 1) * width)
    counts = resampled_sums(binned, ["t", "bin"], F.col("k"), {}).where("k > 0").join(F.broadcast(share), "rep")
    # a little wider than the bin, so that no rounding leaves a weight outside
    counts = cut(counts.withColumns({"lo": F.least(weight(low), weight(high)) * (1 - 1e-9), "hi": F.greatest(weight(low), weight(high)) * (1 + 1e-9)}))
    place = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(x)).alias("x")) for j, x in enumerate(points)])).alias("__p")
    wanted = share.select("rep", "n", place).select("rep", F.col("__p.j").alias("j"), (F.col("__p.x") * (F.col("n") - 1)).alias("at"))
    up_to = lambda c: F.sum("k").over(Window.partitionBy("rep").orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    sums = counts.select("rep", "lo", "hi", up_to("lo").alias("most"), up_to("hi").alias("least"))
    per = sums.join(F.broadcast(wanted), "rep").groupBy("rep", "j", "at").agg(F.min(F.when(F.col("most") > F.floor("at"), F.col("lo"))).alias("from"), F.min(F.when(F.col("least") > F.ceil("at"), F.col("hi"))).alias("to"))
    near = counts.join(F.broadcast(per), "rep")
    before = near.groupBy("rep", "j", "at").agg(F.sum(F.when(F.col("hi") < F.col("from"), F.col("k")).otherwise(0.0)).alias("before"))
    bins = near.where("hi >= from and lo <= to").select("rep", "j", "at", "t", "bin", "p")
    few = binned.select("t", "e", "bin", "k").join(F.broadcast(bins), ["t", "bin"]).withColumn("n", F.get("k", F.col("rep") - 1)).where("n > 0")
    few = few.groupBy("rep", "j", "at", weight(F.col("e")).alias("w")).agg(F.sum("n").alias("n")).join(F.broadcast(before), ["rep", "j", "at"])
    inside = Window.partitionBy("rep", "j").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("below", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    here = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col("w")))
    found = few.groupBy("rep", "j", "at").agg(here(F.floor("at")).alias("a"), here(F.ceil("at")).alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    q = F.transform(F.sort_array(F.collect_list(F.struct("j", between.alias("v")))), lambda r: r["v"])
    return found.groupBy("rep").agg(q.alias("q"))


def bootstrap_effects(frame: DataFrame, key: str, n_boot: int, seed: int = 42, trim: tuple[float, float] | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(rep, iptw, ato): effects per replicate with a fixed propensity; P(T) and the trimming bounds are the replicate's own.

    Effects depend on (t, y, e) alone: rows are summed up to these cells, each with an array of its counts.
    """
    k = F.transform(vector_to_array(Summarizer.sum(array_to_vector(multiplicities(key, n_boot, seed)))), lambda n: F.round(n))
    rows = spread(frame, key, F.col("t"), F.col("y"), clip_ps(F.col("ps"), low, high).alias("e"))
    cells = cut(rows.groupBy("t", "y", "e").agg(k.alias("k")))
    t, y, e = F.col("t"), F.col("y"), F.col("e")
    whole = resampled_sums(cells, [], F.col("k"), {"n1": t}).where("k > 0")
    share = cut(whole.select("rep", (F.col("n1") / F.col("k")).alias("p"), F.col("k").alias("n")))
    if trim:
        share = share.join(_trim_bounds(cells, share, trim), "rep").select("rep", "p", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    # the replicates' numbers as one row, in the order of the counts
    plan = share.agg(F.map_from_entries(F.collect_list(F.struct("rep", F.struct(*[c for c in share.columns if c != "rep"])))).alias("__plan"))
    rows = cells.crossJoin(F.broadcast(plan))

    def weighed(n: Column, i: Column) -> Column:
        own = F.try_element_at("__plan", i + 1)
        w = F.when(t == 1, own["p"] / e).otherwise((1 - own["p"]) / (1 - e))
        return F.coalesce(n * (clip(w, own["lo"], own["hi"]) if trim else w), F.lit(0.0))

    sums = lambda name, counts: resampled_sums(rows, ["t"], counts, {"y": y}, whole=False).select("rep", *[F.col(c).alias(f"{name}_{c}") for c in ("k", "y")], "t")
    both = sums("iptw", F.transform("k", weighed)).join(sums("ato", F.transform("k", lambda n: n * overlap_weight(e, t))), ["rep", "t"])
    arm = lambda name, a: F.sum(F.when(t == a, F.col(f"{name}_y"))) / (F.sum(F.when(t == a, F.col(f"{name}_k"))) + EPS)
    effects = both.groupBy("rep").agg(*[(arm(name, 1) - arm(name, 0)).alias(name) for name in ("iptw", "ato")])
    return effects.join(share.select("rep"), "rep", "left_semi")
