"""Fitted nuisances and effects: propensity, outcome and effect models, cross-fitting, AIPW, DR-learner.

All are Spark ML's boosted trees, at every size. Such trees split a number at a few borders of bins only. So numbers are
binned first, and rows are summed up to the cells of their bins and categories, once and stored; each fit reads the cells and
picks their weights: the rows outside a fold that is left out, an arm, a resample's Poisson multiplicities. A fit
then costs what its cells cost, not its rows. Fits do not depend on each other, so several run at once, each in
its own thread and scheduler pool (set spark.scheduler.mode to FAIR to let the pools share the cluster evenly).
Missing numbers are imputed by the median and flagged, because Spark's trees reject NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalar import finite, has
from tidewell.functions.uniform import once, poisson_counts, uniform
from tidewell.operators.causal import auc, clip_ps, k_folds, phi_summary, pseudo_outcome
from tidewell.operators.ranks import quantiles
from tidewell.sources.tables import shared_folder, stored

#: Boosting: depth, rounds, learning rate, least rows in a leaf (by weight), and how many cells (its square) are looked at for splits.
BOOSTING = {"maxDepth": 3, "maxIter": 400, "stepSize": 0.05, "minInstancesPerNode": 50, "maxBins": 128}
#: Bins of a numeric feature, as many as Spark's trees have by default.
BINS = 32
#: Fits that run at the same time, each with its own cached training points.
FITS_AT_ONCE = 8
#: Values of a table of cells' predictions that is sent to all tasks.
BROADCAST_VALUES = 2_000_000
#: Counts that one pass over the rows sums up per cell: replicates times folds.
COUNTS_AT_ONCE = 60
#: Rows of a partition of the assembled table: a round of boosting is one task for each partition and tree level.
PARTITION_ROWS = 200_000

_T = TypeVar("_T")


def together(spark: SparkSession, jobs: Sequence[Callable[[], _T]], at_once: int = FITS_AT_ONCE) -> list[_T]:
    """What the jobs return, in their order; up to at_once run at the same time, each in a scheduler pool of its own."""
    context = spark.sparkContext

    def pooled(i: int) -> _T:
        context.setLocalProperty("spark.scheduler.pool", f"fit-{i % at_once}")
        try:
            return jobs[i]()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPool(max(1, min(at_once, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(pooled), range(len(jobs)), chunksize=1)


def _prepared(frame: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return frame.withColumns({c: finite(F.col(c)) for c in numeric}).withColumns({f"__h_{c}": has(F.col(c)).cast("double") + 1 for c in numeric})


@dataclass(frozen=True)
class Features:
    """What a frame's features are made by: medians, bins and categories; columns: those that tell cells apart."""

    numeric: tuple[str, ...]
    medians: Mapping[str, float]
    indexing: PipelineModel
    assembling: PipelineModel
    columns: tuple[str, ...]


def _edges(rows: DataFrame, numeric: Sequence[str]) -> dict[str, tuple[float, list[float]]]:
    """Median and inner borders of the bins of each numeric column that has values.

    Borders are exact quantiles; a value that spans several has a bin of its own, and a column of at most BINS values
    keeps each.
    """
    if not numeric:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(numeric)]))
    values = rows.select(each.alias("__v")).select("__v.i", "__v.x").where("x is not null")
    points = [0.5, *[j / BINS for j in range(1, BINS)]]
    found = {r["i"]: r["q"] for r in quantiles(values, "x", points, ["i"], discrete=[False] + [True] * (BINS - 1)).collect()}
    near = [r["i"] for r in values.groupBy("i").agg(F.approx_count_distinct("x", 0.02).alias("n")).where(F.col("n") <= 2 * BINS).collect()]
    few = {r["i"]: sorted(set(r["v"])) for r in values.where(F.col("i").isin(near)).groupBy("i").agg(F.collect_set("x").alias("v")).collect()} if near else {}  # some 2 * BINS values each
    out = {}
    for i, (median, *q) in sorted(found.items()):
        if len(few.get(i, q + q)) <= BINS:
            edges = {(a + b) / 2 if a < (a + b) / 2 else b for a, b in pairwise(few[i])}
        else:
            edges = {*q, *[math.nextafter(a, math.inf) for a, b in pairwise(q) if a == b]}
        out[numeric[i]] = median, sorted(edges)
    return out


def features_of(frame: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Features:
    """Medians, bins and categories of a frame. A numeric column without any value is left out; every category is a feature."""
    rows = _prepared(frame, numeric)
    edges = _edges(rows, numeric)
    binned, indexed = [f"__b_{c}" for c in edges], [f"__s_{c}" for c in categorical]
    stages = [Bucketizer(splitsArray=[[-math.inf, *e, math.inf] for _, e in edges.values()], inputCols=[f"__v_{c}" for c in edges], outputCols=binned)] if edges else []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
    medians = {c: m for c, (m, _) in edges.items()}
    rows = _filled(rows, medians)
    indexing = Pipeline(stages=stages).fit(rows)
    flags = [f"__h_{c}" for c in numeric]
    hot = [OneHotEncoder(inputCols=indexed, outputCols=[f"__o_{c}" for c in categorical], handleInvalid="keep")] if categorical else []
    assembler = VectorAssembler(inputCols=binned + flags + [f"__o_{c}" for c in categorical], outputCol="__x", handleInvalid="keep")
    return Features(tuple(numeric), medians, indexing, Pipeline(stages=[*hot, assembler]).fit(indexing.transform(rows)), (*binned, *flags, *indexed))


def _filled(rows: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    return rows.withColumns({f"__v_{c}": F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()})


def gridded(frame: DataFrame, features: Features) -> DataFrame:
    """The frame with its cells' columns: bins, flags and categories as numbers, none of them null."""
    rows = features.indexing.transform(_filled(_prepared(frame, features.numeric), features.medians))
    # bins count from 1: Spark's search for splits looks at values other than 0, and guesses how many are 0
    return rows.withColumns({f"__b_{c}": F.col(f"__b_{c}") + 1 for c in features.medians}).drop(*[f"__v_{c}" for c in features.medians])


def assembled(frame: DataFrame, features: Features, numeric: Sequence[str], *keep: str) -> DataFrame:
    """The columns of keep and the features __x, stored, in partitions of bounded size."""
    rows = features.assembling.transform(gridded(frame, features)).select(*keep, "__x")
    return stored(rows.repartition(max(1, -(-frame.count() // PARTITION_ROWS))), "features")


def cells(rows: DataFrame, features: Features, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Rows of gridded summed up to their cells and by: these columns, the measures and the features __x, stored in one order.

    To trees that split at the bins' borders, rows of a cell and a label differ in nothing: one row with their number as its
    weight teaches the same. There are no more cells than combinations of bins and categories, whatever the number of rows.
    """
    keys = [*features.columns, *by]
    per = stored(rows.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()]), "counts")
    ordered = per.repartition(max(1, -(-per.count() // PARTITION_ROWS)), *keys).sortWithinPartitions(*keys)
    return stored(features.assembling.transform(ordered).select(*keys, *measures, "__x"), "cells")


def beside_cells(rows: DataFrame, per: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of gridded with the named columns of their cells; per has one row for each. Few cells are sent to all tasks."""
    per = stored(per.select(*keys, *names), "predicted")
    few = per.count() * (len(keys) + len(names)) <= BROADCAST_VALUES
    return rows.join(F.broadcast(per) if few else per, list(keys))


def fit(rows: DataFrame, label: str, weight: Column, logistic: bool = True, **boosting: float) -> Model:
    """Boosted trees on the rows of positive weight; an error unless both classes of a 0/1 label are there.

    A leaf has minInstancesPerNode rows at least, each counted as often as its weight.
    """
    used = rows.select("__x", F.col(label).cast("double").alias("__y"), weight.cast("double").alias("__w")).where("__w > 0 and __y is not null")
    total, classes = used.agg(F.sum("__w"), F.count_distinct("__y")).first()
    if not total or (logistic and classes != 2):
        raise ValueError(f"{label} has {classes} classes")
    options = BOOSTING | boosting
    leaf = min(options.pop("minInstancesPerNode") / total, 0.4999)
    shared_folder(rows.sparkSession)  # Spark cuts the rounds' lineage there
    kind = GBTClassifier if logistic else GBTRegressor
    return kind(featuresCol="__x", labelCol="__y", weightCol="__w", seed=42, minWeightFractionPerNode=leaf, checkpointInterval=25, **options).fit(used)


def predict(model: Model, rows: DataFrame, name: str) -> DataFrame:
    """Adds the probability of class 1, or the regression value."""
    out = model.setFeaturesCol("__x").transform(rows)
    value = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in out.columns else F.col("prediction")
    return out.withColumn(name, value).select(*rows.columns, name)


def fit_predict(train: DataFrame, test: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], name: str, logistic: bool = True, **boosting: float) -> DataFrame:
    """test with a column of predictions by a model of train: the probability of label 1, or the mean label if not logistic."""
    train = stored(train.select(*{label: None, **dict.fromkeys(numeric), **dict.fromkeys(categorical)}), "train")
    features = features_of(train, numeric, categorical)
    rows, y = gridded(train, features).where(F.col(label).isNotNull()), F.col(label).cast("double")
    if logistic or boosting.get("lossType", "squared") != "squared":
        taught = cells(rows.withColumn("__y", y), features, ["__y"], {"n": F.count("*")})
    else:  # squared losses of a cell's rows and of their mean differ by a constant
        taught = cells(rows, features, [], {"__y": F.avg(y), "n": F.count("*")})
    model = fit(taught, "__y", F.col("n"), logistic, **boosting)
    asked = gridded(test, features)
    places = cells(asked, features, [], {"n": F.count("*")})
    return beside_cells(asked, predict(model, places, name), features.columns, [name]).select(*[F.col(f"`{c}`") for c in test.columns], name)


#: The three nuisances: name, label, and the arm whose rows teach it.
_NUISANCES = (("ps", "t", None), ("m1", "y", 1), ("m0", "y", 0))


def _taught(cells: DataFrame, counts: Sequence[str], left_out: int, label: str, arm: int | None, **boosting: float) -> Model:
    """A nuisance's model of the rows of the other folds, of its arm. counts: the columns of rows per fold."""
    weight = sum((F.col(n) for i, n in enumerate(counts) if i != left_out), F.lit(0))
    return fit(cells, label, weight if arm is None else F.when(F.col("t") == arm, weight).otherwise(0), **boosting)


def _scored(rows: DataFrame, models: Sequence[Model]) -> DataFrame:
    """rows with ps, m1, m0 of a fold's three models, in the order of _NUISANCES."""
    for (name, *_), model in zip(_NUISANCES, models, strict=True):
        rows = predict(model, rows, name)
    return rows


def cross_fit(frame: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], k: int = 5, seed: int = 42, **boosting: float) -> DataFrame:
    """Adds fold and out-of-fold ps, m1, m0: each fold is predicted by models of the other folds. All 3k fits run together.

    The rows are read to sum them up to cells, and to give each its cell's predictions; the fits read cells.
    """
    rows = stored(k_folds(frame, key, k, seed), "rows")
    features = features_of(rows, numeric, categorical)
    rows = gridded(rows, features)
    counts = [f"n{f}" for f in range(k)]
    taught = cells(rows, features, ["t", "y"], {n: F.count_if(F.col("fold") == f) for f, n in enumerate(counts)})
    jobs = [lambda f=f, label=label, arm=arm: _taught(taught, counts, f, label, arm, **boosting) for f in range(k) for _, label, arm in _NUISANCES]
    models = together(frame.sparkSession, jobs)
    places = stored(taught.dropDuplicates(list(features.columns)).select(*features.columns, "__x"), "places")
    per = reduce(DataFrame.unionByName, [_scored(places, models[3 * f : 3 * f + 3]).withColumn("fold", F.lit(f)) for f in range(k)])
    return beside_cells(rows, per, [*features.columns, "fold"], ["ps", "m1", "m0"]).select(*frame.columns, "fold", "ps", "m1", "m0")


def aipw(scored: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row (ate, se) from cross-fitted nuisances."""
    phi = pseudo_outcome(F.col("y"), F.col("t"), clip_ps(F.col("ps"), low, high), F.col("m1"), F.col("m0"))
    return scored.select(phi.alias("phi")).agg(F.avg("phi").alias("ate"), (F.stddev_samp("phi") / F.sqrt(F.count("*"))).alias("se"))


def bootstrap_aipw(frame: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], n_boot: int, k: int = 2, seed: int = 42, **boosting: float) -> DataFrame:
    """(rep, ate): AIPW with all models fitted again on each resample.

    A resample is no copy: a row's Poisson multiplicity is its weight, and all its copies are in one fold. Rows are drawn for
    several replicates at once and summed up to cells, which the replicates' fits and effects read; they run
    together. Features (medians, bins, categories) are those of the whole frame.
    """
    rows = stored(frame.select(*dict.fromkeys([key, "t", "y", *numeric, *categorical])), "rows")
    features = features_of(rows, numeric, categorical)
    rows = gridded(rows, features)
    at_once = max(1, COUNTS_AT_ONCE // k)
    found = []
    for first in range(1, n_boot + 1, at_once):
        reps = range(first, min(first + at_once, n_boot + 1))
        folds = F.transform(F.sequence(F.lit(reps[0]), F.lit(reps[-1])), lambda r: F.floor(uniform(seed + 1, F.col(key), r) * k).cast("int"))
        drawn = rows.select(*features.columns, "t", "y", F.struct(poisson_counts(seed, F.col(key), reps[-1], reps[0]).alias("k"), folds.alias("fold")).alias("d"))
        drawn = drawn.select(*features.columns, "t", "y", once(F.col("d")).alias("d"))
        counts = {r: [f"n{r}_{f}" for f in range(k)] for r in reps}
        sums = {n: F.sum(F.when(F.get("d.fold", F.lit(r - first)) == f, F.get("d.k", F.lit(r - first))).otherwise(0)) for r in reps for f, n in enumerate(counts[r])}
        taught = cells(drawn, features, ["t", "y"], sums)

        def replicate(rep: int, taught: DataFrame = taught, counts: Mapping[int, Sequence[str]] = counts) -> tuple[int, float]:
            phi = pseudo_outcome(F.col("y"), F.col("t"), clip_ps(F.col("ps")), F.col("m1"), F.col("m0"))
            parts = []
            for f, n in enumerate(counts[rep]):
                models = [_taught(taught, counts[rep], f, label, arm, **boosting) for _, label, arm in _NUISANCES]
                parts.append(_scored(taught.select("t", "y", "__x", F.col(n).alias("k")).where("k > 0"), models))
            return rep, reduce(DataFrame.unionByName, parts).agg(F.sum(F.col("k") * phi) / F.sum("k")).first()[0]

        found += together(frame.sparkSession, [lambda r=r: replicate(r) for r in reps])
    return frame.sparkSession.createDataFrame(found, "rep int, ate double")  # a row for each replicate


def dr_learner(frame: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], k: int = 5, low: float = 0.01, high: float = 0.99, **boosting: float) -> tuple[DataFrame, DataFrame]:
    """(rows with ps, m1, m0, phi, tau; one row of diagnostics): effects regressed on the doubly-robust pseudo-outcome."""
    phi = pseudo_outcome(F.col("y"), F.col("t"), clip_ps(F.col("ps"), low, high), F.col("m1"), F.col("m0"))
    scored = stored(cross_fit(frame, key, numeric, categorical, k, **boosting).withColumn("phi", phi), "scored")
    return fit_predict(scored, scored, "phi", numeric, categorical, "tau", logistic=False, **boosting), phi_summary(scored, "phi", "ps", low, high)


def assignment_strength(frame: DataFrame, covariates: Sequence[str], t: str) -> DataFrame:
    """One row (auc) of a logistic fit of treatment on covariates."""
    rows = VectorAssembler(inputCols=list(covariates), outputCol="__x").transform(frame.dropna(subset=list(covariates)))
    fitted = LogisticRegression(featuresCol="__x", labelCol=t, maxIter=100).fit(rows).transform(rows)
    return auc(fitted.withColumn("__p", F.get(vector_to_array("probability"), F.lit(1))), "__p", t)
