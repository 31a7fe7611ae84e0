"""Toxicity severity by cumulative-link ordinal regression.

P(grade > k) = logistic(w.x - theta_k): one weight vector, ordered thresholds. The features are sparse:
whether a text has a word, or a word that begins with given 4, 5 or 7 bytes. The expected
severity, the sum of P(grade > k), decides which documents are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow_text import ALNUM, FOLD, long_view, run_hashes, runs, shingle_sets, slices
from tidewell.llm.shared import best_cut, cut, fresh_names, map_texts, replace_columns

#: Labelled rows that a fit takes, in expectation; the rows with the least hash of doc_id.
MOST_LABELS = 20_000
MOST_FEATURES = 4096
#: A feature's share among toxic and clean rows differs by at least so many standard errors: fewer are enough where at
#: least SURE of the rows that have it are toxic, as of a word that marks toxicity in a language of few rows.
LEAST_Z, LEAST_SURE_Z, SURE = 5.0, 4.0, 0.7
_PREFIXES = (7, 5, 4)
#: Parts of the labelled rows, each scored by a model of the others, that grade toxic rows.
FOLDS = 3


@dataclass(frozen=True)
class SeverityModel:
    """features: ascending 64-bit hashes; thresholds: one per step between grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def expected(self, z: np.ndarray) -> np.ndarray:
        return _logistic(z[:, None] - self.thresholds[None, :]).sum(axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _feature_hashes(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all words, then of all longer words' beginnings."""
    folded = FOLD[raw]
    start, end = runs(folded, offsets, ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    yield row, run_hashes(folded, start, end)
    for length in _PREFIXES:
        longer = end - start > length
        yield row[longer], run_hashes(folded, start[longer], start[longer] + length) ^ np.uint64(length)


def _labelled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, copy, distinct features) of labelled rows (toxic, text).

    copy is the least hash of the text's 5-word shingles: equal for copies and, in proportion to what
    they share, for near copies.
    """
    for batch in batches:
        for low, high, raw, offsets in slices(batch.column(1)):
            rows, hashes = (np.concatenate(x) for x in zip(*_feature_hashes(raw, offsets), strict=True))
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            rows, hashes = rows[first], hashes[first]
            at = np.searchsorted(rows, np.arange(high - low + 1))
            features = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(long_view(hashes)))
            tokens, begin = shingle_sets(raw, offsets)
            copy = np.zeros(high - low, np.uint64)
            some = begin[1:] > begin[:-1]
            copy[some] = tokens[begin[:-1][some]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(long_view(copy)), features], ["toxic", "copy", "features"])


def _selected(features: np.ndarray):
    """(toxic, copy, the numbers of the selected features that the row has, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            own = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0])).to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(features, own), len(features) - 1)
            hit = features[at] == own
            begin = np.concatenate(([0], np.cumsum(hit)))[ends - ends[0]]
            on = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(at[hit], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), on], ["toxic", "copy", "on"])

    return run


def sample_labels(labels: DataFrame, column: str, most: int = MOST_LABELS) -> dict[int, int]:
    """doc_id -> label of about `most` rows (those with the least hash of doc_id) where both are set.

    Of an id's labels the largest counts. No labels, no entries.
    """
    set_ = labels.where(f"doc_id is not null and {column} is not null").groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    n = set_.count()
    if n > most:
        set_ = set_.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40)) < int((1 << 40) * most / n))
    return {r["doc_id"]: r["y"] for r in set_.collect()}


def fit_severity(docs: DataFrame, labels: DataFrame, grades: int = 3) -> SeverityModel:
    """A model from documents (doc_id, text) and labels (doc_id, toxic 0/1, or higher for graded labels).

    Labels of 0 and 1 alone are graded by how plainly toxic a row looks to models that do not know it: toxic
    rows fall into `grades` grades by the score that a model of the other FOLDS - 1 parts of the rows gives them,
    parted at its quantiles. Takes at most about MOST_LABELS labelled rows and the MOST_FEATURES features of
    largest |z|. Rows whose least shingle is equal (copies, most near copies) are one piece of
    evidence: they count once in a feature's test, and once in the fit for each set of selected features
    that they have. Null texts and null ids or labels are left out, empty texts are rows without features.
    With no toxic or no clean row, as with an empty table, nothing is ever rejected.
    """
    grade_of = sample_labels(labels, "toxic")
    graded = docs.sparkSession.createDataFrame(list(grade_of.items()), "doc_id bigint, toxic int")
    named = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(graded), "doc_id").select("toxic", "text")
    rows = cut(map_texts(named, _labelled_features, "toxic int, copy bigint, features array<bigint>"))
    bad = (F.col("toxic") > 0).cast("int").alias("bad")
    n_of = {r["bad"]: r["n"] for r in rows.groupBy(bad).agg(F.count_distinct("copy").alias("n")).collect()}
    n1, n0 = n_of.get(1, 0), n_of.get(0, 0)
    nothing = SeverityModel(np.empty(0, np.uint64), np.empty(0), np.array([30.0]), np.inf)
    if not n1 or not n0:
        return nothing
    found = rows.select(bad, "copy", F.explode("features").alias("feature")).distinct().groupBy("feature").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).where("n >= 5")
    p1, p0, pooled = F.col("bad") / n1, (F.col("n") - F.col("bad")) / n0, F.col("n") / (n1 + n0)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    told = (F.abs("z") >= LEAST_Z) | ((F.col("z") >= LEAST_SURE_Z) & (F.col("bad") >= SURE * F.col("n")))
    best = found.withColumn("z", z).where(told).orderBy(F.abs("z").desc(), "feature").limit(MOST_FEATURES).select("feature").toArrow()
    features = np.sort(best.column("feature").to_numpy().astype(np.int64).view(np.uint64))
    if not len(features):
        return nothing
    # bounded by MOST_LABELS
    table = rows.mapInArrow(_selected(features), "toxic int, copy bigint, on array<int>").groupBy("toxic", "on").agg(F.count_distinct("copy").alias("n")).orderBy("toxic", "on").toArrow()
    toxic, times = table.column("toxic").to_numpy(), table.column("n").to_numpy()
    on = table.column("on").to_pylist()
    have = np.array([len(x) for x in on])
    row, column = np.repeat(np.arange(len(on)), have), np.array([c for x in on for c in x], np.int64)
    grade = toxic.astype(np.int64)
    if grade.max() <= 1 and grades > 1:
        score = _out_of_fold(row, column, grade, len(features), times)
        edges = np.unique(np.quantile(np.repeat(score, times * (toxic > 0)), np.arange(1, grades) / grades))
        grade = np.where(toxic > 0, 1 + np.searchsorted(edges, score, side="left"), 0)
    grade = np.unique(grade, return_inverse=True)[1]
    weights, thresholds = _fit(row, column, grade, len(features), times)
    model = SeverityModel(features, weights, thresholds, np.inf)
    expected = model.expected(np.bincount(row, weights[column], minlength=len(on)))
    found_cut = best_cut(np.repeat(expected, times).tolist(), np.repeat(toxic > 0, times).tolist())
    return SeverityModel(features, weights, thresholds, np.inf if found_cut is None else found_cut)


def _out_of_fold(row: np.ndarray, column: np.ndarray, grade: np.ndarray, width: int, times: np.ndarray) -> np.ndarray:
    """Each row's score by a two-grade model of the rows of the other parts; 0 where these have one grade only."""
    part = np.arange(len(grade)) % FOLDS  # rows are sorted by grade, so each part has its share of both
    score = np.zeros(len(grade))
    for f in range(FOLDS):
        others = np.flatnonzero(part != f)
        if len(np.unique(grade[others])) < 2:
            continue
        place = np.full(len(grade), -1)
        place[others] = np.arange(len(others))
        known = place[row] >= 0
        weights, _ = _fit(place[row[known]], column[known], grade[others], width, times[others])
        score[part == f] = np.bincount(row, weights[column], minlength=len(grade))[part == f]
    return score


def _fit(row: np.ndarray, column: np.ndarray, grade: np.ndarray, width: int, times: np.ndarray | None = None, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a little ridge, by Adam, of rows that count `times` each. theta_k = theta_0 + exp(d_1) + ... + exp(d_k)."""
    n, steps = len(grade), int(grade.max())
    share = np.full(n, 1 / n) if times is None else times / times.sum()
    above = np.array([share[grade > k].sum() for k in range(steps)]).clip(1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(above / (1 - above)) + np.arange(steps) * 0.5)
    raw = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 0.1))))
    x = np.concatenate((np.zeros(width), raw))
    first = second = np.zeros(len(x))
    for t in range(1, rounds + 1):
        w, raw = x[:width], x[width:]
        gaps = np.exp(raw[1:])
        theta = raw[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        s = _logistic(np.bincount(row, w[column], minlength=n)[:, None] - theta[None, :])
        s = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)
        slope = s * (1 - s)
        each = np.arange(n)
        p = np.maximum(s[each, grade] - s[each, grade + 1], 1e-9)
        g_z = -(slope[each, grade] - slope[each, grade + 1]) / p * share
        push = slope / p[:, None] * share[:, None]
        g_theta = np.array([push[grade == k + 1, k + 1].sum() - push[grade == k, k + 1].sum() for k in range(steps)])
        g_raw = np.concatenate(([g_theta.sum()], [gaps[k] * g_theta[k + 1 :].sum() for k in range(steps - 1)]))
        g = np.concatenate((np.bincount(column, g_z[row], minlength=width) + decay * w, g_raw))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x - 0.1 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return x[:width], x[width] + np.concatenate(([0.0], np.cumsum(np.exp(x[width + 1 :]))))


def score_severity(docs: DataFrame, model: SeverityModel, names: tuple[str, str, str] = ("severity", "p_toxic", "rejected")) -> DataFrame:
    """Adds severity (expected grade, double), p_toxic (double) and rejected (boolean) from the whole text.

    Null and empty texts have no feature and are not rejected; equal texts score alike. Input columns of the
    added names are replaced; other columns pass through. No documents, no rows.
    """
    added = names
    kept = replace_columns(docs, *added)
    text_at = [c.lower() for c in kept.columns].index("text")
    fields = kept.withColumns(dict(zip(added, (F.lit(0.0), F.lit(0.0), F.lit(True)), strict=True))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for low, high, raw, offsets in slices(batch.column(text_at)):
                pairs = []
                for row, hashes in _feature_hashes(raw, offsets) if len(model.features) else ():
                    at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
                    hit = model.features[at] == hashes
                    pairs.append(row[hit] * len(model.features) + at[hit])
                if pairs:
                    row, at = np.divmod(np.unique(np.concatenate(pairs)), len(model.features))
                    z[low:high] = np.bincount(row, model.weights[at], minlength=high - low)
            severity = model.expected(z)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(severity), pa.array(_logistic(z - model.thresholds[0])), pa.array(severity >= model.cut)], names=[*batch.schema.names, *added]
            )

    return map_texts(kept, run, fields)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents without the rejected ones; the model is fitted on these documents' labels.

    Rows and columns are those of the input, whatever their names. Null and empty texts stay, repeated rows
    stay or go together. Without labels, or with one kind only, all stay. No documents, no rows.
    """
    names = fresh_names(docs, "severity", "p_toxic", "rejected")
    scored = score_severity(docs, fit_severity(docs, labels), names)
    return scored.where(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
