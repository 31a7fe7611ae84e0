"""Quality by importance resampling of hashed n-gram models.

Two multinomial models over hashed unigrams and bigrams, one of target texts (labelled good) and one of
all texts, give each document the log ratio of its probabilities. Documents are drawn
without replacement in proportion to that ratio: Gumbel noise is added and the k
largest keys are kept (Xie et al. 2023).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow_text import FOLD, WORD_PUNCT, mix, run_hashes, runs, slices
from tidewell.llm.shared import best_cut, cut, fresh_names, hash_unit, map_texts, replace_columns
from tidewell.llm.toxicity import sample_labels

BUCKETS = 1 << 14
#: Labelled rows that give the target model and the default size of the draw, in expectation.
MOST_LABELS = 20_000
#: Weight of the raw model as the target model's prior, in n-grams: without evidence the ratio is 0.
PRIOR = 100.0
_SCALE = 1 << 16


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every unigram and bigram of words and punctuation runs; bucket 0: a word that repeats the one before."""
    folded = FOLD[raw]
    start, end = runs(folded, offsets, WORD_PUNCT)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    h = run_hashes(folded, start, end)
    one = h % np.uint64(BUCKETS - 1) + np.uint64(1)
    if len(h) < 2:
        return row, one.astype(np.int64)
    two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) % np.uint64(BUCKETS - 1) + np.uint64(1)
    two[h[:-1] == h[1:]] = 0
    same = row[:-1] == row[1:]
    return np.concatenate((row, row[:-1][same])), np.concatenate((one, two[same])).astype(np.int64)


@dataclass(frozen=True)
class RatioModel:
    """Log ratio of target to raw probability per bucket, as whole 1/65536ths so that sums don't depend on their order."""

    ratio: np.ndarray


def fit_ratio(docs: DataFrame, labels: DataFrame) -> tuple[RatioModel, dict[int, int]]:
    """(model, labels held back from it). docs: doc_id, text; labels: doc_id, quality 0/1.

    The raw model counts all documents, repeated ones as often. The target model counts the good ones (quality
    above 0) of a bounded sample of labels (MOST_LABELS); of these a third is held back, with all others. Null and
    empty texts count nothing, null ids and labels are left out. Without a good one, the ratio is 0 throughout.
    """
    quality = sample_labels(labels, "quality", MOST_LABELS)
    ids = sorted(i for i, q in quality.items() if q > 0)
    good = np.array([i for n, i in enumerate(ids) if n % 3], np.int64)
    used = set(good.tolist())
    quality = {i: q for i, q in quality.items() if i not in used}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), good) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for low, high, raw, offsets in slices(batch.column(1)):
                row, bucket = _grams(raw, offsets)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[target[low:high][row]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    sums = map_texts(docs.select("doc_id", "text").where("text is not null"), add_up, "bucket bigint, raw bigint, target bigint")
    sums = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = sums.column("bucket").to_numpy().astype(np.int64)
    raw[at], target[at] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    if not target.sum():
        return RatioModel(np.zeros(BUCKETS, np.int64)), quality
    share = raw / raw.sum()
    seen = raw > 0
    ratio = np.zeros(BUCKETS)
    ratio[seen] = np.log((target[seen] + PRIOR * share[seen]) / (target.sum() + PRIOR) / share[seen])
    return RatioModel(np.round(ratio * _SCALE).astype(np.int64)), quality


def weigh(docs: DataFrame, model: RatioModel, name: str = "log_weight") -> DataFrame:
    """Adds log_weight (double), null for a null text and one without words. An input column of that name is replaced."""
    kept = replace_columns(docs, name)
    text_at = [c.lower() for c in kept.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, seen = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for low, high, raw, offsets in slices(batch.column(text_at)):
                row, bucket = _grams(raw, offsets)
                # Whole numbers far below 2^53: the float sums are exact.
                total[low:high] = np.bincount(row, model.ratio[bucket], minlength=high - low).astype(np.int64)
                seen[low:high] = np.bincount(row, minlength=high - low) > 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total / _SCALE, pa.float64(), mask=~seen)], names=[*batch.schema.names, name])

    return map_texts(kept, run, kept.withColumn(name, F.lit(None).cast("double")).schema)


def gumbel_key(seed: int, name: str = "log_weight") -> Column:
    """log_weight plus Gumbel noise that depends on seed and doc_id alone."""
    return F.col(name) - F.log(-F.log(hash_unit(F.lit(seed), F.col("doc_id"))))


def kth_largest(keys: DataFrame, k: int, few: int = 50_000) -> float | None:
    """The k-th largest of a double column `key` (nulls left out); None if there are fewer or k < 1.

    Counts in 1024 bins narrow down the range until few enough values are left to look at.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) / 1024
        bin_of = F.least(F.floor((F.col("key") - low) / width), F.lit(1023)) if width > 0 else F.lit(0)
        inside = keys.where(F.col("key").between(low, high))
        if inside.count() <= few or width <= 0:
            return sorted((r[0] for r in inside.select("key").limit(few).collect()), reverse=True)[k - 1]
        counts = {r["b"]: (r["n"], r["low"], r["high"]) for r in inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            n, below, above = counts[b]
            if k <= n:
                low, high = below, above
                break
            k -= n
    return low


@dataclass(frozen=True)
class Draw:
    """A Gumbel top-k draw: the rows whose key is at least `least` (None: no row)."""

    model: RatioModel
    seed: int
    least: float | None
    scored: DataFrame


def expected_good(scored: DataFrame, quality: dict[int, int]) -> int:
    """The number of documents that the held-back labels make one expect to be good: the default k.

    The cut that best parts good from bad labels makes two strata of keys; each one's documents count by its labels'
    share of good ones. Of rows that share an id the largest key stands for the label. Without labels of both
    kinds all documents with words are expected to be good.
    """
    known = scored.sparkSession.createDataFrame(list(quality.items()), "doc_id bigint, quality int")
    rows = scored.where("key is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("key").alias("key"), F.max("quality").alias("quality")).collect()
    cut_at = best_cut([r["key"] for r in rows], [r["quality"] > 0 for r in rows])
    above = F.col("key") >= (float("-inf") if cut_at is None else cut_at)
    counts = {r["above"]: r["n"] for r in scored.where("key is not null").groupBy(above.alias("above")).agg(F.count("*").alias("n")).collect()}
    if cut_at is None:
        return sum(counts.values())
    good = {side: [r["quality"] > 0 for r in rows if (r["key"] >= cut_at) == side] for side in counts}
    return round(sum(n * (sum(good[side]) / len(good[side]) if good[side] else float(side)) for side, n in counts.items()))


def draw_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 29) -> Draw:
    """Draws k documents by importance weight; rows that tie with the k-th are drawn too.

    k defaults to expected_good: the share of good documents in the target population, times their number.
    """
    model, quality = fit_ratio(docs, labels)
    scored = cut(weigh(docs.select("doc_id", "text"), model).select("doc_id", "log_weight", gumbel_key(seed).alias("key")))
    return Draw(model, seed, kth_largest(scored, expected_good(scored, quality) if k is None else k), scored)


def resample_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 29) -> DataFrame:
    """Per document: doc_id, log_weight, key (both null without words) and kept (boolean, false without words).

    Rows that share id and text share their key; so do rows with a null id, by their text. Other columns are ignored.
    No documents, no rows.
    """
    draw = draw_quality(docs, labels, k, seed)
    kept = F.lit(False) if draw.least is None else F.coalesce(F.col("key") >= draw.least, F.lit(False))
    return draw.scored.withColumn("kept", kept)


def drop_poor(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 29) -> DataFrame:
    """The documents drawn; rows and columns are those of the input, whatever their names.

    Null texts and texts without words go; repeated rows stay or go together. Keys are worked out again as texts
    pass: no text is shuffled. No documents, no rows.
    """
    draw = draw_quality(docs, labels, k, seed)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if draw.least is None:
        return docs.where(F.lit(False))
    (name,) = fresh_names(docs, "log_weight")
    return weigh(docs, draw.model, name).where(gumbel_key(draw.seed, name) >= draw.least).select(*columns)
