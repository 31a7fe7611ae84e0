"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary n-gram classifier (naive Bayes: the mean log
odds of hashed byte n-grams between the languages with a 1 and those with a 0) gives a margin; decoding adds up
a loss per bit, weighted by how far apart the bit's two sides are, and takes the codeword with the least loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow_text import ALNUM, FOLD, slices
from tidewell.llm.shared import cut, fresh_names, map_texts, replace_columns

ORDERS = (2, 3, 4)
BUCKETS = 4096
#: Languages whose sums a task holds at once.
HELD_LANGUAGES = 256
#: Languages up to which the widest apart of random codes is looked for; it takes all pairs of codewords.
COMPARED = 2000
#: Letters stay, folded; every other ASCII byte is a space.
_LETTER = np.where((ALNUM == 1) & ~np.isin(np.arange(256), np.arange(0x30, 0x3A)), FOLD, np.uint8(32)).astype(np.uint8)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k distinct codewords of -1 and 1 of some log2(k) bits: exhaustive up to 5 languages, beyond that the widest apart of 200 random codes, or, for very many languages, the first with distinct words."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        columns = [[1] + [1 if b >> i & 1 else -1 for i in range(k - 1)] for b in range((1 << (k - 1)) - 1)]
        return np.array(columns, np.int8).T
    draw = np.random.default_rng(seed)
    bits = 8 * int(np.ceil(np.log2(k)))
    best, apart = None, -1
    for _ in range(200):
        code = np.where(draw.random((k, bits)).argsort(axis=0) < k // 2, 1, -1).astype(np.int8)
        if k > COMPARED:
            if len(np.unique(code, axis=0)) == k:
                return code
            continue
        near = (bits - (code.astype(np.int32) @ code.T)) // 2 + bits * np.eye(k, dtype=np.int32)
        if near.min() > apart:
            best, apart = code, int(near.min())
    return best


@dataclass(frozen=True)
class CodeModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log odds
    middle: np.ndarray  # bits: the margin between the two sides
    spread: np.ndarray  # bits: half the distance of the sides
    usual: int  # the most frequent language

    def decode(self, margins: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score in (0, 1] and ambiguity; rows with known False get the usual language."""
        scaled = np.clip((margins - self.middle) / self.spread, -4, 4)
        weight = self.spread / self.spread.sum()
        loss = (np.log1p(np.exp(-2.0 * scaled)) * weight) @ (self.code > 0).T + (np.log1p(np.exp(2.0 * scaled)) * weight) @ (self.code < 0).T
        chance = np.exp(-4.0 * (loss - loss.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        top = np.sort(chance, axis=1)
        second = top[:, -2] if len(self.languages) > 1 else np.zeros(len(best))
        best = np.where(known, best, self.usual)
        score = np.where(known, top[:, -1], 1.0 / len(self.languages))
        return best, score, ~known | (second > 0.5 * top[:, -1])


def _buckets(letters: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of every byte n-gram that stays in its row and has a letter at its start or next to it."""
    m = len(letters) - order + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.full(m, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(order):
        h = (h ^ letters[j : m + j]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    fits = (letters[:m] != 32) | (letters[1 : m + 1] != 32) if order > 1 else letters[:m] != 32
    for j in range(1, order):
        at = offsets[1:-1] - j
        fits[at[(at >= 0) & (at < m)]] = False
    where = np.flatnonzero(fits)
    return where, (h[where] % np.uint32(BUCKETS)).astype(np.int64)


def _counts(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """n-gram counts, groups x BUCKETS; group: a number per row."""
    letters = _LETTER[raw]
    of_byte = np.repeat(group, np.diff(offsets))
    total = np.zeros(groups * BUCKETS)
    for order in ORDERS:
        where, bucket = _buckets(letters, offsets, order)
        total += np.bincount(of_byte[where] * BUCKETS + bucket, minlength=groups * BUCKETS)
    return total.reshape(groups, BUCKETS)


def _language_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of rows (lang, text), sums of this task; bucket -1 counts the rows."""
    held: dict[str, int] = {}
    total, rows = np.zeros((HELD_LANGUAGES, BUCKETS)), np.zeros(HELD_LANGUAGES)

    def taken() -> pa.RecordBatch:
        names = np.array(list(held), object)
        of, bucket = np.nonzero(total[: len(held)])
        lang = pa.array([*names[of], *names], pa.string())
        out = pa.RecordBatch.from_arrays([lang, pa.array(np.concatenate((bucket, np.full(len(held), -1))), pa.int32()), pa.array(np.concatenate((total[of, bucket], rows[: len(held)])))], ["lang", "bucket", "n"])
        held.clear()
        total[:], rows[:] = 0, 0
        return out

    for batch in batches:
        langs = batch.column(0).to_pylist()
        low = 0
        while low < len(langs):
            if len(held) == HELD_LANGUAGES and langs[low] not in held:
                yield taken()
            high, group = low, []
            while high < len(langs) and (langs[high] in held or len(held) < HELD_LANGUAGES):
                group.append(held.setdefault(langs[high], len(held)))
                high += 1
            of = np.array(group, np.int64)
            rows += np.bincount(of, minlength=HELD_LANGUAGES)
            for first, last, raw, offsets in slices(batch.column(1).slice(low, high - low)):
                seen, local = np.unique(of[first:last], return_inverse=True)
                total[seen] += _counts(raw, offsets, local, len(seen))
            low = high
    if held:
        yield taken()


def fit_codes(docs: DataFrame) -> CodeModel | None:
    """The model from all rows with a text and a lang; None if there are none.

    Each task adds up the n-grams of each language, HELD_LANGUAGES of them at a time, and only these sums meet. Repeated
    rows count as often, texts without n-grams only as rows; other columns are ignored. Every language gets a codeword,
    however many there are: the driver reads one language's sums at a time and holds names, codewords, and the bits'
    weights.
    """
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    sums = map_texts(labelled, _language_sums, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    shares = cut(sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("grams")))  # BUCKETS + 1 at most
    rows_of = {r["lang"]: r["n"] for r in shares.select("lang", F.get("grams", F.lit(0))["n"].alias("n")).collect()}  # bucket -1: rows
    languages = tuple(sorted(rows_of))
    if not languages:
        return None
    number, code = {name: i for i, name in enumerate(languages)}, codewords(len(languages))
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)

    def shared() -> Iterator[tuple[int, np.ndarray]]:
        """(number, smoothed share of each bucket) of one language after the other."""
        for r in shares.toLocalIterator():
            counts = np.full(BUCKETS, 0.5)
            for bucket, n in r["grams"][1:]:
                counts[bucket] += n
            yield number[r["lang"]], counts / counts.sum()

    one_sum, zero_sum = np.zeros((BUCKETS, code.shape[1])), np.zeros((BUCKETS, code.shape[1]))
    for i, share in shared():
        one_sum += np.outer(share, ones[i])
        zero_sum += np.outer(share, zeros[i])
    split = zeros.any(axis=0)
    weights = np.where(split, np.log(one_sum / ones.sum(axis=0)) - np.log(np.where(split, zero_sum, 1.0) / np.maximum(zeros.sum(axis=0), 1)), 0.0)
    expected = np.zeros(code.shape)
    for i, share in shared():
        expected[i] = share @ weights  # the mean margin of a language's own text
    one = np.where(code > 0, expected, np.inf).min(axis=0)
    zero = np.where(code < 0, expected, -np.inf).max(axis=0)
    zero = np.where(np.isfinite(zero), zero, one - 2)
    usual = number[min(rows_of, key=lambda name: (-rows_of[name], name))]
    return CodeModel(languages, code, weights, (one + zero) / 2, np.maximum((one - zero) / 2, 1e-3), usual)


def predict_language(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """Adds lang_pred (string), score (double, 0 to 1) and ambiguous (boolean) from the whole text.

    Equal texts, so repeated rows, are treated alike; no documents, no rows. A null text and one without any letter get `und` with score 0, as does every text without a model.
    A text too short for an n-gram gets the most frequent language and is ambiguous. Input columns of the
    added names are replaced; other columns pass through.
    """
    added = ("lang_pred", "score", "ambiguous")
    kept = replace_columns(docs, *added)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(True)})
    names = kept.columns
    text_at = [c.lower() for c in names].index("text")
    fields = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "ambiguous": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best, score, unsure = np.zeros(len(has), np.int64), np.zeros(len(has)), np.ones(len(has), bool)
            for low, high, raw, offsets in slices(batch.column(text_at), most_rows=max(1, min(512, (1 << 21) // len(model.languages)))):
                counts = _counts(raw, offsets, np.arange(high - low), high - low)
                total = counts.sum(axis=1)
                margins = counts @ model.weights / np.maximum(total, 1)[:, None]
                best[low:high], score[low:high], unsure[low:high] = model.decode(margins, total > 0)
            names_of = np.where(has, np.array(model.languages, object)[best], "und")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names_of.tolist(), pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(unsure | ~has)], names=[*batch.schema.names[:-1], *added]
            )

    (mark,) = fresh_names(kept, "lettered")
    return map_texts(kept.withColumn(mark, lettered), run, fields)
