"""Ranked lexical search, reversed: documents stream through an inverted index over the items' terms.

The index (terms, and the items that hold each) is what travels to the tasks; a document is read, counted and
scored where it lies, and never moves. Every task keeps a bounded heap of the best documents of each item; Spark
merges the heaps in two steps, so that no task meets all of them. The index is sent in blocks of bounded size: more
items make more passes over the documents, not larger tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.llm.arrow_text import ALNUM, FOLD, run_hashes, runs, slices
from tidewell.llm.shared import ascii_lower, cut, map_texts

#: Terms once A-Z are lower-cased: runs of ASCII letters, digits and all characters from U+0080.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOP = 10
#: Most (item, term) pairs of one pass; a single item may have more.
BLOCK_TERMS = 200_000
#: Cells (documents x items) that a task scores at once.
CELLS = 1 << 21
#: Partial merges of an item's heaps.
MERGES = 64


@dataclass(frozen=True)
class ItemIndex:
    """Items by number, their terms as ascending 64-bit hashes, and the items of each term."""

    items: list
    vocabulary: np.ndarray
    post_at: np.ndarray  # items of term v: postings[post_at[v]:post_at[v + 1]]
    postings: np.ndarray


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and the weight of each vocabulary term."""

    n_docs: int
    n_terms: int
    weights: np.ndarray


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[ItemIndex]:
    """Indexes over items (item_id, text), one at a time. Rows of one item_id are one item; null ids and texts are left out."""
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    pairs = cut(items.where("item_id is not null and text is not null").select("item_id", F.explode(words).alias("term")).distinct())
    blocks = -(-pairs.count() // block_terms)
    for b in range(blocks):
        part = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        table = part.toArrow().combine_chunks()
        if table.num_rows:
            yield _indexed(table)


def _indexed(table: pa.Table) -> ItemIndex:
    ids = table.column("item_id").to_pylist()
    items = sorted(set(ids))
    number = {i: n for n, i in enumerate(items)}
    column = table.column("term").combine_chunks()
    hashes = np.concatenate([run_hashes(raw, offsets[:-1], offsets[1:]) for _, _, raw, offsets in slices(column)])
    vocabulary, term = np.unique(hashes, return_inverse=True)
    item = np.array([number[i] for i in ids])
    order = np.lexsort((item, term))
    return ItemIndex(items, vocabulary, np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), item[order])


def _counted(text: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slice: first row, terms of each row, and (row, vocabulary term, occurrences) of what the vocabulary has."""
    for base, _, raw, offsets in slices(text):
        folded = FOLD[raw]
        start, end = runs(folded, offsets, ALNUM)
        n = np.diff(np.searchsorted(start, offsets))
        hashes = run_hashes(folded, start, end)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[at] == hashes
        pair, tf = np.unique((np.repeat(np.arange(len(n)), n) * len(vocabulary) + at)[known], return_counts=True)
        yield base, n, pair // len(vocabulary), pair % len(vocabulary), tf


def corpus_statistics(docs: DataFrame, index: ItemIndex) -> Corpus:
    """One pass: tasks add up document frequencies of the index's terms and the totals; only the sums meet."""
    vocabulary = index.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, n, _, term, _ in _counted(batch.column(0), vocabulary):
                held += np.bincount(term, minlength=len(vocabulary))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        known = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], known)), pa.int32()), pa.array(np.concatenate(([n_docs, n_terms], held[known])), pa.int64())], names=["term", "n"])

    sums = map_texts(docs.select("text"), run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.toLocalIterator()}  # a row for each term of the index at most
    n_docs = found.get(-2, 0)
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(v, 0) + 1))) for v in range(len(vocabulary))]
    return Corpus(n_docs, found.get(-1, 0), np.array(weights, np.int64))


class Heaps:
    """The best documents of each item so far: higher scores first, then lower ids, null ids last."""

    def __init__(self, items: int, top: int) -> None:
        self.items, self.top = items, top
        self.floor = np.ones(items, np.int64)  # a lower score cannot enter
        self.rows = [np.empty(0, np.int64) for _ in range(4)]  # item, score, whether the id is null, id

    def push(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents x items."""
        bound = self.floor
        if len(scores) > self.top:  # what is below a column's own top cannot enter either
            bound = np.maximum(bound, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        doc, item = np.nonzero(scores >= bound)
        if not len(doc):
            return
        rows = [np.concatenate(x) for x in zip(self.rows, (item, scores[doc, item], missing[doc], ids[doc]), strict=True)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        first = np.searchsorted(rows[0], np.arange(self.items + 1))
        place = np.arange(len(order)) - first[rows[0]]
        self.rows = [x[place < self.top] for x in rows]
        full = place == self.top - 1
        self.floor[rows[0][full]] = rows[1][full]


def _scored(row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, corpus: Corpus, index: ItemIndex) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores as documents x items) of a slice, a bounded number of cells at a time.

    Sums are exact: a score of 100,000 terms stays below 2^53.
    """
    length = np.array([10 + 90 * k * corpus.n_docs // corpus.n_terms for k in n.tolist()], np.int64)
    gain = corpus.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * length[row]))
    times, items = np.diff(index.post_at)[term], len(index.items)
    most = max(1, CELLS // items)
    for low in range(0, len(n), most):
        high = min(low + most, len(n))
        a, b = np.searchsorted(row, (low, high))
        many = times[a:b]
        at = np.repeat(index.post_at[term[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = np.repeat(row[a:b] - low, many) * items + index.postings[at]
        yield low, np.bincount(cell, np.repeat(gain[a:b], many), (high - low) * items).astype(np.int64).reshape(-1, items)


def _best(docs: DataFrame, index: ItemIndex, corpus: Corpus, top: int, item_type: T.DataType) -> DataFrame:
    """(item_id, doc_id, score): each task's heaps."""
    vocabulary = index.vocabulary
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(index.items), top)
        for batch in batches:
            key = batch.column(0)
            missing, ids = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy()
            for base, n, row, term, tf in _counted(batch.column(1), vocabulary):
                if len(row):
                    for low, scores in _scored(row, term, tf, n, corpus, index):
                        here = slice(base + low, base + low + len(scores))
                        heaps.push(scores, missing[here], ids[here])
        item, score, missing, ids = heaps.rows
        out = [pa.array([index.items[i] for i in item.tolist()], kind), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)
    return map_texts(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents of highest score above 0, ties by ascending doc_id.

    docs: doc_id (an integer) and text; items: item_id and text; other columns, whatever their names, are not read.
    Every row of docs is a document of its own, repeated ones too; null ids come last among equals. Rows of one
    item_id are one item with the terms of all; items without id, text or term have no rows. Null and empty texts have
    no terms; texts are read whole, however long. Without documents or items there are no rows.
    """
    kind = items.schema["item_id"].dataType
    parts = []
    for index in item_blocks(items, block_terms):
        corpus = corpus_statistics(docs, index)
        if corpus.n_terms:
            parts.append(_best(docs, index, corpus, top, kind))
    if not parts:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", kind)])).selectExpr("item_id", "0 as rank", "0L as doc_id", "0L as score")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = reduce(DataFrame.unionByName, parts).withColumn("__merge", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES)))
    for by in (["item_id", "__merge"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")
