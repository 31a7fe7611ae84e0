"""Benchmark decontamination with an FM-index per training shard.

A shard is a few MB of documents of one task. Its words are numbered by the benchmark's own
vocabulary; any other word ends a run, like the end of a document. The suffixes that begin in a
run are sorted, their preceding words form a Burrows-Wheeler sequence held in a wavelet matrix,
and suffix positions are kept only at run starts and at every 16th word. Benchmark windows are
searched backwards by rank queries, all at once; occurrences are located by walking back to
a kept position; the words they cover merge to removal spans. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.arrow_text import ALNUM, FOLD, run_hashes, runs, slices
from tidewell.llm.shared import ascii_lower, cut, discard, fresh_names, map_texts, replace_columns, scratch, store

WINDOW = 10
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARD_BYTES = 4 << 20
SAMPLE_EVERY = 16
#: Most window words that one search pass sends to the tasks; more windows make more passes.
BLOCK_WORDS = 4_000_000


@dataclass(frozen=True)
class Phrases:
    """A block of windows: words as numbers from 1 in the block's vocabulary, 0 behind the end."""

    vocabulary: np.ndarray  # ascending word hashes
    words: np.ndarray  # windows x longest
    lengths: np.ndarray
    item_at: np.ndarray  # items of window w: items[item_at[w]:item_at[w + 1]]
    items: np.ndarray


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """Distinct windows of all items (item_id bigint, text string), in blocks of bounded size, one at a time.

    Items of fewer words than a window are one window; items without words, with a null text or a
    null id have none.
    """
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(ALNUM_WORD), F.lit(0))
    items = benchmark.where("item_id is not null and text is not null").select("item_id", words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    phrases = (
        items.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("phrase"))
        .groupBy("phrase").agg(F.collect_set("item_id").alias("items"))
    )
    phrases = cut(phrases)
    size = phrases.agg(F.sum(F.size("items") + window)).first()[0] or 0
    blocks = -(-size // block_words)
    dealt = phrases.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(max(blocks, 1))))
    for b in range(blocks):
        table = dealt.where(F.col("block") == b).select("phrase", "items").toArrow()
        if table.num_rows:
            yield _packed(table)


def _packed(table: pa.Table) -> Phrases:
    table = table.combine_chunks().sort_by("phrase")
    texts = [t.split(" ") for t in table.column("phrase").to_pylist()]
    flat = pa.array([w for t in texts for w in t], pa.large_string())
    hashes = np.concatenate([run_hashes(raw, offsets[:-1], offsets[1:]) for _, _, raw, offsets in slices(flat)])
    vocabulary, number = np.unique(hashes, return_inverse=True)
    lengths = np.array([len(t) for t in texts])
    words = np.zeros((len(texts), lengths.max()), np.int64)
    words[np.arange(lengths.max()) < lengths[:, None]] = number + 1
    items = [sorted(x) for x in table.column("items").to_pylist()]
    return Phrases(vocabulary, words, lengths, np.cumsum([0, *map(len, items)]), np.array([i for x in items for i in x], np.int64))


def _suffix_order(words: np.ndarray) -> np.ndarray:
    """Positions of the non-zero words by their suffixes; every 0 is a mark of its own, above all words.

    Prefix doubling over the groups that are not yet parted. The last word must be 0.
    """
    order = np.flatnonzero(words)
    order = order[np.argsort(words[order], kind="stable")]
    m = len(order)
    rank = np.arange(len(words), dtype=np.int64) + m
    head = np.ones(m, bool)
    head[1:] = words[order[1:]] != words[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(m), 0))
    step = 1
    while True:
        alone = head & np.append(head[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            return order
        here = order[open_at]
        key = rank[here] * (len(words) + m) + rank[here + step]
        by = np.argsort(key, kind="stable")
        order[open_at], key = here[by], key[by]
        head[open_at[1:]] = key[1:] != key[:-1]
        head[open_at[0]] = True
        rank[order[open_at]] = np.maximum.accumulate(np.where(head, np.arange(m), 0))[open_at]
        step *= 2


class FMIndex:
    """Counts and locates word phrases in a sequence of word numbers (0: not in any phrase)."""

    def __init__(self, words: np.ndarray, symbols: int) -> None:
        order = _suffix_order(words)
        self.rows = len(order)
        self.first = np.concatenate(([0, 0], np.cumsum(np.bincount(words[order], minlength=symbols + 1)[1:])))
        self.bwt = np.where(order > 0, words[order - 1], 0)
        kept = (self.bwt == 0) | (order % SAMPLE_EVERY == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.samples = order[kept]
        self.levels = []
        values = self.bwt
        for level in range(max(symbols.bit_length() - 1, 0), -1, -1):
            bit = (values >> level) & 1 == 1
            ones = np.zeros(self.rows + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = self.rows - int(ones[-1])
            self.levels.append((level, ones, zeros))
            values = np.concatenate((values[~bit], values[bit]))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its row in the BWT: a walk down the wavelet levels."""
        low = np.zeros(len(symbol), np.int64)
        for level, ones, zeros in self.levels:
            bit = (symbol >> level) & 1 == 1
            up_row, up_low = ones[row], ones[low]
            row = np.where(bit, zeros + up_row, row - up_row)
            low = np.where(bit, zeros + up_low, low - up_low)
        return row - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases: number, first row and row after the last of those that occur."""
        which = np.arange(len(phrases))
        last = phrases[which, lengths - 1]
        low, high = self.first[last], self.first[last + 1]
        at = lengths - 2
        while True:
            alive = low < high
            which, low, high, at = which[alive], low[alive], high[alive], at[alive]
            more = at >= 0
            if not more.any():
                return which, low, high
            symbol = phrases[which[more], at[more]]
            for bound in (low, high):
                bound[more] = self.first[symbol] + self.rank(symbol, bound[more])
            at = at - 1

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back to a kept position, counted."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo := todo[self.kept_before[rows[todo] + 1] == self.kept_before[rows[todo]]]):
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.first[symbol] + self.rank(symbol, rows[todo])
            steps[todo] += 1
        return self.samples[self.kept_before[rows]] + steps


def _occurrences(words: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position) of every occurrence in a shard's word numbers."""
    index = FMIndex(words, len(block.vocabulary))
    which, low, high = index.search(block.words, block.lengths)
    times = high - low
    rows = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(which, times), index.locate(rows)


def _numbered(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def _searched(text: pa.Array, block: Phrases | None, items: list[list[int]], spans: list[list[dict]], cut_out: bool) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """(words, hit words) by row and the texts without the hits; adds what the block finds to items and spans."""
    n_words, n_hit, texts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], {}
    for base, stop, raw, offsets in slices(text, SHARD_BYTES):
        folded = FOLD[raw]
        start, end = runs(folded, offsets, ALNUM)
        first = np.searchsorted(start, offsets)
        rows, n = stop - base, len(start)
        row = np.repeat(np.arange(rows), np.diff(first))
        place = np.arange(n) + row  # a 0 behind each row keeps rows apart
        cover = np.zeros(n + 1, np.int64)
        for r, known in enumerate(spans[base:stop]):
            for span in known:
                cover[first[r] + span["first"]] += 1
                cover[first[r] + span["last"] + 1] -= 1
        if block is not None:
            words = np.zeros(n + rows, np.int64)
            words[place] = _numbered(run_hashes(folded, start, end), block.vocabulary)
            which, at = _occurrences(words, block)
            begin = np.searchsorted(place, at)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + block.lengths[which], -1)
            found: dict[int, set[int]] = {}
            for r, w in sorted(set(zip(row[begin].tolist(), which.tolist(), strict=True))):
                found.setdefault(base + r, set()).update(block.items[block.item_at[w] : block.item_at[w + 1]].tolist())
            for r, own in found.items():
                items[r] = sorted(own.union(items[r]))
        hit = np.cumsum(cover[:-1]) > 0
        n_words.append(np.diff(first))
        n_hit.append(np.diff(np.concatenate(([0], np.cumsum(hit)))[first]))
        for r in np.flatnonzero(n_hit[-1]).tolist():
            own = hit[first[r] : first[r + 1]].astype(np.int8)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own, [0])))).reshape(-1, 2)
            spans[base + r] = [{"first": int(a), "last": int(b) - 1} for a, b in edge]
            if cut_out:
                low, pieces = int(offsets[r]), []
                for a, b in edge:
                    pieces.append(raw[low : start[first[r] + a]].tobytes())
                    low = int(end[first[r] + b - 1])
                pieces.append(raw[low : offsets[r + 1]].tobytes())
                texts[base + r] = b"".join(pieces).decode()
    return np.concatenate(n_words), np.concatenate(n_hit), texts


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
_ADDED = ("n_words", "n_hit", "item_ids", "spans")
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut_out: bool = False) -> DataFrame:
    """Where benchmark windows occur in documents.

    docs: text string and any other columns, which pass through. benchmark: item_id bigint, text.
    Adds n_words, n_hit (bigint), item_ids (array<bigint>, ascending) and spans (array of first and
    last word number from 0 of each merged stretch of hit words); input columns of these names are
    replaced. With cut_out, text loses every span, from the first byte of its first word to the
    last byte of its last one. Words: A-Z lower-cased runs of ASCII letters, digits and all
    characters from U+0080. Null and empty texts have no words; an empty benchmark hits nothing.
    Equal texts, so repeated rows, are treated alike; no documents, no rows. Rows keep their number and order of columns. Driver and tasks hold one block of windows (BLOCK_WORDS);
    a benchmark of more is searched in several passes, each stored in the shared folder for the next.
    """
    kept, at_last = replace_columns(docs, *_ADDED), None
    stored: list[str] = []
    for block in phrase_blocks(benchmark, window):
        if at_last is not None:
            stored.append(scratch(docs.sparkSession, "passages"))
            kept = store(_pass(kept, at_last, len(stored) > 1, False), stored[-1])
            discard(docs.sparkSession, *stored[-2:-1])
        at_last = block
    return _pass(kept, at_last, bool(stored), cut_out)


def _pass(docs: DataFrame, block: Phrases | None, again: bool, cut_out: bool) -> DataFrame:
    """One block's search; again: docs has the columns of an earlier pass, which this one adds to."""
    own = docs.schema.fields[: len(docs.columns) - len(_ADDED) * again]
    schema = T.StructType([*own, *(T.StructField(name, kind) for name, kind in zip(_ADDED, (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), _SPANS), strict=True))])
    at = [f.name.lower() for f in own].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[: len(own)]
            items, spans = (c.to_pylist() for c in batch.columns[-2:]) if again else ([[] for _ in range(batch.num_rows)] for _ in range(2))
            n_words, n_hit, texts = _searched(columns[at], block, items, spans, cut_out)
            if texts:
                old = columns[at]
                pieces, low = [], 0
                for r, text in sorted(texts.items()):
                    pieces += [old.slice(low, r - low), pa.array([text], old.type)]
                    low = r + 1
                columns[at] = pa.concat_arrays([*pieces, old.slice(low)])
            found = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, _ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=[*batch.schema.names[: len(own)], *_ADDED])

    return map_texts(docs, run, schema)


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with every benchmark passage cut out of their texts.

    A document of which no word is left goes, if it had words; null texts and texts without words stay. Rows and
    columns are those of the input, whatever their names; repeated rows are treated alike. n_chars, where there is
    one, is that of the new text. An empty benchmark changes nothing; no documents, no rows.
    """
    own = dict(zip(_ADDED, fresh_names(docs, *(f"{c}_" for c in _ADDED)), strict=True))
    shielded = {c: own[c.lower()] for c in docs.columns if c.lower() in own}  # input columns that are called like the search's
    found = find_passages(docs.withColumnsRenamed(shielded), benchmark, window, cut_out=True).where("n_hit < n_words or n_words = 0")
    size = {"n_chars": F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return found.withColumns(size).select(*[F.col(f"`{shielded.get(c, c)}`").alias(c) for c in docs.columns])
