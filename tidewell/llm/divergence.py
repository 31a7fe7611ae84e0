"""Source divergence audit over hash-consed segment trees of term counts.

Each language keeps its frequent terms. A group (language, source) is a vector of counts over them, cut into blocks of term
numbers; a block of a group is a segment tree. Trees are hash-consed: equal subtrees of counts, of whatever group and place, are
one node. The divergence of two groups is the price of their roots, found by walking both trees at once: a pair of
nodes that comes up again only raises its multiplicity, so each pair of nodes is opened, and each pair of counts priced,
once. Terms are numbered by falling frequency, which gathers the rare ones, and with them the equal subtrees.

A unit of work is a block and two tiles of groups, of bounded size; Spark adds up the units' prices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.arrow_text import FOLD, run_hashes, runs, slices
from tidewell.llm.shared import cut, map_texts, scratch, store
from tidewell.operators.ranks import numbered

LEAST_DOCS = 10
TOP_TERMS = 10
#: Levels above the leaves of a block's tree: 1024 terms.
LEVELS = 10
#: Groups of a tile, about (they are dealt by hash).
TILE = 32
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
#: Probabilities are parts of this, plus 1.
SCALE = 1_000_000_000

# Byte classes: 1 for ASCII letters and all bytes of other characters.
LETTERS = np.ones(256, np.uint8)
LETTERS[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0


class _Counts:
    """A task's sums of occurrences and documents by group and term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.words: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, group: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
        """One slice of texts; group: the group number of each row. A term is known by its 64-bit hash within a task."""
        folded = FOLD[raw]
        start, end = runs(folded, offsets, LETTERS)
        if not len(start):
            return
        hashes, first, term = np.unique(run_hashes(folded, start, end), return_index=True, return_inverse=True)
        for h, a, b in zip(hashes.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            if h not in self.words:
                self.words[h] = folded[a:b].tobytes()
        row = np.repeat(np.arange(len(group)), np.diff(np.searchsorted(start, offsets)))
        pair, n = np.unique(row * len(hashes) + term, return_counts=True)
        row, term = pair // len(hashes), pair % len(hashes)
        self._keep(group[row], hashes[term], n, np.ones(len(n), np.int64))

    def _keep(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > HELD and len(self.parts) > 1:
            self.parts = [self._merged()]
            self.held = len(self.parts[0][0])

    def _merged(self) -> tuple[np.ndarray, ...]:
        group, term, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((term, group))
        group, term = group[order], term[order]
        head = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (term[1:] != term[:-1]))))
        return group[head], term[head], np.add.reduceat(n[order], head), np.add.reduceat(docs[order], head)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What is held, in batches; then nothing is."""
        if self.parts:
            names = list(self.groups)
            group, term, n, docs = self._merged()
            for low in range(0, len(group), 1 << 16):
                g, t = (x[low : low + (1 << 16)].tolist() for x in (group, term))
                columns = [pa.array([names[i][0] for i in g], pa.string()), pa.array([names[i][1] for i in g], pa.string()), pa.array([self.words[h] for h in t], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[low : low + (1 << 16)]), pa.array(docs[low : low + (1 << 16)])], names=["lang", "source", "term", "n", "docs"])
        self.__init__()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial sums of occurrences and of documents that hold the term; rows may repeat.

    docs: lang, source, text. Nulls read as ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            group = np.array([counts.groups.setdefault(p, len(counts.groups)) for p in pairs], np.int64)
            for base, stop, raw, offsets in slices(batch.column(2)):
                counts.add(group[base:stop], raw, offsets)
            if counts.held > HELD // 2:
                yield from counts.taken()
        yield from counts.taken()

    return map_texts(docs.select(_plain("lang"), _plain("source"), "text"), run, "lang string, source string, term string, n bigint, docs bigint")


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact in 64 bits for totals below 9e15: long division by thousands."""
    whole, rest, out = total + 2 * terms, count + 2, np.zeros(np.broadcast(count, total).shape, np.int64)
    out, rest = out + rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


class Forest:
    """Hash-consed segment trees over the rows of a matrix of counts; -1 marks a place without a term."""

    def __init__(self, counts: np.ndarray) -> None:
        self.values, nodes = np.unique(counts, return_inverse=True)
        self.leaves = nodes = nodes.reshape(counts.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # left and right child of each node, from the leaves upwards
        while nodes.shape[1] > 1:
            width = int(nodes.max()) + 1
            made, inverse = np.unique(nodes[:, 0::2] * width + nodes[:, 1::2], return_inverse=True)
            self.levels.append((made // width, made % width))
            nodes = inverse.reshape(len(counts), -1)
        self.roots = nodes[:, 0]

    def walk(self, a: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row a's tree beside each other row's: (number in others, leaf node of a, leaf node of the other, multiplicity), each once."""
        which, u, v = np.arange(len(others)), np.full(len(others), self.roots[a]), self.roots[others]
        times = np.ones(len(others), np.int64)
        for left, right in reversed(self.levels):
            which, times = np.tile(which, 2), np.tile(times, 2)
            u, v = np.concatenate((left[u], right[u])), np.concatenate((left[v], right[v]))
            width = int(max(u.max(initial=0), v.max(initial=0))) + 1
            keys, inverse = np.unique((which * width + u) * width + v, return_inverse=True)
            times = np.bincount(inverse, times, len(keys)).astype(np.int64)
            which, u, v = keys // (width * width), keys // width % width, keys % width
        return which, u, v, times


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _unit(table: pa.Table) -> pa.Table:
    """One block and two tiles of groups: prices of their pairs, and, where both tiles are one, each group's best terms.

    Rows: of the language (source null): slot, n, term; of a group: total (slot null), or slot and n.
    """
    names = ["lang", "part", "source", "item", "value"]
    lang, terms, i, j = (table.column(c)[0].as_py() for c in ("lang", "terms", "i", "j"))
    source, tile = table.column("source").to_pylist(), table.column("tile").to_pylist()
    slot, n, total = (table.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "n", "total"))
    heads = [r for r, s in enumerate(source) if s is not None and np.isnan(slot[r])]
    groups = [source[r] for r in heads]
    number = {s: k for k, s in enumerate(groups)} | {None: len(groups)}
    lang_total = table.column("lang_total")[0].as_py()
    totals = np.array([int(total[r]) for r in heads] + [lang_total], np.int64)
    tiles = np.array([tile[r] for r in heads], np.int64)
    counts = np.full((len(groups) + 1, 1 << LEVELS), -1, np.int64)
    body = np.flatnonzero(~np.isnan(slot))
    at, row, value = slot[body].astype(np.int64), np.array([number[source[r]] for r in body], np.int64), n[body].astype(np.int64)
    counts[:, np.unique(at[row == len(groups)])] = 0
    counts[row, at] = value
    forest = Forest(counts)
    out: list[tuple] = []

    def prices(a: int, others: np.ndarray) -> tuple[np.ndarray, ...]:
        which, u, v, times = forest.walk(a, others)
        real = forest.values[u] >= 0
        which, u, v, times = which[real], u[real], v[real], times[real]
        p, q = _share(forest.values[u], totals[a], terms), _share(forest.values[v], totals[others[which]], terms)
        return which, u, v, times, p, q, _price(p, q)

    order = sorted(range(len(groups)), key=groups.__getitem__)
    for a in order:
        others = np.array([b for b in order if groups[b] > groups[a] and {int(tiles[a]), int(tiles[b])} == {i, j}], np.int64)
        if len(others):
            which, _, _, times, _, _, f = prices(a, others)
            sums = np.zeros(len(others), np.int64)
            np.add.at(sums, which, f * times)
            out += [(lang, "pair", groups[a], groups[b], s) for b, s in zip(others.tolist(), sums.tolist(), strict=True)]
    if i == j and terms:
        words = dict(zip(at[row == len(groups)].tolist(), (table.column("term")[int(r)].as_py() for r in body[row == len(groups)]), strict=True))
        for a in order:
            _, u, v, times, p, q, f = prices(a, np.array([len(groups)]))
            good = (forest.values[u] > 0) & (p > q)
            u, v, times, f = u[good], v[good], times[good], f[good]
            if not len(f):
                continue
            falling = np.argsort(-f, kind="stable")
            enough = min(int(np.searchsorted(np.cumsum(times[falling]), TOP_TERMS)), len(f) - 1)
            best = f >= f[falling[enough]]  # the node pairs that reach the tenth place
            width = len(forest.values)
            code = u[best] * width + v[best]
            price = dict(zip(code.tolist(), f[best].tolist(), strict=True))
            here = forest.leaves[a] * width + forest.leaves[len(groups)]
            found = [(-price[c], words[s].encode(), s) for s, c in zip(np.flatnonzero(np.isin(here, code)).tolist(), here[np.isin(here, code)].tolist(), strict=True)]
            out += [(lang, "term", groups[a], words[s], -f_) for f_, _, s in sorted(found)[:TOP_TERMS]]
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(columns)], names=names)


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from the others, and by which terms.

    part pair: item is each other source of the language, value the divergence, all ranks; part term: item is a term
    that the source has relatively more often than its language, only the first TOP_TERMS ranks. Ranks go by falling
    value, then by item in UTF-8 order. Terms are runs of letters, A-Z lower-cased; a language keeps those of at least
    least_docs of its documents. All arithmetic is in whole numbers.

    docs: text, lang, source; other columns, whatever their names, are not read. Nulls read as ''. A source without
    terms has only rows of part pair, and so have all sources (of value 0) of a language that keeps no term; a language of one source has
    no pairs. Repeated rows count as often as they stand there; texts are read whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    paths = [scratch(spark, "divergence-kept")]
    term_of = Window.partitionBy("lang", "term")
    sums = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = sums.withColumns({"of": F.sum("docs").over(term_of), "n_lang": F.sum("n").over(term_of)}).where(F.col("of") >= least_docs)
    kept = store(sums.select("lang", "source", "term", "n", "n_lang"), paths[0])
    terms = numbered(kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")), "lang", F.col("n").desc(), "term")
    place = F.col("__rank") - 1
    terms = terms.select("lang", "term", "n", F.shiftright(place, LEVELS).alias("block"), place.bitwiseAND((1 << LEVELS) - 1).cast("int").alias("slot"))
    groups = docs.select(_plain("lang"), _plain("source")).distinct()
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    langs = cut(langs.join(terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total")), "lang", "left").na.fill(0, ["terms", "lang_total"]))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    groups = cut(groups.withColumn("tile", F.pmod(F.xxhash64("lang", "source"), F.col("tiles")).cast("int")))

    null = lambda kind: F.lit(None).cast(kind)
    own = ["lang", "source", "tile", "tiles", "terms", "lang_total"]
    blocks = langs.select("lang").join(terms.select("lang", "block").distinct(), "lang", "left").na.fill(-1, ["block"])
    heads = groups.join(blocks, "lang").select(*own, "block", null("int").alias("slot"), null("bigint").alias("n"), "total", null("string").alias("term"))
    body = kept.select("lang", "source", "term", "n").join(terms.drop("n"), ["lang", "term"]).join(groups, ["lang", "source"])
    body = body.select(*own, "block", "slot", "n", null("bigint").alias("total"), null("string").alias("term"))
    whole = terms.join(langs, "lang").select("lang", null("string").alias("source"), null("int").alias("tile"), "tiles", "terms", "lang_total", "block", "slot", "n", null("bigint").alias("total"), "term")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    of_group = heads.unionByName(body).withColumn("__other", F.explode(every)).withColumns({"i": F.least("tile", "__other"), "j": F.greatest("tile", "__other")}).drop("__other")
    of_lang = whole.withColumn("i", F.explode(every)).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("tiles") - 1)))
    units = of_group.unionByName(of_lang).drop("tiles")
    found = cut(units.groupBy("lang", "block", "i", "j").applyInArrow(_unit, "lang string, part string, source string, item string, value bigint"))

    pairs = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    back = pairs.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP_TERMS)
    out = pairs.unionByName(back).withColumn("rank", F.row_number().over(ranked)).unionByName(best)
    return out.select("lang", "source", "part", "item", "value", "rank")
