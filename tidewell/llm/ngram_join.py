"""N-gram Jaccard join through a token-group matrix.

Documents are sets of distinct word shingles. Similar documents of one chunk form a group
whose members are all linked (directly) to its leader; the group stores the union of its
members' prefix tokens. The unions are the rows (token, group) of a sparse token-group
matrix, dealt out by token. Two groups can hold a linked pair only if their unions share
enough tokens, so the count of shared tokens bounds the overlap of every pair of members;
only group pairs over that bound are opened and their texts compared exactly.

Prefix: by any one total order of all tokens, two sets with Jaccard >= 3/4 share one of the
first n - ceil(3n/4) + 1 tokens of each. The order puts tokens that recur in many groups
last, so that common passages and lines hardly ever meet in a prefix. Which tokens count as
frequent only changes the work, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow_text import long_view, mix, shingle_sets, slices
from tidewell.llm.components import connected_components
from tidewell.llm.shared import cut, discard, map_texts, scratch, store

WORDS = 5
#: Texts, in bytes, of a chunk: the unit in which local groups form. Bounds a task's memory.
CHUNK_BYTES = 8 << 20
#: Distinct sets in one local group; a cluster of more has several groups, linked to each other.
MOST_MEMBERS = 32
#: Sets in a block of similar groups, about: what is opened together once links to hubs are known.
BLOCK_SETS = 64
#: Shingles in a local group and in a block, about, and thereby their texts: one text may have more.
BLOCK_SHINGLES = 1 << 15
#: Block pairs that a task holds at once.
PAIRS_AT_ONCE = 16
#: Parts that the groups around one hub are dealt into for joins.
SALTS = 16
#: Largest table of frequent tokens that is sent to the tasks; beyond it the rarer ones of them
#: are ordered as if they were rare, which costs time and loses no link.
MOST_FREQUENT = 1 << 20
#: Most document ids that are broadcast to fetch texts; beyond it the fetch is a shuffle join.
MOST_BROADCAST = 1 << 20
_BANDS, _BINS = 8, 32


def overlap_needed(n: int | np.ndarray) -> int | np.ndarray:
    """ceil(3n/4): tokens that a set of n shares at least with any set it is linked to."""
    return (3 * n + 3) // 4


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union for ascending distinct arrays; empty sets never link."""
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


@dataclass
class Chunk:
    """Sets of one chunk and their local groups. Row i's tokens: tokens[at[i]:at[i+1]]."""

    ids: np.ndarray
    tokens: np.ndarray
    at: np.ndarray
    first: np.ndarray  # row of the first equal set, or the row itself
    leader: np.ndarray  # row of the group's leader
    digests: np.ndarray  # two 64-bit sums per row

    def set(self, i: int) -> np.ndarray:
        return self.tokens[self.at[i] : self.at[i + 1]]


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[at[1:]] - total[at[:-1]]


def _band_keys(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One-permutation minima of 32 hash ranges, four to a band; 0 where a band is empty."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    bins = (tokens >> np.uint64(59)).astype(np.int64)
    head = np.ones(len(tokens), bool)
    head[1:] = (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])
    least = np.zeros((rows, _BINS), np.uint64)
    least[row[head], bins[head]] = tokens[head]
    keys = np.zeros((rows, _BANDS), np.uint64)
    for band in range(_BANDS):
        part = least[:, band * 4 : band * 4 + 4]
        h = np.full(rows, band + 1, np.uint64)
        for j in range(4):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
        keys[:, band] = np.where(part.any(axis=1), h, np.uint64(0))
    return keys


def _grouped(ids: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> Chunk:
    rows = len(ids)
    digests = np.stack([_row_sums(mix(tokens + np.uint64(c)), at) for c in (1, 7)], axis=1) if rows else np.empty((0, 2), np.uint64)
    chunk = Chunk(ids, tokens, at, np.arange(rows), np.arange(rows), digests)
    keys = _band_keys(tokens, at).tolist()
    known: dict[tuple, int] = {}
    band_leader: dict[int, int] = {}
    members: dict[int, int] = {}
    held: dict[int, int] = {}
    for i, (size, digest) in enumerate(zip(np.diff(at).tolist(), map(tuple, digests.tolist()), strict=True)):
        if not size:
            continue
        same = known.setdefault((size, *digest), i)
        if same != i:
            chunk.first[i], chunk.leader[i] = same, chunk.leader[same]
            continue
        own = chunk.set(i)
        tried = set()
        for key in keys[i]:
            j = band_leader.get(key, -1) if key else -1
            if j < 0 or j in tried or members[j] >= MOST_MEMBERS or held[j] + size > BLOCK_SHINGLES:
                continue
            tried.add(j)
            if linked(own, chunk.set(j)):
                chunk.leader[i] = j
                members[j] += 1
                held[j] += size
                break
        if chunk.leader[i] == i:
            members[i], held[i] = 1, size
            band_leader.update((key, i) for key in keys[i] if key)
    return chunk


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of CHUNK_BYTES of text, across batches. Columns: doc_id, text."""
    ids, sets, size, held = [], [], [], 0

    def made() -> Chunk:
        counts = np.concatenate(size)
        return _grouped(np.concatenate(ids), np.concatenate(sets), np.concatenate(([0], np.cumsum(counts))))

    for batch in batches:
        doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high, raw, offsets in slices(batch.column(1)):
            tokens, at = shingle_sets(raw, offsets, WORDS)
            ids.append(doc_ids[low:high].astype(np.int64))
            sets.append(tokens)
            size.append(np.diff(at))
            held += len(raw)
            if held >= CHUNK_BYTES:
                yield made()
                ids, sets, size, held = [], [], [], 0
    if ids:
        yield made()


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, groups of the chunk with it) of tokens that at least two leaders of a chunk have."""
    for chunk in _chunks(batches):
        lead = np.repeat(chunk.leader == np.arange(len(chunk.ids)), np.diff(chunk.at))
        tokens = np.sort(chunk.tokens[lead])
        edge = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True]))) if len(tokens) else np.zeros(1, np.int64)
        times = np.diff(edge)
        again = times > 1
        yield pa.RecordBatch.from_arrays([pa.array(long_view(tokens[edge[:-1][again]])), pa.array(times[again])], ["token", "groups"])


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many groups have, ascending, and their frequency class (log2).

    Every chunk reports what recurs inside it; the sums decide. The table is bounded by
    MOST_FREQUENT: only as many of the highest classes are taken as fit.
    """
    counts = (
        map_texts(docs, _recurring, "token bigint, groups bigint")
        .groupBy("token").agg(F.sum("groups").alias("groups")).where("groups >= 8")
        .select("token", F.floor(F.log2("groups")).cast("int").alias("grade"))
    )
    counts = cut(counts)
    per_grade = sorted(((r["grade"], r["n"]) for r in counts.groupBy("grade").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for grade, n in per_grade:
        if (total := total + n) > MOST_FREQUENT:
            break
        least = grade
    table = counts.where(F.col("grade") >= least).toArrow()
    tokens = table.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table.column("grade").to_numpy().astype(np.int8)[order]


def _grades(tokens: np.ndarray, frequent: np.ndarray, grades: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tokens), np.int8)
    if len(frequent) and len(tokens):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hit = frequent[at] == tokens
        out[hit] = grades[at[hit]]
    return out


def _prefix(tokens: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The first tokens of a set by (grade, hash) as far as the prefix principle needs them."""
    length = len(tokens) - int(overlap_needed(len(tokens))) + 1
    rare = tokens[grade == 0]
    if len(rare) >= length:
        return rare[:length]
    common = grade > 0
    order = np.lexsort((tokens[common], grade[common]))
    return np.concatenate((rare, tokens[common][order[: length - len(rare)]]))


_MEMBER, _GROUP, _CELL = 0, 1, 2
_SCHEMA = "kind int, gid bigint, key bigint, x int, y int, d1 bigint, d2 bigint"


def _rows(kind: int, gid: np.ndarray, key: np.ndarray, *rest: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    for low in range(0, len(gid), 100_000):
        part = slice(low, low + 100_000)
        n = len(gid[part])
        data = [np.full(n, kind, np.int32), gid[part], key[part], *(None if x is None else x[part] for x in rest)]
        yield pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in zip(data, types, strict=True)], names=["kind", "gid", "key", "x", "y", "d1", "d2"])


def _matrix_rows(frequent: np.ndarray, grades: np.ndarray):
    """Members (key: doc_id, x: set size, y: 1 for the first of equal sets), groups (key: least id,
    x, y: least and most set size, d1, d2: the leader's digest) and cells (key: token) of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            n = np.diff(chunk.at)
            rows = np.arange(len(n))
            yield from _rows(_MEMBER, chunk.ids[chunk.leader], chunk.ids, n, (chunk.first == rows).astype(np.int32), None, None)
            grade = _grades(chunk.tokens, frequent, grades)
            mine = np.flatnonzero((n > 0) & (chunk.first == rows))
            if not len(mine):  # no text of the chunk has a word
                continue
            mine = mine[np.argsort(chunk.leader[mine], kind="stable")]
            cells = [_prefix(chunk.set(i), grade[chunk.at[i] : chunk.at[i + 1]]) for i in mine]
            leaders, begin = np.unique(chunk.leader[mine], return_index=True)
            unions = [cells[a] if b - a == 1 else np.unique(np.concatenate(cells[a:b])) for a, b in zip(begin, [*begin[1:], len(mine)], strict=True)]
            low = np.full(len(n), 1 << 62)
            np.minimum.at(low, chunk.leader, chunk.ids)
            yield from _rows(
                _GROUP, chunk.ids[leaders], low[leaders], np.minimum.reduceat(n[mine], begin), np.maximum.reduceat(n[mine], begin),
                long_view(chunk.digests[leaders, 0].copy()), long_view(chunk.digests[leaders, 1].copy()),
            )
            size = [len(u) for u in unions]
            yield from _rows(_CELL, np.repeat(chunk.ids[leaders], size), long_view(np.concatenate(unions)), None, None, None, None)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of block pairs with their members (gid, comp, text), links (a, b) between gids that join different components.

    A link that the links found before it already imply is left out.
    """
    for batch in batches:
        sides = []
        for name in ("members_a", "members_b"):
            lists = batch.column(name)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(int(at[0]), int(at[-1] - at[0]))
            sets = []
            for _, _, raw, offsets in slices(flat.field("text")):
                tokens, inner = shingle_sets(raw, offsets, WORDS)
                sets += [tokens[inner[i] : inner[i + 1]] for i in range(len(inner) - 1)]
            rows = list(zip(flat.field("gid").to_pylist(), flat.field("comp").to_pylist(), sets, strict=True))
            sides.append([_once(rows[i:j]) for i, j in zip(at - at[0], at[1:] - at[0], strict=False)])
        found: list[tuple[int, int]] = []
        for left, right in zip(*sides, strict=True):
            union = np.unique(np.concatenate([x[2] for x in right])) if right else np.empty(0, np.uint64)
            root: dict[int, int] = {}

            def top(x: int, root: dict[int, int] = root) -> int:
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            for gid, comp, own in left:
                if not len(union) or not len(own):
                    continue
                place = np.minimum(np.searchsorted(union, own), len(union) - 1)
                if np.count_nonzero(union[place] == own) < overlap_needed(len(own)):
                    continue  # bounded by the whole union: no member can be linked to it
                for other_gid, other_comp, other in right:
                    x, y = top(comp), top(other_comp)
                    if x != y and linked(own, other):
                        found.append((gid, other_gid))
                        root[x] = y
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _once(rows: list[tuple]) -> list[tuple]:
    """Members without those of equal component and set."""
    return list({(comp, tokens.tobytes()): (gid, comp, tokens) for gid, comp, tokens in rows}.values())


def _open(docs: DataFrame, members: DataFrame, blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) between members of different components in pairs (a, b) of blocks.

    blocks: gid, block, comp. Texts are fetched for the blocks in pairs only.
    """
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("block")).union(pairs.select("b")).distinct()
    fetch = members.where("y = 1").join(blocks.join(wanted, "block"), "gid").select("gid", "block", "comp", F.col("key").alias("doc_id"))
    fetch = cut(fetch.distinct())
    side = F.broadcast(fetch) if fetch.count() <= MOST_BROADCAST else fetch
    bundles_at = scratch(spark, "blocks")
    bundles = docs.join(side, "doc_id").groupBy("block").agg(F.collect_set(F.struct("gid", "comp", "text")).alias("members"))
    bundles = store(bundles, bundles_at)
    a = bundles.select(F.col("block").alias("a"), F.col("members").alias("members_a"))
    b = bundles.select(F.col("block").alias("b"), F.col("members").alias("members_b"))
    opened = pairs.select("a", "b").join(a, "a").join(b, "b").select("members_a", "members_b")
    rows_at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"  # blocks are large rows
    usual = spark.conf.get(rows_at_once)
    spark.conf.set(rows_at_once, PAIRS_AT_ONCE)
    try:
        out = cut(opened.mapInArrow(_compare, "a bigint, b bigint"))
    finally:
        spark.conf.set(rows_at_once, usual)
    discard(spark, bundles_at)
    return out


def _blocks(apart: DataFrame, found: DataFrame, members: DataFrame, groups: DataFrame, hubs: DataFrame) -> DataFrame:
    """(gid, comp, block, lo, hi): similar groups that are not linked (yet) dealt into blocks of about BLOCK_SETS sets or BLOCK_SHINGLES shingles.

    Groups are similar if they share most tokens with the same hub, have sizes within 5 %, and are
    all, or none, in the hub's component. A hot neighbourhood has many blocks; its groups are salted in the joins.
    """
    size = members.where("y = 1 and x > 0").groupBy("gid").agg(F.count("*").alias("sets"), F.sum("x").alias("shingles"))
    rows = apart.select("gid", "comp").distinct().join(groups.select("gid", "lo", "hi"), "gid").join(size, "gid").join(hubs, "gid", "left")
    rows = rows.withColumns({"hub": F.coalesce("hub", "gid"), "salt": F.pmod(F.xxhash64("gid"), F.lit(SALTS))})
    salted = lambda frame: frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    hub_comp = rows.select(F.col("hub").alias("node")).distinct().join(found, "node").select(F.col("node").alias("hub"), F.col("component").alias("hub_comp"))
    rows = rows.join(salted(hub_comp), ["hub", "salt"], "left")
    kind = [F.col("hub"), (F.col("comp") == F.coalesce("hub_comp", "hub")).alias("home"), F.floor(F.log("lo") / F.log(F.lit(1.05))).alias("grade")]
    rows = rows.select("gid", "comp", "lo", "hi", "sets", "shingles", "salt", *kind)
    parts = F.ceil(F.greatest(F.sum("sets") / BLOCK_SETS, F.sum("shingles") / BLOCK_SHINGLES))
    many = rows.groupBy("hub", "home", "grade").agg(parts.alias("parts")).where("parts > 1")
    dealt = rows.join(salted(many), ["hub", "home", "grade", "salt"], "left")
    block = F.xxhash64("hub", "home", "grade", F.pmod(F.xxhash64(F.lit(1), "gid"), F.coalesce("parts", F.lit(1))))
    return cut(dealt.select("gid", "comp", block.alias("block"), "lo", "hi"))


def _over_bound(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b, shared) whose shared prefix tokens leave room for a linked pair of members.

    A pair of sets of n and m tokens shares at most `shared` tokens plus the longer of the two
    suffixes behind the prefixes, and is linked only if it shares ceil(3(n + m) / 7). equal tells whether
    both have the same mark.
    """
    side = lambda x: groups.select(F.col("gid").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"), F.col("mark").alias(f"mark_{x}"))
    suffix = F.expr("(3 * greatest(hi_a, hi_b) + 3) div 4 - 1")
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where("4 * hi_a >= 3 * lo_b and 4 * hi_b >= 3 * lo_a")
        .where(F.col("shared") >= F.expr("(3 * (lo_a + lo_b) + 6) div 7") - suffix)
        .select("a", "b", F.coalesce(F.expr("mark_a = mark_b"), F.lit(False)).alias("equal"))
    )


def ngram_join(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of documents (doc_id bigint, text string) as one row per document.

    Two documents link when 100 * |intersection| >= 75 * |union| of their distinct 5-word shingle
    sets (words: runs of anything but space, \\t, \\n, \\v, \\f, \\r; A-Z lower-cased; a text of
    1 to 4 words is one shingle). Returns one row per input row: doc_id, n_shingles (bigint),
    component_id (the least doc_id reachable over links).

    Exact up to 64-bit hash collisions inside one pair of sets. Null and blank texts have
    n_shingles 0 and are their own component. A null doc_id has component_id null and links with
    nothing. Rows that share a doc_id are one document whose sets all count. Other columns are
    ignored. No documents, no rows. The result is materialised in the shared folder.
    """
    spark = docs.sparkSession
    named = docs.select("doc_id", "text").where("doc_id is not null")
    frequent, grades = frequent_tokens(named)
    matrix_at, met_at = scratch(spark, "matrix"), scratch(spark, "met")
    matrix = store(map_texts(named, _matrix_rows(frequent, grades), _SCHEMA), matrix_at)
    members = matrix.where(F.col("kind") == _MEMBER).select("gid", "key", "x", "y")
    groups = cut(
        matrix.where(F.col("kind") == _GROUP).groupBy("gid").agg(
            F.min("key").alias("low_id"), F.min("x").alias("lo"), F.max("y").alias("hi"),
            F.when((F.min("d1") == F.max("d1")) & (F.min("d2") == F.max("d2")), F.struct(F.min("d1"), F.min("d2"))).alias("mark"),
        )
    )
    cells = matrix.where(F.col("kind") == _CELL).select(F.col("key").alias("token"), "gid")
    shared = cells.groupBy("token").agg(F.min("gid").alias("least"), F.max("gid").alias("most")).where("least < most").select("token", "least")
    met = store(cells.join(shared, "token"), met_at)

    # Stars: each group against the least group of each of its tokens. Linear in the cells.
    stars = met.where("gid <> least").groupBy(F.col("gid").alias("a"), F.col("least").alias("b")).agg(F.count("*").alias("shared"))
    stars = cut(stars)
    hubs = stars.groupBy(F.col("a").alias("gid")).agg(F.max_by("b", F.struct("shared", "b")).alias("hub"))
    near = cut(_over_bound(stars, groups))
    several = members.where("x > 0").groupBy("key").agg(F.min("gid").alias("b"), F.max("gid").alias("most")).where("b < most")
    one_id = members.where("x > 0").join(several, "key").select(F.col("gid").alias("a"), "b")
    alone = groups.select("gid", F.col("gid").alias("block"), F.col("gid").alias("comp"))
    links = cut(near.where("equal").select("a", "b").unionByName(one_id).unionByName(_open(named, members, alone, near.where("not equal"))))
    found = connected_components(links)

    # What is left: tokens that still meet in different components, by blocks of similar groups.
    apart = met.select("token", "gid").distinct().join(found, F.col("gid") == F.col("node"), "left").select("token", "gid", F.coalesce("component", "gid").alias("comp"))
    mixed = apart.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token")
    apart = cut(apart.join(mixed, "token"))
    dealt = _blocks(apart, found, members, groups, hubs)
    blocks = cut(dealt.groupBy(F.col("block").alias("gid")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1")))
    one_comp = F.when(F.col("c0") == F.col("c1"), F.col("c0"))
    cells = apart.join(dealt.select("gid", "block"), "gid").select("token", "block").distinct()
    cells = cells.join(blocks.select(F.col("gid").alias("block"), one_comp.alias("only")), "block")
    side = lambda x: cells.select("token", F.col("block").alias(x), F.col("only").alias(f"only_{x}"))
    meets = side("a").join(side("b"), "token").where(F.col("a") < F.col("b")).where(F.coalesce(F.col("only_a") != F.col("only_b"), F.lit(True)))
    pairs = _over_bound(meets.groupBy("a", "b").agg(F.count("*").alias("shared")), blocks.withColumn("mark", F.lit(None).cast("int"))).select("a", "b")
    rest = cut(pairs.unionByName(blocks.where("c0 < c1").select(F.col("gid").alias("a"), F.col("gid").alias("b"))))
    if not rest.isEmpty():
        links = links.unionByName(_open(named, members, dealt, rest))
        found = connected_components(links)

    known = groups.join(found, F.col("gid") == F.col("node"), "left").select("gid", F.coalesce("component", "gid").alias("comp"), "low_id")
    least_id = known.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    of_group = known.join(least_id, "comp").select("gid", "component_id")
    out = members.join(of_group, "gid", "left").select(
        F.col("key").alias("doc_id"), F.col("x").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )
    nameless = map_texts(docs.select("doc_id", "text").where("doc_id is null"), _sizes, "doc_id bigint, n_shingles bigint, component_id bigint")
    out = cut(out.unionByName(nameless))
    discard(spark, matrix_at, met_at)
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, raw, offsets in slices(batch.column(1)):
            n = high - low
            counts = np.diff(shingle_sets(raw, offsets, WORDS)[1])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(counts, pa.int64()), pa.nulls(n, pa.int64())], ["doc_id", "n_shingles", "component_id"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those whose near-duplicate component has a lesser doc_id.

    Columns are those of the input, of any type. Of rows that share a kept doc_id one stays (the one with the
    least text, nulls first, and of equal texts the one that comes first as JSON); rows with a null doc_id all stay.
    """
    classes = ngram_join(docs)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    twice = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is not null and n > 1").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    one = again.groupBy("doc_id").agg(F.min_by(F.struct(*others), F.struct("text", F.to_json(F.struct(*others)))).alias("row"))  # maps have no order of their own
    one = one.select(*[F.col("doc_id") if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.join(twice, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)
