"""Mixing sources to target weights by cube-method balanced sampling.

A source's target divided by its size is how often each of its documents is wanted: a whole
number of times, and once more with a fractional probability. Which documents are taken once
more is drawn by the cube method (Deville and Tille 2004): the vector of probabilities walks
through the null space of the balancing constraints, here the number of documents and
of words, until only a few are not 0 or 1. The walk runs in parallel blocks; what each leaves
open meets in the next, smaller round, and only the last one is landed.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.shared import SPACED_WORD, cut, fresh_names, replace_columns
from tidewell.operators.ranks import numbered

BLOCK = 2000
#: Largest table of sources that is broadcast; beyond it a source's documents are dealt into SALTS parts and joined by shuffle.
MOST_BROADCAST = 100_000
SALTS = 16


def shared_targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target, the words each source should give, to totals (source string, words bigint; one row a source).

    Sources in code point order, null last, take the weights in turn. Together they get share times
    all words; none gets more than `most` times its own, and what is over goes to the others by weight. The driver only
    holds the number of words that a weight of 1 stands for, which grows until no further source is full.
    """
    placed = numbered(totals.withColumn("__last", F.col("source").isNull()), "__last", "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("__rank") - 1, F.lit(len(weights))).cast("int"))
    rows = cut(placed.withColumn("__weight", weight).select(*totals.columns, "__weight"))
    everything = rows.agg(F.sum("words")).first()[0] or 0
    unit, full = None, F.lit(False)
    while True:
        open_weight, held = rows.agg(F.sum(F.when(~full, F.col("__weight"))), F.sum(F.when(full, F.col("words")))).first()
        now = (share * everything - most * (held or 0)) / open_weight if open_weight else 0.0
        if now == unit or not open_weight:
            break
        unit = now
        full = full | (F.col("__weight") * unit > most * F.col("words"))
    target = F.when(full, most * F.col("words")).otherwise(F.col("__weight") * now)
    return rows.withColumn("target", target.cast("double")).drop("__weight")


def flight(chances: list[float], sizes: list[float], draw: random.Random) -> list[float]:
    """Moves probabilities to 0 or 1 while their sum and their size-weighted sum stay, as far as that goes.

    The largest open unit moves against all smaller ones, each of which gives way a little, until it
    is settled. So the units left open, two at most, are the smallest and their landing costs little.
    """
    order = np.argsort(-np.asarray(sizes, float), kind="stable")
    p, s = np.asarray(chances, float)[order], np.asarray(sizes, float)[order]
    for lead in range(len(p)):
        while 0 < p[lead] < 1:
            rest = lead + 1 + np.flatnonzero((p[lead + 1 :] > 0) & (p[lead + 1 :] < 1))
            own = s[rest]
            if len(rest) < 2:
                if not len(rest) or own[0] != s[lead]:
                    break
                turn = np.array([-1.0])
            else:
                mean = own.mean()
                apart = own - mean
                square = float(apart @ apart)
                if square > 1e-9 * (1 + mean * mean):
                    turn = -(1 / len(rest) + (s[lead] - mean) * apart / square)
                elif abs(s[lead] - mean) <= 1e-9 * (1 + mean):
                    turn = np.full(len(rest), -1 / len(rest))
                else:
                    break
            units, turn = np.append(rest, lead), np.append(turn, 1.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                to_one, to_zero = (1 - p[units]) / np.abs(turn), p[units] / np.abs(turn)
            up = np.where(turn > 0, to_one, np.where(turn < 0, to_zero, np.inf)).min()
            down = np.where(turn > 0, to_zero, np.where(turn < 0, to_one, np.inf)).min()
            p[units] += turn * (up if draw.random() * (up + down) < down else -down)
            p[units] = np.where(p[units] < 1e-9, 0.0, np.where(p[units] > 1 - 1e-9, 1.0, p[units]))
    out = np.empty(len(p))
    out[order] = p
    return out.tolist()


def landing(chances: list[float], sizes: list[float], draw: random.Random) -> list[float]:
    """Settles what flight left: words first, then one draw."""
    p = list(chances)
    while len(hold := [i for i in range(len(p)) if 0 < p[i] < 1]) > 1:
        a, b = hold[:2]
        d = [sizes[b] or 1e-12, -(sizes[a] or 1e-12)]
        scale = max(map(abs, d))
        d = [x / scale for x in d]
        up, down = min((1 - p[a]) / d[0], p[b] / -d[1]), min(p[a] / d[0], (1 - p[b]) / -d[1])
        move = up if draw.random() * (up + down) < down else -down
        for i, x in ((a, d[0]), (b, d[1])):
            p[i] = min(max(p[i] + move * x, 0.0), 1.0)
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = float(p[i] > 0.5)
    for i in hold:
        p[i] = float(draw.random() < p[i])
    return p


def _settle(seed: int, land: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "doc_id", "mark"], kind="stable", na_position="last")
        draw = random.Random(f"{seed}:{int(frame['place'].iloc[0])}:{len(frame)}:{land}")
        units = (frame["words"] * 1.0).tolist()
        p = flight(frame["chance"].tolist(), units, draw)
        return frame.assign(chance=landing(p, units, draw) if land else p)

    return run


def draws(sized: DataFrame, seed: int = 11, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, mark, size, source_size, target, times): how often each document is taken.

    sized: doc_id bigint, source string, mark (a hash of the text) and size bigint. Rows of one id, source and
    mark are one unit and are drawn together.
    """
    units = sized.groupBy("doc_id", "source", "mark").agg(F.max("size").alias("size"), F.count("*").alias("rows"))
    units = cut(units.withColumns({"words": F.col("size") * F.col("rows"), "place": F.xxhash64(F.lit(seed), "doc_id", "size", "mark")}))
    totals = units.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    plan = shared_targets(totals, weights, share, most)
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    plan = plan.select("source", F.col("words").alias("source_size"), "target", F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("chance"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    plan = cut(plan)
    told = ["source_size", "target", "whole", "chance", "blocks"]
    if plan.count() <= MOST_BROADCAST:
        same = F.col("u.source").eqNullSafe(F.col("p.source"))
        planned = units.alias("u").join(F.broadcast(plan).alias("p"), same).select("u.*", *[f"p.{c}" for c in told])
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        same = F.col("u.source").eqNullSafe(F.col("p.source")) & (F.col("u.salt") == F.col("p.salt"))
        planned = units.withColumn("salt", F.pmod("place", F.lit(SALTS))).alias("u").join(salted.alias("p"), same).select("u.*", *[f"p.{c}" for c in told]).drop("salt")
    names = ["doc_id", "source", "mark", "size", "words", "place", "source_size", "target", "whole", "chance", "block"]
    kinds = ["bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint", "double", "int", "double", "bigint"]
    fields = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    out = lambda frame, times: frame.select("doc_id", "source", "mark", "size", "source_size", "target", times.cast("int").alias("times"))
    settled = out(planned.where("chance <= 1e-12"), F.col("whole"))
    open_ = planned.where("chance > 1e-12").withColumn("block", F.pmod("place", "blocks")).select(*names)
    most_left = plan.agg(F.max("blocks")).first()[0] or 0
    while True:
        last = most_left <= 1
        done = cut(open_.groupBy("source", "block").applyInPandas(_settle(seed, last), fields))
        settled = settled.unionByName(out(done.where("chance = 0 or chance = 1"), F.col("whole") + F.col("chance").cast("int")))
        if last:
            return settled
        left = 3 * most_left  # a block leaves two units open at most
        most_left = -(-left // BLOCK)
        open_ = done.where("chance > 0 and chance < 1").withColumn("block", F.pmod(F.xxhash64(F.lit(left), "place"), F.lit(most_left)))


def mix_sources(docs: DataFrame, seed: int = 11, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Documents with the number of times the mix takes them.

    docs: doc_id bigint, text string, source string and any others, which pass through. Adds size (words of the
    text, null and empty: 0), source_size, target, times (int) and taken (size * times, bigint); input columns of these names
    are replaced. No document is taken more than `most` times (rounded up), each source's taken words
    differ from its target by about one document, and a rerun over the same rows agrees. A source
    whose texts have no words is taken 0 times. A null source is a source; rows of one id, source and text are drawn
    together, a null id is one of them. No documents, no rows. Any number of sources.
    """
    docs = replace_columns(docs, "size", "source_size", "target", "times", "taken")
    (mark,) = fresh_names(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))  # ahead of the join, so that texts pass it only if they are asked for
    sized = marked.select("doc_id", "source", F.col(mark).alias("mark"), F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("bigint").alias("size"))
    units = draws(sized, seed, weights, share, most)
    same = F.col("d.doc_id").eqNullSafe(F.col("u.doc_id")) & F.col("d.source").eqNullSafe(F.col("u.source")) & (F.col(f"d.{mark}") == F.col("u.mark"))
    added = [F.col(f"u.{c}") for c in ("size", "source_size", "target", "times")]
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    return marked.alias("d").join(units.alias("u"), same).select(*own, *added, (F.col("u.size") * F.col("u.times")).alias("taken"))
