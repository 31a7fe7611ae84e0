"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a bigint, b bigint); component is its least node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each is a minimum with
    map-side combine and a join, so no neighbourhood is gathered in one place. Every round is
    checkpointed; the driver only sees a count and a hash of the edge table. Loops, repeated
    and reversed edges are allowed; no edges give no rows.
    """
    now = cut(_down(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(_down(small.unionByName(floor.withColumnRenamed("m", "v"))))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
