"""Shared storage, lineage cuts and small column helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.tables import cut, scratch, shared_folder

__all__ = ["SPACED_WORD", "ascii_lower", "best_cut", "cut", "discard", "fresh_names", "hash_unit", "map_texts", "replace_columns", "scratch", "shared_folder", "store"]

#: Words of the corpus contracts: runs of anything but space and \t \n \v \f \r.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch of texts, where the session has Spark's own number.
BATCH_ROWS = 1000


def map_texts(frame: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow over rows that hold texts: smaller batches keep tasks and workers small.

    A batch size that the session sets otherwise than Spark's default stays.
    """
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, BATCH_ROWS)
    return frame.mapInArrow(function, schema)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as Parquet and read it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that scratch() named."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator is about to add (its own win)."""
    lowered = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered])


def fresh_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with underscores behind it until no column of the frame is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_unit(*cols: Column) -> Column:
    """A uniform number in (0, 1) that depends on the given values alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def best_cut(scores: list[float], positive: list[bool]) -> float | None:
    """The cut that best parts high-scoring positives from the rest.

    Fewest rows on the wrong side; of equally good cuts the middle of the widest gap.
    None if one of the two classes is empty.
    """
    if not any(positive) or all(positive):
        return None
    ranked = sorted(zip(scores, positive, strict=True), reverse=True)
    hits = misses = 0
    best, found = (-len(ranked), 0.0), ranked[0][0]
    for i, (score, good) in enumerate(ranked):
        hits, misses = hits + good, misses + (not good)
        below = ranked[i + 1][0] if i + 1 < len(ranked) else score
        if below == score and i + 1 < len(ranked):
            continue
        merit = (hits - misses, score - below)
        if merit > best:
            best, found = merit, (score + below) / 2
    return found
