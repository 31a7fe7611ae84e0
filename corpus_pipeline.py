"""Corpus pipeline: documents pass five stages, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.decontaminate import remove_passages
from tidewell.llm.mixing import mix_sources
from tidewell.llm.ngram_join import keep_one
from tidewell.llm.quality_resampling import drop_poor
from tidewell.llm.shared import discard, scratch
from tidewell.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of high expected severity go.

    Null and empty texts stay; repeated rows go or stay together; columns, whatever their names, are those of docs;
    an empty table gives an empty one.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance draw leaves out go.

    So do null texts and texts without words; rows that tie with the last one drawn stay, repeated rows go or stay
    together; columns, whatever their names, are those of docs; an empty table gives an empty one.
    """
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the least doc_id stays.

    Texts without words have no duplicates and stay; of rows that share a kept doc_id one stays, rows with a null
    doc_id all stay; columns, whatever their names, are those of docs; an empty table gives an empty one.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document of nothing else goes.

    Null and empty texts stay; repeated rows are treated alike; columns, whatever their names, are those of docs; an
    empty table gives an empty one.
    """
    return remove_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, times and taken.

    Null and empty texts have size 0 and may be taken like others of their source, if that has words; a null source
    is a source; equal rows are taken together; input columns of the added names are replaced; an empty table gives an
    empty one.
    """
    return mix_sources(docs).where("times > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages' models are fitted, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table lies in the shared folder until the next one is written.

    Nulls, empty texts, ties, repeated rows and clashing names go by each stage's rule; an empty table gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
