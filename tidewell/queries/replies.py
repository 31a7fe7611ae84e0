"""Batch scoring of customers by a text model: prompts, replies made from the table, repair, validation, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import scoring
from tidewell.queries.base import query, table
from tidewell.sources import tables as IO

TEMPLATE = "Rows:\n{data}\nAnswer."


def _people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return scoring.chunks(_people(spark, d), "id", 8)


#: One item text per customer; its defect goes by the id.
_ITEM = """CASE id % 9 WHEN 0 THEN '{' || id || ', 0.' || id % 10 || '}' WHEN 1 THEN '{id: ' || id || ', cate: -0.' || id % 10 || '}' WHEN 2 THEN '{"id": ' || id || ', 0.25}' WHEN 3 THEN '{"": ' || id || ', "cate": 0.5}' WHEN 4 THEN '{"id": ' || id || ', "": 0.75}'
WHEN 5 THEN '{"id": "' || id || '", "cate": 0.1}' WHEN 6 THEN '{"id": ' || id || ', "cate": 1.5}' WHEN 7 THEN '{"id": ' || id || ', "cate": 0.1, "x": 1}' ELSE '{"id": ' || id || ', "cate": 0.125}' END"""
#: The items that survive, as SQL over customer.
_KEPT = """k AS (SELECT id, chunk, CASE id % 9 WHEN 0 THEN (id % 10) / 10.0 WHEN 1 THEN -(id % 10) / 10.0 WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 WHEN 4 THEN 0.75 WHEN 6 THEN 1.5 WHEN 8 THEN 0.125 END AS cate FROM c WHERE id % 9 NOT IN (5, 7))"""
_C = "c AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment, (row_number() OVER (ORDER BY c_custkey) - 1) // 8 AS chunk FROM customer)"


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """One reply per chunk: its items in id order, the first one twice, with text around."""
    rows = _chunked(spark, d).withColumn("item", F.expr(_ITEM))
    per = rows.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "item"))), lambda r: r["item"]).alias("items"))
    return per.select("chunk", F.concat(F.lit("Here: ["), F.array_join("items", ", "), F.lit(", "), F.get("items", F.lit(0)), F.lit("] done")).alias("reply"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return scoring.reply_items(scoring.reply_blocks(_replies(spark, d), "chunk", "reply"), "chunk")


@query(f"WITH {_C} SELECT id, CAST(chunk AS BIGINT) AS chunk FROM c WHERE id % 3 <> 0")
def chunked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by position; rows already processed go after chunking."""
    return scoring.chunks(_people(spark, d), "id", 8, _people(spark, d).where("id % 3 = 0")).select("id", "chunk")


@query(f"""WITH {_C} SELECT CAST(chunk AS BIGINT) AS chunk, 'Rows:' || chr(10) || 'id,c_nationkey,c_mktsegment' || chr(10) || string_agg(id || ',' || c_nationkey || ',' || c_mktsegment, chr(10) ORDER BY id) || chr(10) || 'Answer.' AS prompt, count(*) AS n_ids FROM c GROUP BY chunk""")
def prompt_chunks(spark: SparkSession, d: str) -> DataFrame:
    return scoring.prompts(_chunked(spark, d), "id", ["c_nationkey", "c_mktsegment"], TEMPLATE).select("chunk", "prompt", F.size("ids").cast("bigint").alias("n_ids"))


@query(f"""WITH {_C} SELECT CAST(chunk AS BIGINT) AS chunk, count(*) + 1 AS n_blocks FROM c GROUP BY 1""")
def reply_blocks(spark: SparkSession, d: str) -> DataFrame:
    return scoring.reply_blocks(_replies(spark, d), "chunk", "reply").groupBy("chunk").agg(F.count("entries").alias("n_blocks"))


@query(f"WITH {_C}, {_KEPT} SELECT CAST(chunk AS BIGINT) AS chunk, id, CAST(cate AS DOUBLE) AS cate FROM k", "cate")
def reply_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)


@query(f"WITH {_C}, {_KEPT} SELECT CAST(c.chunk AS BIGINT) AS chunk, c.id, CASE WHEN cate IS NULL THEN 'missing' WHEN abs(cate) > 1 THEN 'out_of_range' END AS reason FROM c LEFT JOIN k USING (id)")
def validated_items(spark: SparkSession, d: str) -> DataFrame:
    return scoring.validated(_items(spark, d), _chunked(spark, d), "chunk").select("chunk", "id", "reason")


@query(f"""WITH {_C}, n AS (SELECT chunk, count(*) AS n FROM c GROUP BY 1) SELECT CAST(chunk AS BIGINT) AS chunk, chunk % 3 = 0 AS ok, CASE WHEN chunk % 3 = 0 THEN n * 0.5::DOUBLE END AS total FROM n""", "total")
def strict_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Whole-text arrays: right ones, ones with shifted ids, and ones with text around."""
    n = _chunked(spark, d).groupBy("chunk").agg(F.count("*").cast("int").alias("n"))
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit('{"id": '), (i + F.when(F.col("chunk") % 3 == 1, 1).otherwise(0)).cast("string"), F.lit(', "cate": 0.5}')))
    text = F.concat(F.when(F.col("chunk") % 3 == 2, "answer: ").otherwise(""), F.lit("["), F.array_join(ids, ","), F.lit("]"))
    out = scoring.strict_array(n.withColumn("text", text), "chunk", "text", "n")
    return out.select("chunk", "ok", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""WITH {_C}, {_KEPT}, m AS (SELECT c.chunk, c.id FROM c LEFT JOIN k USING (id) WHERE cate IS NULL OR abs(cate) > 1) SELECT CAST(chunk AS BIGINT) AS chunk, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS missing FROM m GROUP BY 1""")
def retry_prompts(spark: SparkSession, d: str) -> DataFrame:
    chunked = _chunked(spark, d)
    checked = scoring.validated(_items(spark, d), chunked, "chunk")
    out = scoring.retry_frame(scoring.prompts(chunked, "id", ["c_nationkey"], TEMPLATE), checked, "chunk", 2)
    return out.select("chunk", F.substring_index("prompt", "these ids: ", -1).alias("missing"))


@query(f"""WITH {_C}, {_KEPT}, f AS (SELECT c.id, cate IS NOT NULL AND abs(cate) <= 1 AS ok, CAST(CASE c.id % 9 WHEN 5 THEN 1 WHEN 7 THEN 3 ELSE 0 END AS INTEGER) AS retries FROM c LEFT JOIN k USING (id))
SELECT id, CASE WHEN ok THEN 'success' WHEN retries = 1 THEN 'retry_failed' WHEN retries = 3 THEN 'failed' ELSE 'missing' END AS status,
CASE WHEN ok THEN '' WHEN retries = 1 THEN 'retry 1 brought no value' WHEN retries = 3 THEN 'no value after all retries' ELSE 'no value in the reply' END AS error, retries FROM f UNION ALL SELECT -1, 'extra', 'not asked for', NULL""")
def status_report(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d)
    good = _items(spark, d).where(scoring.value_reason(F.col("cate")).isNull()).select("id")
    extra = good.unionByName(spark.createDataFrame([(-1,)], "id bigint"))
    again = people.where("id % 9 in (5, 7)").select("id", F.expr("case when id % 9 = 5 then 1 else 3 end as retries"))
    return scoring.status_report(people, extra, again)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 1")
def resumed_rows(spark: SparkSession, d: str) -> DataFrame:
    path = IO.scratch(spark, "results")
    IO.append_log(_people(spark, d).where("id % 4 = 1").select("id", F.lit("result").alias("data_type")), path)
    return scoring.resume(_people(spark, d), spark.read.parquet(path), "id").select("id")


def stub_scorer(prompt: str) -> str:
    """Scores every row of a prompt by its id, but ids that end in 3 only when they are asked for again."""
    body, _, again = prompt.partition("Attempt")
    asked = {x.strip() for x in again.rpartition(":")[2].split(",")} if again else set()
    ids = [line.split(",")[0] for line in body.splitlines() if line.split(",")[0].isdigit()]
    return "[" + ", ".join(f'{{"id": {i}, "cate": {int(i) % 10 / 10}}}' for i in ids if not i.endswith("3") or i in asked) + "]"


@query("SELECT c_custkey AS id, (c_custkey % 10) / 10.0 AS cate FROM customer", "cate")
def stub_scored(spark: SparkSession, d: str) -> DataFrame:
    """Prompts through a scorer with one retry round; every id ends up with a score."""
    chunked = _chunked(spark, d)
    prompts = scoring.prompts(chunked, "id", ["c_nationkey"], TEMPLATE)
    return scoring.score_with_retries(prompts, chunked, stub_scorer, "chunk", 3).select("id", "cate")


def failing_scorer(prompt: str) -> str:
    """stub_scorer, but for prompts whose first row has an id that ends in 7, which fail."""
    first = next(line.split(",")[0] for line in prompt.splitlines() if line.split(",")[0].isdigit())
    if first.endswith("7"):
        raise RuntimeError("service is busy")
    return stub_scorer(prompt)


@query(f"""WITH {_C}, f AS (SELECT chunk, min(id) % 10 = 7 AS failed, count(*) AS n FROM c GROUP BY 1) SELECT CAST(chunk AS BIGINT) AS chunk, failed, CASE WHEN failed THEN 'RuntimeError: service is busy' END AS error FROM f""")
def concurrent_scores(spark: SparkSession, d: str) -> DataFrame:
    """One reply or error for each prompt, several under way in each task; failing prompts fail alone."""
    prompts = scoring.prompts(_chunked(spark, d), "id", ["c_nationkey"], TEMPLATE)
    called = scoring.call_scorer(prompts, failing_scorer, "chunk", at_once=8, tries=1)
    return called.select("chunk", F.col("reply").isNull().alias("failed"), "error")
