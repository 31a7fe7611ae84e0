"""How queries are registered: a function over (spark, folder) and its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to 6 digits: sums of doubles depend on their order in the last ones."""
    return frame.withColumns({c: F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0) for c, t in frame.dtypes if t == "double"})


def query(sql: str | None = None, doubles: str = ""):
    """Registers a query under its function's name; doubles names the SQL's double columns, which are rounded alike."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(f(spark, folder))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            names = doubles.split()
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) + 0.0 AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return run

    return register


#: Columns that tell a report section's rows apart.
LABELS = ("arm", "feature", "quantity", "threshold", "risk_bin", "column")


def long_report(report: DataFrame) -> DataFrame:
    """(section, item, measure, value, text) of every non-null measure of a (section, json) report."""
    rows = report.select("section", F.from_json("json", "map<string,string>").alias("m"))
    item = F.coalesce(*[F.try_element_at("m", F.lit(c)) for c in LABELS], F.lit(""))
    long = rows.select("section", item.alias("item"), F.explode(F.map_filter("m", lambda k, v: v.isNotNull() & ~k.isin(*LABELS))).alias("measure", "v"))
    value = F.col("v").try_cast("double")
    return long.select("section", "item", "measure", value.alias("value"), F.when(value.isNull(), F.col("v")).alias("text"))


def long_sql(**sections: tuple[str | None, str]) -> str:
    """The SQL of long_report from each section's (label column, SQL)."""
    parts = []
    for name, (label, sql) in sections.items():
        item, rest = (f'CAST("{label}" AS VARCHAR)', f'* EXCLUDE ("{label}")') if label else ("''", "*")
        one = f"SELECT {item} AS __item, CAST(COLUMNS({rest}) AS VARCHAR) FROM ({sql})"
        parts.append(f"SELECT '{name}' AS section, __item AS item, measure, TRY_CAST(v AS DOUBLE) AS value, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS text FROM (UNPIVOT ({one}) ON COLUMNS(* EXCLUDE (__item)) INTO NAME measure VALUE v)")
    return " UNION ALL ".join(parts)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as the cohort of the event table."""
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))


#: SQL of the spine that most event queries use: a user's first error.
T0 = """t0 AS (SELECT user_id, ts AS t0, value AS t0_value FROM (
  SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events e JOIN customer ON c_custkey = user_id WHERE event_type = 'error') WHERE rn = 1)"""
