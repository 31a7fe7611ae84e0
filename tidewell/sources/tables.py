"""Scans, sinks, contracts and inspection of tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources import packed_csv

#: Codecs of CSV parts: Spark's own, and those that the packed_csv source adds.
CODECS = {None: "none", "gzip": "gzip", "bz2": "bzip2"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a checkpoint folder that was set.

    Where neither is set, a temporary folder is made and set on one machine; on a cluster this is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tidewell-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder and cut its lineage."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """A frame written once to the shared folder as Parquet and read from there."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def read_csv(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, partitions: int | None = None) -> DataFrame:
    """CSV or CSV.GZ files with a header; columns that a file lacks are NULL.

    Without a schema types are inferred file by file. gz files do not split: partitions spreads what was read.
    """
    frames = [spark.read.csv(p, header=True, schema=schema) if schema else spark.read.csv(p, header=True, inferSchema=True) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.repartition(partitions) if partitions else out


def register_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A Parquet scan under a view name."""
    frame = spark.read.parquet(path)
    frame.createOrReplaceTempView(name)
    return frame


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By suffix: .parquet, .csv, .csv.gz. Unknown suffixes and empty tables are errors."""
    if path.endswith(".parquet"):
        frame = spark.read.parquet(path)
    elif path.endswith((".csv", ".csv.gz")):
        frame = read_csv(spark, path, schema=schema)
    else:
        raise ValueError(f"unknown table format: {path}")
    if frame.isEmpty():
        raise ValueError(f"no rows in {path}")
    return frame


def write_csv(frame: DataFrame, path: str, compression: str | None = None, append: bool = False) -> None:
    """A folder of CSV parts with headers: plain, gzip or bz2 by Spark, xz or zip by the packed_csv source (see read_packed).

    append adds parts to a folder; else it must not exist.
    """
    mode = "append" if append else "errorifexists"
    if compression in packed_csv.CODECS:
        packed_csv.register(frame.sparkSession)
        if not append and packed_csv.parts(path):
            raise ValueError(f"{path} exists already")
        frame.write.format("packed_csv").mode("append").options(path=path, codec=compression).save()
    elif compression in CODECS:
        frame.write.mode(mode).csv(path, header=True, compression=CODECS[compression], escape='"')
    else:
        raise ValueError(f"compression must be one of {sorted(map(str, [*CODECS, *packed_csv.CODECS]))}")


def read_packed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a folder of xz or zip CSV parts that write_csv wrote; a part is read by one task."""
    packed_csv.register(spark)
    return spark.read.format("packed_csv").schema(schema).load(path)


def convert(spark: SparkSession, source: str, target: str, schema: T.StructType | str | None = None) -> None:
    """CSV to Parquet or Parquet to CSV, by the suffix of target."""
    frame = read_any(spark, source, schema)
    if target.endswith(".parquet"):
        frame.write.mode("overwrite").parquet(target)
    else:
        write_csv(frame, target, "gzip" if target.endswith(".gz") else None)


def json_rows(frame: DataFrame) -> DataFrame:
    """Each row as a JSON text (column json); NaN and infinities become null."""

    def safe(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
        return c.alias(field.name)

    return frame.select(F.to_json(F.struct(*[safe(f) for f in frame.schema.fields]), {"ignoreNullFields": "false"}).alias("json"))


def append_log(frame: DataFrame, folder: str) -> None:
    """Append rows to a result log, one folder per data_type."""
    frame.write.mode("append").partitionBy("data_type").parquet(folder)


def _storage(spark: SparkSession, path: str) -> tuple:
    """The Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def append_once(frame: DataFrame, folder: str, batch: str) -> bool:
    """Append a batch to a log; whether it was new. A batch that is repeated, wholly or from the middle, is there once.

    The rows are staged as a part of their own. Then the batch's name is put into the manifest, by creating its file, which
    only one of several writers can; the file names the part. Parts that no manifest file names were left by a job or a
    driver that was lost: readers do not see them.
    """
    spark = frame.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith((".", "_")):
        raise ValueError(f"a batch is named by letters, digits, dots, dashes and underscores, and begins with none of the last two signs: {batch!r}")
    entry, files = _storage(spark, f"{folder}/manifest/{batch}")
    if files.exists(entry):
        return False
    part = f"part-{batch}-{uuid.uuid4().hex}"
    frame.write.parquet(f"{folder}/{part}")
    files.mkdirs(entry.getParent())
    try:
        out = files.create(entry, False)
    except Exception:  # another writer was first
        if not files.exists(entry):
            raise
        files.delete(_storage(spark, f"{folder}/{part}")[0], True)
        return False
    out.write(bytearray(part.encode()))
    out.close()
    return True


def appended(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(batch, path of its part) of all batches of a log, by name."""
    entry, files = _storage(spark, f"{folder}/manifest")
    if not files.exists(entry):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(entry) if s.getLen() > 0)
    return [(n, f"{folder}/{spark._jvm.org.apache.commons.io.IOUtils.toString(files.open(_storage(spark, f'{folder}/manifest/{n}')[0]), 'UTF-8')}") for n in names if not n.startswith((".", "_"))]


def read_appended(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all batches of a log, each once; no rows where there is no batch."""
    paths = [p for _, p in appended(spark, folder)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def save_bucketed(frame: DataFrame, name: str, key: str | Sequence[str], buckets: int) -> DataFrame:
    """A catalog table (namespace.table), bucketed and sorted by its key, and its scan.

    Tables of equally many buckets join and group on the key without a shuffle: the one shuffle is paid when they are
    written. Rows are dealt to their buckets first, so that a bucket is one file.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = frame.sparkSession
    if "." in name:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name.rpartition('.')[0]}")
    frame.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def scan(spark: SparkSession, name: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """A schema-qualified catalog table; an error if it does not exist. columns: optional ones (name to type), typed NULLs where the table lacks them."""
    require(spark, [name])
    return with_optional(spark.table(name), columns or {})


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small dimension from literals."""
    return spark.createDataFrame(list(rows), schema)


def missing_inputs(spark: SparkSession, tables: Sequence[str]) -> list[str]:
    """The required tables or views that do not exist."""
    return [t for t in tables if not spark.catalog.tableExists(t)]


def require(spark: SparkSession, tables: Sequence[str]) -> None:
    if missing := missing_inputs(spark, tables):
        raise ValueError(f"missing tables: {', '.join(missing)}")


def with_optional(frame: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns (name to type) that the table lacks, as typed NULLs."""
    return frame.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in frame.columns})


def inspect(frame: DataFrame) -> DataFrame:
    """(column, type, n_rows, null_frac) of every column, from one pass."""
    names = frame.columns
    one = frame.agg(F.count("*").alias("n"), *[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"f{i}") for i, c in enumerate(names)])
    kinds = dict(frame.dtypes)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("n").alias("n_rows"), F.col(f"f{i}").alias("null_frac")) for i, c in enumerate(names)]))
    return one.select(rows.alias("r")).select("r.*")


def head(frame: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an order; without one, any n rows."""
    return (frame.orderBy(*order) if order else frame).limit(n)


def distinct_values(frame: DataFrame, columns: Sequence[str], where: str | None = None, limit: int = 1000) -> DataFrame:
    """Distinct combinations of columns, in their order, up to a limit."""
    picked = (frame.where(where) if where else frame).select(*columns).distinct()
    return picked.orderBy(*columns).limit(limit)
