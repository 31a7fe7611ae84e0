"""Secret scans with an incremental ledger of blobs.

A version of a text is addressed by the SHA-256 of its content, its blob. The ledger is a folder of runs; a run has
a row for each blob it scanned: which rules, in which version, and what they found. An update addresses all versions,
takes the pairs of blob and rule version that no finished run has, reads the text of one version of each such blob, and
scans it with the missing rules only. Findings are then joined back to every path. A run without its success mark,
which Spark's committer writes last, counts for nothing and is made again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import discard, fresh_names, map_texts, replace_columns, store


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern whose group has at least so many characters; ASCII letters in either case if any_case."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Tokens that public services mark by a prefix, keys in PEM form, logins inside URLs.
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]+-----END ([A-Z]+ )?PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._~%-]{1,64}:[A-Za-z0-9._~%!$&*+=-]{1,64}@"),
)
RULES = BASE_RULES + ADDED_RULES

_FINDINGS = "array<struct<start:int,kind:string,end:int>>"
_ARROW_FINDINGS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def _matcher(rule: Rule) -> re.Pattern:
    # a rule of one greedy class is told its least length, which spares all shorter runs
    pattern = rule.pattern.removesuffix("+") + f"{{{rule.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else rule.pattern
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def spans_of(text: str, rule: Rule, matcher: re.Pattern | None = None) -> list[tuple[int, int]]:
    """Code point spans, end exclusive, that a rule finds in a text."""
    return [m.span() for m in (matcher or _matcher(rule)).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(blob, rules, findings) of all finished runs."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run-*/_SUCCESS")
    done = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    paths = [str(s.getPath().getParent()) for s in done or ()]
    schema = f"blob binary, rules array<string>, findings {_FINDINGS}"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _scan(todo: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rules, findings) of rows of (blob, rules, text): each text is scanned with its rules."""
    known = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {name: _matcher(rule) for name, rule in known.items()}
        for batch in batches:
            blobs, named, texts = batch.columns
            found = [
                [{"start": a, "kind": known[name].kind, "end": b} for name in names for a, b in spans_of(text or "", known[name], matchers[name])]
                for names, text in zip(named.to_pylist(), (t.as_py() for t in texts), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([blobs, named, pa.array(found, _ARROW_FINDINGS)], names=["blob", "rules", "findings"])

    return map_texts(todo.select("blob", "rules", "text"), run, f"blob binary, rules array<string>, findings {_FINDINGS}")


def _address(versions: DataFrame) -> DataFrame:
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))


def update_ledger(versions: DataFrame, addressed: DataFrame, key: str, folder: str, rules: Sequence[Rule] = RULES) -> str:
    """Scan what the ledger lacks and add it as one run, whose folder is returned.

    versions: key and text; addressed: the same rows' key and blob. One version of a blob is read, the one of least key.
    """
    spark = versions.sparkSession
    asked = F.array(*[F.lit(r.name) for r in rules])
    seen = read_ledger(spark, folder).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    one = addressed.groupBy("blob").agg(F.min(key).alias("key"))  # null only if all keys are
    todo = one.join(seen, "blob", "left").select("blob", "key", F.array_except(asked, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where("size(rules) > 0")
    texts = _address(versions.select(F.col(key).alias("own"), "text")).withColumnRenamed("blob", "own_blob")
    picked = texts.join(todo, (F.col("blob") == F.col("own_blob")) & F.col("key").eqNullSafe(F.col("own")))
    path = f"{folder}/run-{uuid.uuid4().hex}"
    _scan(picked, rules).write.parquet(path)
    return path


def scan_versions(versions: DataFrame, key: str, folder: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The versions without their text, with blob (hex) and findings: array of (start, kind, end), by start, then in the order of rules.

    versions: an orderable key (a path, or an id), text, and other columns, which pass through; input columns blob and
    findings are replaced. The ledger in folder is brought up to date first. Versions of equal content share a blob
    and are scanned once, over all runs; a rule of a new version is scanned anew, the others are not. Findings count
    only in the rules' own versions. A null text is empty, an empty text has no findings; texts are scanned whole,
    however long; null keys, repeated rows and ties pass through; no versions, no rows.
    """
    spark = versions.sparkSession
    rest = replace_columns(versions, "blob", "findings")
    (own_text,) = fresh_names(rest, "found_in")
    addressed = store(_address(rest).drop("text"), f"{folder}/paths-{uuid.uuid4().hex}")
    update_ledger(rest.select(key, "text"), addressed.select(key, "blob"), key, folder, rules)
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.array(*[F.lit(r.name) for r in rules])
    found = read_ledger(spark, folder).where(F.arrays_overlap("rules", current)).where("size(findings) > 0")
    # a run may have scanned old versions of some rules: what a kind found counts only if its current rule was among the run's
    by_kind = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.name)])
    lines = found.select("blob", "rules", F.explode("findings").alias("f")).where(F.array_contains("rules", F.element_at(by_kind, F.col("f.kind"))))
    per = lines.select("blob", F.struct("f.start", F.element_at(place, F.col("f.kind")).alias("no"), "f.kind", "f.end").alias("f")).distinct().groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias(own_text))
    out = addressed.join(per, "blob", "left").withColumn("findings", F.coalesce(F.transform(own_text, lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end"))), F.array().cast(_FINDINGS)))
    own = [F.col(f"`{c}`") for c in addressed.columns if c != "blob"]
    return out.select(*own, F.lower(F.hex("blob")).alias("blob"), "findings")


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a ledger."""
    discard(spark, folder)
