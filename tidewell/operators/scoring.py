"""The data side of batch scoring by a language model: chunks, prompts, reply repair, validation, resume."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.operators.ranks import numbered
from tidewell.sources.tables import cut, stored

#: Names of an item's entries by place, where a reply leaves them out.
ITEM_KEYS = ("id", "cate")
_JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_JSON_INT = r"^-?(0|[1-9][0-9]*)$"


def chunks(frame: DataFrame, key: str, size: int, done: DataFrame | None = None) -> DataFrame:
    """Adds chunk: rows in key order, `size` to a chunk; rows whose key is in done go afterwards, so chunk numbers never shift."""
    ranked = numbered(frame.select(key), key)
    out = frame.join(ranked.select(key, F.floor((F.col("__rank") - 1) / size).alias("chunk")), key)
    return out.join(done.select(key).distinct(), key, "left_anti") if done is not None else out


def prompts(chunked: DataFrame, key: str, columns: Sequence[str], template: str, mark: str = "{data}") -> DataFrame:
    """(chunk, prompt, ids): each chunk's rows as CSV with a header, by numeric key, put into the template."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *columns)])
    rows = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    per = chunked.groupBy("chunk").agg(rows.alias("rows"))
    text = F.concat(F.lit(",".join((key, *columns)) + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return per.select("chunk", F.replace(F.lit(template), F.lit(mark), text).alias("prompt"), F.transform("rows", lambda r: r["k"]).alias("ids"))


def reply_blocks(replies: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, block, entries): what a reply has between an opening brace and the next closing one, split into named entries.

    entries: array of (name, value) texts, one for each part between commas. A part `name: value` has its name without
    quotes and blanks; where a part has no name, or an empty one, its place names it (see ITEM_KEYS). So all the usual
    defects (bare names, values alone, empty names) are read by one rule, and nothing is rewritten.
    """
    opened = F.slice(F.split(F.col(text), r"\{"), F.lit(2), F.greatest(F.size(F.split(F.col(text), r"\{")) - 1, F.lit(0)))
    closed = F.filter(opened, lambda part: F.locate("}", part) > 1)
    out = replies.select(key, F.posexplode(F.transform(closed, lambda part: F.substring_index(part, "}", 1))).alias("pos", "block"))
    place = F.array(*[F.lit(k) for k in ITEM_KEYS])

    def entry(part: Column, i: Column) -> Column:
        named = F.contains(part, F.lit(":"))
        name = F.when(named, F.trim(F.translate(F.substring_index(part, ":", 1), '"', ""))).otherwise("")
        value = F.trim(F.when(named, F.substring(part, F.locate(":", part) + 1, F.length(part))).otherwise(part))
        return F.struct(F.when(name != "", name).otherwise(F.coalesce(F.get(place, i), F.lit(""))).alias("name"), value.alias("value"))

    return out.withColumn("entries", F.transform(F.split("block", ","), entry))


def reply_items(blocks: DataFrame, key: str) -> DataFrame:
    """(key, id, cate): blocks whose entries are exactly id and cate, with a whole id and a numeric value; of a repeated id the first counts."""
    right = F.array_sort(F.transform("entries", lambda e: e["name"])) == F.array(F.lit("cate"), F.lit("id"))
    of = lambda name: F.get(F.filter("entries", lambda e: e["name"] == name), F.lit(0))["value"]
    good = right & of("id").rlike(_JSON_INT) & of("cate").rlike(_JSON_NUMBER)
    parsed = blocks.where(F.coalesce(good, F.lit(False))).select(key, "pos", of("id").try_cast("bigint").alias("id"), of("cate").try_cast("double").alias("cate"))
    order = Window.partitionBy(key, "id").orderBy("pos")
    return parsed.where("id is not null").withColumn("rn", F.row_number().over(order)).where("rn = 1").select(key, "id", "cate")


def value_reason(value: Column) -> Column:
    """NULL for a valid score, else missing, nan, infinite or out_of_range."""
    return F.when(value.isNull(), "missing").when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), "infinite").when(~value.between(-1.0, 1.0), "out_of_range")


def validated(items: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, id, cate, reason) of every expected (key, id): reason NULL where the score is valid."""
    return expected.select(key, "id").join(items, [key, "id"], "left").withColumn("reason", value_reason(F.col("cate")))


def strict_array(replies: DataFrame, key: str, text: str, expected_size: str) -> DataFrame:
    """(key, ok, scores): the whole text is one JSON array of {id, cate} of the expected length, ids in order from 0."""
    rows = F.from_json(F.col(text), "array<struct<id:bigint,cate:double>>")
    right = F.coalesce(
        F.trim(text).startswith("[") & (F.size(rows) == F.col(expected_size)) & F.forall(F.transform(rows, lambda r, i: r["id"].eqNullSafe(i.cast("bigint")) & r["cate"].isNotNull()), lambda x: x), F.lit(False)
    )
    return replies.select(key, right.alias("ok"), F.when(right, F.transform(rows, lambda r: r["cate"])).alias("scores"))


def retry_frame(prompt_rows: DataFrame, checked: DataFrame, key: str, attempt: int) -> DataFrame:
    """(key, prompt, missing): prompts to send again, naming the ids that are still without a valid score."""
    missing = checked.where("reason is not null").groupBy(key).agg(F.sort_array(F.collect_set("id")).alias("missing"))
    note = F.concat(F.lit(f"\n\nAttempt {attempt}. Return one object for each of these ids: "), F.array_join(F.transform("missing", lambda i: i.cast("string")), ", "))
    return prompt_rows.join(missing, key).select(key, F.concat("prompt", note).alias("prompt"), "missing")


def status_report(expected: DataFrame, received: DataFrame, retried: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(id, status, error, retries) of every id asked for or received.

    retried: (id, retries), how often an id was asked for again. success; missing (never asked again); retry_failed (asked
    again, fewer than `most` times so far); failed (all retries used up); extra (never asked for, retries NULL).
    """
    want, got = expected.select("id").distinct().withColumn("__want", F.lit(1)), received.select("id").distinct().withColumn("__got", F.lit(1))
    out = want.join(got, "id", "full_outer")
    again = retried.groupBy("id").agg(F.max("retries").cast("int").alias("__again")) if retried is not None else None
    out = out.join(again, "id", "left") if again is not None else out.withColumn("__again", F.lit(None).cast("int"))
    times = F.coalesce("__again", F.lit(0))
    extra, success = F.col("__want").isNull(), F.col("__got").isNotNull()
    status = F.when(extra, "extra").when(success, "success").when(times == 0, "missing").when(times < most, "retry_failed").otherwise("failed")
    error = F.when(extra, "not asked for").when(success, "").when(times == 0, "no value in the reply").when(times < most, F.concat(F.lit("retry "), times.cast("string"), F.lit(" brought no value"))).otherwise("no value after all retries")
    return out.select("id", status.alias("status"), error.alias("error"), F.when(~extra, times).alias("retries"))


def require_complete(report: DataFrame) -> None:
    bad = {r["status"]: r["n"] for r in report.where("status <> 'success'").groupBy("status").agg(F.count("*").alias("n")).collect()}
    if bad:
        raise ValueError(f"ids do not match: {bad}")


def resume(frame: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Rows whose key no saved result has."""
    return frame.join(saved.select(key).distinct(), key, "left_anti")


def _answers(prompts: Sequence[str], scorer: Callable[[str], str], at_once: int, timeout: float | None, tries: int) -> tuple[list[str | None], list[str | None]]:
    """Replies and errors in the order of the prompts, at_once of them under way. A prompt that fails is asked again; one that keeps failing has an error in place of a reply."""

    def ask(prompt: str) -> str:
        for left in reversed(range(tries)):
            try:
                return scorer(prompt)
            except Exception:
                if not left:
                    raise
        raise ValueError("no try")

    def told(call: Future) -> tuple[str | None, str | None]:
        if not wait([call], timeout).done:
            return None, f"no reply within {timeout} s"
        failed = call.exception()
        return (None, f"{type(failed).__name__}: {failed}"[:500]) if failed else (call.result(), None)

    pool, begun, out = ThreadPoolExecutor(at_once), deque(), []
    try:
        for prompt in prompts:
            if len(begun) == at_once:
                out.append(told(begun.popleft()))
            begun.append(pool.submit(ask, prompt))
        out += [told(call) for call in begun]
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return [r for r, _ in out], [e for _, e in out]


def call_scorer(prompt_rows: DataFrame, scorer: Callable[[str], str], key: str, at_once: int = 4, timeout: float | None = None, tries: int = 2) -> DataFrame:
    """(key, reply, error): a user function from prompt to reply text, called in the tasks.

    A task has at_once prompts under way, in threads: waiting for a service costs no core. timeout: seconds that the task
    waits for a prompt once it is that prompt's turn (a call that hangs keeps its thread till the task ends). A prompt that
    fails tries times has a NULL reply and an error; the others, and the job, go on.
    The replies are stored in the shared folder before anything uses them: no later job or lost executor asks again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies, errors = _answers(list(frame["prompt"]), scorer, at_once, timeout, tries)
            yield pd.DataFrame({key: frame[key], "reply": replies, "error": errors})

    kind = prompt_rows.schema[key].dataType.simpleString()
    return stored(prompt_rows.select(key, "prompt").mapInPandas(run, f"{key} {kind}, reply string, error string"), "replies")


def score_with_retries(prompt_rows: DataFrame, expected: DataFrame, scorer: Callable[[str], str], key: str, attempts: int = 3, at_once: int = 4, timeout: float | None = None) -> DataFrame:
    """(key, id, cate, reason) after up to `attempts` rounds (one at least); each round is one batch over the prompts still open.

    A prompt whose call failed has no values in that round and is asked again in the next one.
    """
    checked, todo = None, prompt_rows.select(key, "prompt")
    for attempt in range(1, max(attempts, 1) + 1):
        found = reply_items(reply_blocks(call_scorer(todo, scorer, key, at_once, timeout), key, "reply"), key)
        now = validated(found, expected, key)
        if checked is None:
            checked = now
        else:
            better = now.where("reason is null").select(key, "id", F.col("cate").alias("__cate"))
            joined = checked.join(better, [key, "id"], "left")
            checked = joined.select(key, "id", F.when(F.col("reason").isNull(), F.col("cate")).otherwise(F.coalesce("__cate", "cate")).alias("cate"), F.when(F.col("__cate").isNull(), F.col("reason")).alias("reason"))
        checked = cut(checked)
        if attempt == max(attempts, 1) or checked.where("reason is not null").isEmpty():
            return checked
        todo = retry_frame(prompt_rows, checked, key, attempt + 1)
    return checked
