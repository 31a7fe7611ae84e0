"""Operators for many index times, hot units, many patterns, many fits and repeated writes: against brute force, and their plans."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.uniform import POISSON_STEPS, uniform
from tidewell.operators import design, causal, joins, models, profiles, scoring
from tidewell.queries import relational
from tidewell.sources import tables as IO

DATA = "/root/testdata/sf0.001"
T = dt.datetime(2024, 1, 2)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stream(spark):
    """Units with many index times and events, one unit with most events; ties, NULL keys, times and values."""
    draw = random.Random(8)
    at = lambda: None if draw.random() < 0.03 else T + dt.timedelta(hours=draw.randrange(0, 400))
    unit = lambda: draw.choice([1, 1, 1, 1, 2, 3, None])
    events = [(unit(), i, at(), draw.choice("ab"), None if draw.random() < 0.3 else float(draw.randrange(50))) for i in range(900)]
    spine = [(i, unit(), at()) for i in range(120)] + [(500, 9, T), (7, 1, T)]
    kinds = "user_id bigint, event_id bigint, ts timestamp_ntz, event_type string, value double"
    return spark.createDataFrame(spine, "index_id bigint, user_id bigint, t0 timestamp_ntz"), spark.createDataFrame(events, kinds).repartition(6), spine, events


def h(hours):
    return dt.timedelta(hours=hours)


# --- as-of by union and carry -------------------------------------------------------------------


@pytest.mark.parametrize("bucket_hours", [None, 24])
def test_carry_against_brute_force(stream, bucket_hours):
    spine, events, index, happened = stream
    measures = {k: F.when(F.col("event_type") == k, F.col("value")) for k in "ab"} | {"row": F.struct("event_id", "event_type")}
    out = joins.carry_last(spine, events, "user_id", measures, 48, 3, bucket_hours=bucket_hours)
    assert "Join" not in plan(out)
    got = sorted(((r["index_id"], r["user_id"], r["t0"], r["a"], r["b"], tuple(r["row"]) if r["row"] else None) for r in out.collect()), key=repr)

    def last(unit, t0, keep, value):
        found = [(ts, i, value(i, k, v)) for u, i, ts, k, v in happened if u == unit and unit is not None and ts and t0 and t0 - h(48) <= ts <= t0 + h(3) and keep(k, v)]
        return max(found)[2] if found else None

    want = [(i, u, t, *[last(u, t, lambda k, v, c=c: k == c and v is not None, lambda i, k, v: v) for c in "ab"], last(u, t, lambda k, v: True, lambda i, k, v: (i, k))) for i, u, t in index]
    assert got == sorted(want, key=repr)
    assert joins.carry_last(spine, events.where("false"), "user_id", measures, 48).where("a is null and row is null").count() == len(index)
    assert joins.carry_last(spine.where("false"), events, "user_id", measures, 48).isEmpty()


# --- interval join by time buckets --------------------------------------------------------------


@pytest.mark.parametrize("closed", ["[)", "(]", "[]", "()"])
def test_interval_join_against_brute_force(spark, closed):
    draw = random.Random(4)
    at = lambda: None if draw.random() < 0.05 else T + dt.timedelta(minutes=30 * draw.randrange(0, 900))
    unit = lambda: draw.choice([1, 1, 1, 2, None])
    points = [(i, unit(), at()) for i in range(150)]
    spans = []
    for i in range(150):
        start = at()
        stop = None if start is None or draw.random() < 0.2 else start + dt.timedelta(minutes=30 * draw.choice([-3, 0, 1, 2, 7, 60, 900]))
        spans.append((i, unit(), start, stop))
    p, s = spark.createDataFrame(points, "i int, u int, at timestamp_ntz"), spark.createDataFrame(spans, "j int, u int, start timestamp_ntz, stop timestamp_ntz")
    after, before = (lambda a, b: a <= b) if closed[0] == "[" else (lambda a, b: a < b), (lambda a, b: a <= b) if closed[1] == "]" else (lambda a, b: a < b)
    want = sorted((i, j) for i, u, t in points for j, v, a, b in spans if u == v and None not in (u, t, a) and after(a, t) and (b is None or before(t, b)))
    for base in (1.0, 5.0):
        out = joins.interval_join(p, s, "u", "at", "start", "stop", closed, base)
        assert sorted((r["i"], r["j"]) for r in out.collect()) == want
        assert out.columns == ["i", "u", "at", "j", "start", "stop"]
    assert joins.interval_join(p, s.where("false"), "u", "at", "start", "stop").isEmpty()
    assert joins.interval_join(p.where("false"), s, "u", "at", "start", "stop").isEmpty()


def test_a_hot_unit_is_spread_over_buckets(spark, stream):
    spine, events, *_ = stream
    one = lambda f: f.withColumn("user_id", F.lit(1))
    out = joins.window_pairs(one(spine), one(events.drop("value")), "user_id", -6, 6)
    text = plan(out)
    assert re.search(r"hashpartitioning\([^)]*(__size|__level)#\d+, (__here|__bucket)#", text) or "BroadcastHashJoin" in text
    want = joins.window_join(one(spine), one(events.drop("value")), "user_id", -6, 6)
    pairs = lambda f: sorted(map(tuple, f.select("index_id", "event_id").collect()))
    assert pairs(out) == pairs(want)


# --- patterns by posted trigrams ----------------------------------------------------------------


def like(pattern: str, label: str) -> bool:
    """LIKE with backslash escapes, lower-cased."""
    out, escaped = "", False
    for c in pattern.lower():
        if escaped:
            out, escaped = out + re.escape(c), False
        elif c == "\\":
            escaped = True
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
    return re.fullmatch(out, label.lower(), re.DOTALL) is not None


def test_patterns_against_brute_force(spark):
    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("abAB%_ é") for _ in range(n))
    labels = [text(draw.randrange(0, 9)) for _ in range(200)] + [None, "", "100%", "a_b", "abc\nabd", "Ünïcode é"]
    patterns = ["%", "", "_", "%%", "__", "%a%", "%AB_", "100\\%", "%\\_%", "a\\_b", "%é", "ab%ba", "%abc%abd", None] + [f"%{text(draw.randrange(1, 5))}%" for _ in range(80)]
    p, f = spark.createDataFrame([(i, x) for i, x in enumerate(patterns)], "i int, pattern string"), spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "j int, label string")
    got = sorted((r["i"], r["j"]) for r in joins.like_candidates(p, f, "pattern", "label").collect())
    assert got == sorted((i, j) for i, a in enumerate(patterns) for j, b in enumerate(labels) if a is not None and b is not None and like(a, b))
    assert joins.like_candidates(p, f, "pattern", "label").columns == ["j", "label", "i", "pattern"]
    assert joins.like_candidates(p.where("false"), f, "pattern", "label").isEmpty() and joins.like_candidates(p, f.where("false"), "pattern", "label").isEmpty()


def test_many_patterns_need_no_nested_loop(spark):
    patterns = spark.range(10_000).select(F.concat(F.lit("%item "), F.col("id").cast("string"), F.lit("%")).alias("pattern"))
    labels = spark.range(3_000).select((F.col("id") * 7).alias("n"), F.concat(F.lit("Item "), (F.col("id") * 7).cast("string"), F.lit(" x")).alias("label"))
    out = joins.like_candidates(patterns, labels, "pattern", "label")
    want = sum(len({str(n)[:k] for k in range(1, len(str(n)) + 1)} & {str(i) for i in range(10_000)}) for n in range(0, 21_000, 7))
    assert out.count() == want
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_few_patterns_leave_labels_in_place(spark):
    """Patterns of unknown size: no label is dealt out by substring, where a frequent one's labels would meet in one task."""
    labels = spark.range(2_000).select("id", F.concat(F.lit("ring "), (F.col("id") % 3).cast("string")).alias("label"))
    patterns = labels.select(F.explode(F.split("label", " ")).alias("word")).distinct().withColumn("pattern", F.concat(F.lit("%"), "word", F.lit("%")))
    out = joins.like_candidates(patterns, labels, "pattern", "label")
    assert out.count() == 4_000 and "SortMergeJoin" not in plan(out)


def test_canonical_items_need_no_order_of_a_name(spark):
    candidates = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 2), (None, 3), ("c", 9)], "name string, item long")
    counts = spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "item long, n long")
    out = design.canonical_items(candidates, counts, "name", "item")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 2, 7), ("b", 2, 7), (None, 3, 7)], key=str) and out.columns == ["name", "item", "n"]
    assert "Window" not in plan(out)


# --- bucketed catalog tables --------------------------------------------------------------------


def test_star_over_bucketed_tables_has_no_exchange(spark):
    where = IO.scratch(spark, "catalog")
    spark.sql(f"CREATE NAMESPACE bucketed_star LOCATION '{where}'")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tables = relational.catalog_tables(spark, DATA, "bucketed_star")
        out = relational.assembled_star(*tables)
        rows = sorted(map(tuple, out.collect()))
        assert "Exchange" not in plan(out) and plan(out).count("Join") == 2
        assert rows == sorted(map(tuple, relational.assembled_star(*relational._star_inputs(spark, DATA)).collect()))
        assert IO.scan(spark, "bucketed_star.orders", {"extra": "string"}).dtypes[-1] == ("extra", "string")
        with pytest.raises(ValueError, match="nowhere"):
            IO.scan(spark, "bucketed_star.nowhere")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql("DROP NAMESPACE bucketed_star CASCADE")


# --- idempotent append --------------------------------------------------------------------------


def test_a_repeated_batch_is_appended_once(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.range(10).withColumn("v", F.lit("x"))
    assert IO.read_appended(spark, log, rows.schema).isEmpty() and IO.appended(spark, log) == []
    assert IO.append_once(rows, log, "b1") and not IO.append_once(rows, log, "b1") and IO.append_once(rows.where("id > 7"), log, "b2")
    rows.write.parquet(f"{log}/part-b3-lost")  # a driver that was lost between the part and the manifest
    assert IO.read_appended(spark, log, rows.schema).count() == 12
    assert IO.append_once(rows, log, "b3") and IO.read_appended(spark, log, rows.schema).count() == 22
    assert [b for b, _ in IO.appended(spark, log)] == ["b1", "b2", "b3"]
    with pytest.raises(ValueError):
        IO.append_once(rows, log, "../b")


def test_of_two_writers_of_a_batch_one_wins(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.range(1000)
    won = models.together(spark, [lambda: IO.append_once(rows, log, "same")] * 4, 4)
    assert sum(won) == 1 and IO.read_appended(spark, log, rows.schema).count() == 1000


# --- packed CSV ---------------------------------------------------------------------------------


@pytest.mark.parametrize("codec", [None, "gzip", "bz2", "xz", "zip"])
def test_csv_codecs_round_trip(spark, tmp_path, codec):
    path, kinds = str(tmp_path / "out"), "id bigint, s string, x double, t timestamp_ntz, ok boolean"
    data = [(1, "a,\"b\"\nc", 0.1, T, True), (2, None, None, None, None), (3, "é", -1e300, T + h(1.5), False)]
    if codec in ("xz", "zip"):  # where the empty text and NULL are kept apart, and signs of all kinds
        data += [(4, "", 1.0, T, True), (5, "\\", 1.0, T, True), (6, "\\\\", 1.0, T, True), (7, " ", 1.0, T, True), (8, "\r\nE", 2.5, T, True)]
    frame = spark.createDataFrame(data, kinds)
    IO.write_csv(frame.where("id < 3").repartition(3), path, codec)
    IO.write_csv(frame.where("id >= 3"), path, codec, append=True)
    back = IO.read_packed(spark, path, kinds) if codec in ("xz", "zip") else spark.read.csv(path, header=True, schema=kinds, multiLine=True, escape='"')
    assert sorted(map(tuple, back.collect())) == data
    with pytest.raises(Exception, match="exist|EXIST"):
        IO.write_csv(frame, path, codec)


def test_a_failed_packed_write_leaves_no_part(spark, tmp_path):
    path = tmp_path / "out"

    def broken(frames):
        for f in frames:
            yield f
            raise RuntimeError("lost")

    frame = spark.range(0, 4000, 1, 4).mapInPandas(broken, "id bigint")
    with pytest.raises(Exception, match="lost"):
        IO.write_csv(frame, str(path), "xz")
    assert not [f for f in path.rglob("*") if f.is_file() and not f.name.startswith(".")] if path.exists() else True


# --- scorer calls -------------------------------------------------------------------------------


def test_prompts_overlap_keep_their_order_and_fail_alone():
    seen, lock = [], threading.Lock()

    def scorer(prompt):
        with lock:
            seen.append(prompt)
        time.sleep(0.05 if prompt != "slow" else 3)
        if prompt == "bad" or (prompt == "once" and seen.count("once") == 1):
            raise RuntimeError("no")
        return f"<{prompt}>"

    prompts = [str(i) for i in range(40)] + ["bad", "once", "slow", "end"]
    began = time.perf_counter()
    replies, errors = scoring._answers(prompts, scorer, 8, 1.0, 2)
    took = time.perf_counter() - began
    assert took < 0.05 * len(prompts) and replies[:40] == [f"<{i}>" for i in range(40)] and replies[40:] == [None, "<once>", None, "<end>"]
    assert errors[40] == "RuntimeError: no" and "within" in errors[42] and not any(errors[:40]) and seen.count("bad") == 2


def test_a_failing_prompt_does_not_fail_the_stage(spark):
    prompts = spark.createDataFrame([(0, "id\n1"), (1, "id\n2")], "chunk bigint, prompt string")
    want = spark.createDataFrame([(0, 1), (1, 2)], "chunk bigint, id bigint")

    def scorer(prompt):
        if "\n2" in prompt:
            raise ValueError("always")
        return '{"id": 1, "cate": 0.5}'

    out = scoring.score_with_retries(prompts, want, scorer, "chunk", 2)
    assert {r["id"]: r["reason"] for r in out.collect()} == {1: None, 2: "missing"}


# --- concurrent fits ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark):
    """y depends on x and on a rare category of many; t on z."""
    u = lambda s: uniform(s, F.col("id"))
    f = spark.range(4000).select("id", (u(1) - 0.5).alias("x"), F.concat(F.lit("c"), F.floor(u(5) * 100).cast("int").cast("string")).alias("kind"), (u(2) > 0.5).cast("int").alias("z"))
    f = f.withColumn("t", (u(3) < 0.3 + 0.4 * F.col("z")).cast("int"))
    return f.withColumn("y", (u(4) < 0.2 + 0.2 * F.col("z") + F.when(F.col("kind") == "c93", 0.6).otherwise(0)).cast("int")).persist()


def test_jobs_run_together_in_order(spark):
    meet = threading.Barrier(3, timeout=20)

    def job(i):
        meet.wait()  # all three are under way at once
        return i * spark.range(5).count()

    assert models.together(spark, [lambda i=i: job(i) for i in range(3)], 3) == [0, 5, 10]
    with pytest.raises(ZeroDivisionError):
        models.together(spark, [lambda: 1 // 0, lambda: 2], 2)
    assert models.together(spark, [], 2) == []


def test_weights_stand_for_copies(planted):
    """A row of weight k teaches as much as k rows, also for the least size of a leaf; weight 0 teaches nothing."""
    features = models.features_of(planted, ["x", "z"], [])
    rows = models.assembled(planted, features, ["x", "z"], "id", "y", "t")
    k = F.pmod(F.col("id"), F.lit(3))
    options = {"maxIter": 5, "stepSize": 0.3, "minInstancesPerNode": 300}
    weighted = models.fit(rows, "y", k, **options)
    copies = models.fit(rows.withColumn("__c", F.explode(F.array_repeat(F.lit(1), k.cast("int")))), "y", F.lit(1.0), **options)
    both = models.predict(copies, models.predict(weighted, rows, "a"), "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9
    with pytest.raises(ValueError, match="classes"):
        models.fit(rows, "y", F.when(F.col("y") == 1, 1.0).otherwise(0.0))


def test_every_category_is_a_feature(planted):
    """The 100 categories are equally rare; what one of them does is found, whichever it is."""
    out = models.fit_predict(planted, planted, "y", ["x"], ["kind"], "p", maxIter=10, stepSize=0.3, minInstancesPerNode=10)
    mean = {r["hot"]: r["p"] for r in out.groupBy((F.col("kind") == "c93").alias("hot")).agg(F.avg("p").alias("p")).collect()}
    assert mean[True] > mean[False] + 0.3 and out.columns == [*planted.columns, "p"]
    unseen = models.fit_predict(planted, planted.withColumn("kind", F.lit("new")), "y", ["x"], ["kind"], "p", maxIter=2, stepSize=0.3)
    assert unseen.where("p is null").isEmpty()


def test_cross_fit_and_bootstrap_find_the_effect(spark):
    u = lambda s: uniform(s, F.col("id"))
    f = spark.range(4000).select("id", (u(2) > 0.5).cast("int").alias("z"), F.when(F.col("id") % 11 > 0, u(1)).alias("x"), F.lit(None).cast("double").alias("void"))
    f = f.withColumn("t", (u(3) < 0.3 + 0.4 * F.col("z")).cast("int"))
    f = f.withColumn("y", (u(4) < 0.6 + 0.2 * F.col("z") - 0.3 * F.col("t")).cast("int")).withColumn("kind", F.when(F.col("z") == 1, "a").when(F.col("id") % 2 == 0, "b"))
    options = {"maxIter": 8, "stepSize": 0.2}
    out = models.cross_fit(f, "id", ["x", "void"], ["kind"], 2, **options)
    assert out.columns == [*f.columns, "fold", "ps", "m1", "m0"] and out.count() == 4000
    one = models.aipw(out).first()
    assert abs(one["ate"] + 0.3) < 0.05
    boot = models.bootstrap_aipw(f, "id", ["x", "void"], ["kind"], 4, 2, **options)
    rows = sorted((r["rep"], r["ate"]) for r in boot.collect())
    assert [r for r, _ in rows] == [1, 2, 3, 4] and all(abs(a + 0.3) < 0.08 for _, a in rows) and np.std([a for _, a in rows]) > 0
    assert rows == sorted((r["rep"], r["ate"]) for r in models.bootstrap_aipw(f, "id", ["x", "void"], ["kind"], 4, 2, **options).collect())


def test_cells_teach_what_their_rows_teach(planted):
    """The same model, of a 0/1 label and of a regression, by rows and by cells; a rare value and a frequent one have bins of their own."""
    f = planted.withColumn("w", F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("x") + 0.5)).withColumn("rare", (F.col("id") % 400 == 0).cast("int"))
    numeric, options = ["x", "w", "rare"], {"maxIter": 4, "stepSize": 0.3}
    features = models.features_of(f, numeric, [])
    rows = models.assembled(f, features, numeric, "id", "y", "x")
    grid = models.gridded(f, features)
    assert grid.groupBy("__b_rare").agg(F.count_distinct("rare").alias("n")).where("n > 1").isEmpty() and grid.select("__b_rare").distinct().count() == 2
    assert grid.groupBy("__b_w").agg(F.count_distinct("w").alias("n"), F.min("w").alias("w")).where("w = 0 and n > 1").isEmpty()
    for label, logistic, by in (("y", True, ["y"]), ("x", False, [])):
        taught = models.cells(grid, features, by, {"n": F.count("*"), **({} if by else {"x": F.avg("x")})})
        assert taught.agg(F.sum("n")).first()[0] == 4000
        a, b = models.fit(rows, label, F.lit(1.0), logistic, **options), models.fit(taught, label, F.col("n"), logistic, **options)
        both = models.predict(a, models.predict(b, rows, "p"), "q")
        assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9 and both.select("p").distinct().count() > 2


@pytest.mark.parametrize("run", ["cross_fit", "bootstrap_aipw", "fit_predict"])
def test_fits_read_cells_not_rows(planted, monkeypatch, run):
    """Every fit gets all rows' weight in fewer rows than they are, and four times the rows make no more of them."""
    seen = []

    def measured(rows, label, weight, *rest, real=models.fit, **boosting):
        seen.append((rows.count(), rows.agg(F.sum(weight)).first()[0]))
        return real(rows, label, weight, *rest, **boosting)

    monkeypatch.setattr(models, "fit", measured)
    call = {"cross_fit": lambda f: models.cross_fit(f, "id", ["x"], [], 2, maxIter=1), "bootstrap_aipw": lambda f: models.bootstrap_aipw(f, "id", ["x"], [], 1, 2, maxIter=1), "fit_predict": lambda f: models.fit_predict(f, f, "y", ["x"], [], "p", maxIter=1)}[run]
    copies = planted.crossJoin(planted.sparkSession.range(4).withColumnRenamed("id", "c")).withColumn("id", F.col("id") * 4 + F.col("c")).drop("c")
    for frame in (planted, copies):
        seen.append(None)
        call(frame).count()
    one, four = [x for x in seen[1 : seen.index(None, 1)]], seen[seen.index(None, 1) + 1 :]
    assert max(n for n, _ in one) <= 32 * 4 and max(n for n, _ in four) <= 32 * 4
    assert len(one) == len(four) and sum(w for _, w in four) == pytest.approx(4 * sum(w for _, w in one), rel=0.1)


# --- heavy hitters and sketches -----------------------------------------------------------------


def test_heavy_hitters_against_counts(spark):
    draw = random.Random(2)
    skewed = [draw.choice(["a", "b", "c", None]) if draw.random() < 0.5 else f"v{draw.randrange(3000)}" for _ in range(6000)]
    flat = [f"v{i % 1500}" for i in range(3000)]
    for values in (skewed, flat, ["x", "y", "y", None], []):
        frame = spark.createDataFrame([(v,) for v in values], "s string").repartition(5)
        count = {v: values.count(v) for v in set(values)}
        want = sorted(count.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))[:7]
        for capacity in (20, 4096):
            assert [tuple(r) for r in profiles.heavy_hitters(frame, "s", 7, capacity).collect()] == want
    # the sketch settles skewed data without counting all values
    frame = spark.createDataFrame([(v,) for v in skewed], "s string").repartition(5)
    assert "LeftSemi" in plan(profiles.heavy_hitters(frame, "s", 3, 500)) and "LeftSemi" not in plan(profiles.heavy_hitters(frame, "s", 100, 5))


def test_sketches_merge_within_their_error(spark):
    frame = spark.range(60_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 20_011).alias("u"), F.lit(None).cast("string").alias("void"))
    daily = profiles.distinct_sketches(frame, ["day"], ["u", "void"])
    half = profiles.estimated_distinct(daily.withColumn("half", F.col("day") < 5), ["half"], ["u", "void"]).collect()
    exact = {r["half"]: r["n"] for r in frame.groupBy((F.col("day") < 5).alias("half")).agg(F.count_distinct("u").alias("n")).collect()}
    assert all(abs(r["u"] - exact[r["half"]]) <= 4 * 1.04 / 64 * exact[r["half"]] and r["void"] == 0 for r in half)


# --- resampling without replicated rows ---------------------------------------------------------


def test_resamples_move_no_replicates(spark):
    """Effects of every replicate against a plain loop, with bounds at weights that all differ; no plan explodes the rows by replicate."""
    u = lambda s: uniform(s, F.col("id"))
    f = spark.range(700).select("id", (u(1) < 0.4).cast("int").alias("t"), (u(2) < 0.5).cast("int").alias("y"), (0.02 + 0.96 * u(3)).alias("ps"))
    f = f.unionByName(spark.range(700, 760).select("id", (F.col("id") % 2).cast("int").alias("t"), F.lit(1).alias("y"), F.lit(0.5).alias("ps"))).persist()
    rows = [(r["id"], r["t"], r["y"], min(max(r["ps"], 0.01), 0.99)) for r in f.collect()]
    steps = POISSON_STEPS
    times = {(i, b): sum(int(hashlib.md5(f"42:{i}:{b}".encode()).hexdigest()[:8], 16) / 2**32 >= s for s in steps) for i, *_ in rows for b in range(1, 7)}
    for trim in (None, (0.05, 0.95), (0.0, 0.5)):
        got = {r["rep"]: (r["iptw"], r["ato"]) for r in causal.bootstrap_effects(f, "id", 6, 42, trim).collect()}
        for b in range(1, 7):
            drawn = [x for x in rows for _ in range(times[x[0], b])]
            t, y, e = (np.array([x[j] for x in drawn], float) for j in (1, 2, 3))
            p = t.mean()
            w = np.where(t == 1, p / e, (1 - p) / (1 - e))
            if trim:
                w = np.clip(w, *np.quantile(w, trim))
            ate = lambda w, t=t, y=y: (w * y * t).sum() / (w * t).sum() - (w * y * (1 - t)).sum() / (w * (1 - t)).sum()
            assert np.allclose(got[b], (ate(w), ate(np.where(t == 1, 1 - e, e))), atol=1e-9)
    sums = causal.resampled_sums(causal.spread(f, "id", F.col("y")), [], causal.multiplicities("id", 6), {"y": F.col("y")})
    want = [(b, sum(times[i, b] for i, *_ in rows), sum(times[i, b] * y for i, _, y, _ in rows)) for b in range(1, 7)]
    assert np.allclose(sorted(map(tuple, sums.collect())), want, rtol=1e-12) and all(r["k"] == w[1] for r, w in zip(sorted(sums.collect()), want, strict=True))
    assert causal.resampled_sums(f.where("false"), [], causal.multiplicities("id", 6), {}).isEmpty()
    drawn = causal.drawn_sums(causal.spread(f, "id", F.col("y")), "id", 6, 42, [], {"y": F.col("y")})
    assert sorted(map(tuple, drawn.collect())) == want and causal.drawn_sums(f.where("false"), "id", 6, 42, [], {}).isEmpty()


def test_draws_in_tasks_are_the_hashes_of_the_sql(spark):
    """Keys of all lengths, also over one MD5 block and null, and null groups; no row holds its counts."""
    keys = [None, "", "a", "é", "12345678901", *["x" * n for n in (40, 47, 48, 49, 50, 51, 52, 53, 60, 130)]]
    f = spark.createDataFrame([(k, None if i % 3 == 0 else i % 2, float(i)) for i, k in enumerate(keys)], "k string, g int, v double").repartition(3)
    got = {(r["g"], r["rep"]): (r["k"], r["v"]) for r in causal.drawn_sums(f, "k", 103, 7, ["g"], {"v": F.col("v")}).collect()}
    for rep in (1, 9, 10, 99, 100, 103):
        want = {g: [0, 0.0] for g in (None, 0, 1)}
        for i, k in enumerate(keys):
            digest = hashlib.md5(":".join(["7", *([] if k is None else [k]), str(rep)]).encode()).hexdigest()
            n = sum(int(digest[:8], 16) / 2**32 >= s for s in POISSON_STEPS)
            g = None if i % 3 == 0 else i % 2
            want[g][0] += n
            want[g][1] += n * i
        assert all(got[g, rep] == tuple(w) for g, w in want.items())
    assert "sequence" not in plan(causal.drawn_sums(f, "k", 103, 7, ["g"], {}))
