"""Hand-made frames for the rules that bite, and planted effects."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import registry
from tidewell.functions import scalar as S
from tidewell.functions.uniform import poisson, uniform
from tidewell.operators import bias, causal, design, joins, models, policy, profiles, ranks, scoring
from tidewell.plans.reports import policy_report
from tidewell.plans.study import config
from tidewell.sources import tables as IO
from tidewell.streaming import results

T = dt.datetime(2024, 1, 2)


def hours(h):
    return T + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def spine(spark):
    return spark.createDataFrame([(1, T), (2, T), (3, T)], "user_id bigint, t0 timestamp_ntz")


@pytest.fixture(scope="module")
def events(spark):
    data = [(1, 1, hours(0), "a", 1.0), (1, 2, hours(24), "a", 2.0), (1, 3, hours(-6), "b", None), (1, 4, hours(-6), "b", 5.0), (2, 5, hours(3), "a", float("nan")), (2, 6, None, "a", 7.0)]
    return spark.createDataFrame(data, "user_id bigint, event_id bigint, ts timestamp_ntz, event_type string, value double")


def test_window_bounds(spine, events):
    count = lambda closed: joins.window_join(spine, events, "user_id", -6, 24, closed=closed).count()
    assert [count(c) for c in ("[]", "[)", "(]", "()")] == [5, 4, 3, 2]


def test_spine_is_kept(spine, events):
    for out in (design.exposure(spine, events, "user_id", 24), design.baseline(spine, events, "user_id", 6, 24, {"b": "b"}), design.early_values(spine, events, "user_id", 24, ["a", "zz"]), design.prior_count(spine, events, "user_id")):
        assert sorted(r[0] for r in out.select("user_id").collect()) == [1, 2, 3]


def test_asof_tie_takes_the_larger_id_and_skips_null(spine, events):
    rows = {r["user_id"]: r for r in design.baseline(spine, events, "user_id", 6, 0, {"b": "b"}).collect()}
    assert rows[1]["b"] == 5.0 and rows[1]["has_b"] == 1 and rows[3]["b"] is None and rows[3]["has_b"] == 0


def test_class_tie_drops_out(spark):
    e = spark.createDataFrame([(1, hours(0), "a"), (1, hours(1), "b"), (2, hours(0), "a"), (2, hours(1), "a")], "user_id bigint, ts timestamp_ntz, event_type string")
    assert [r["user_id"] for r in design.majority_time_zero(e, "user_id", ("a", "b"), 2).collect()] == [2]


def test_doses(spark):
    data = [("20", "mg"), (" 20 ", None), ("20.5 mg", "mg"), ("20d", "mcg"), ("1,000", "g"), ("", "mg"), (None, "mg"), ("5", "µg"), ("5", "drops")]
    mg, bad = S.dose_in_mg(F.col("d"), F.col("u"))
    rows = spark.createDataFrame(data, "d string, u string").select(mg.alias("mg"), bad.alias("bad"), S.text_to_double(F.col("d")).alias("x")).collect()
    assert [r["mg"] for r in rows] == [20.0, 20.0, 20.5, 0.02, 1000.0, None, None, 0.005, None]
    assert [r["bad"] for r in rows] == [0, 0, 0, 0, 0, 1, 1, 0, 1]
    assert [r["x"] for r in rows] == [20.0, 20.0, None, None, None, None, None, 5.0, 5.0]


def test_first_rule_wins_and_null_is_unclassified(spark):
    f = spark.createDataFrame([("Methylprednisolone",), ("prednisolone",), ("x",), (None,)], "t string")
    kinds = S.classify(F.col("t"), [(["%methylprednisolone%"], "long"), (["%prednisolone%"], "short")])
    assert [r[0] for r in f.select(kinds).collect()] == ["long", "short", None, None]


def test_missing_age_stays_missing(spark):
    f = spark.createDataFrame([(40, 2000, T), (None, 2000, T), (200, 2000, T)], "a int, y int, t timestamp_ntz")
    assert [r[0] for r in f.select(S.age_at(F.col("a"), F.col("y"), F.col("t"))).collect()] == [64, None, 120]


def test_readers_reject(spark, tmp_path):
    with pytest.raises(ValueError):
        IO.read_any(spark, str(tmp_path / "x.txt"))
    empty = str(tmp_path / "empty.parquet")
    spark.range(0).write.parquet(empty)
    with pytest.raises(ValueError):
        IO.read_any(spark, empty)
    with pytest.raises(ValueError):
        IO.write_csv(spark.range(1), str(tmp_path / "z"), "7z")
    with pytest.raises(ValueError, match="nowhere"):
        IO.require(spark, ["nowhere"])
    row = IO.json_rows(spark.createDataFrame([(float("nan"), 1.0, float("inf"))], "a double, b double, c double")).first()[0]
    assert row == '{"a":null,"b":1.0,"c":null}'


def test_quantile_edges_that_coincide(spark):
    f = spark.createDataFrame([(float(x),) for x in [0, 0, 0, 0, 1, 2]] + [(None,)], "x double")
    bins = [r["bin"] for r in causal.quantile_bins(f, "x", 4).orderBy("x").collect()]
    assert bins == [None, 0, 0, 0, 0, 1, 1]


def test_splits_are_disjoint_and_folds_even(spark):
    f = spark.range(1000).selectExpr("id", "id div 3 as subject")
    split = causal.split_by_subject(f, "subject")
    assert split.groupBy("subject").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    sizes = [r["n"] for r in causal.k_folds(f, "id", 7).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_uniform_and_poisson(spark):
    f = spark.range(20000).select(uniform(1, F.col("id")).alias("u"))
    low, high, mean, times = f.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg(poisson(F.col("u")))).first()
    assert 0 <= low < high < 1 and abs(mean - 0.5) < 0.01 and abs(times - 1) < 0.03


@pytest.fixture(scope="module")
def planted(spark):
    """Effect -0.3 where x > 0, 0 elsewhere; treatment depends on z, and so does the outcome."""
    u = lambda s: uniform(s, F.col("id"))
    f = spark.range(6000).select("id", (u(1) - 0.5).alias("x"), (u(2) > 0.5).cast("int").alias("z"))
    f = f.withColumn("t", (u(3) < 0.3 + 0.4 * F.col("z")).cast("int"))
    return f.withColumn("y", (u(4) < 0.4 + 0.3 * F.col("z") - F.when(F.col("x") > 0, 0.3 * F.col("t")).otherwise(0)).cast("int")).persist()


def test_weights_and_effects(planted):
    s = causal.stratum_scores(planted, ["z"])
    naive = s.agg((F.avg(F.when(F.col("t") == 1, F.col("y"))) - F.avg(F.when(F.col("t") == 0, F.col("y"))))).first()[0]
    w = causal.iptw(s, causal.clip_ps(F.col("ps")))
    got = w.agg(causal.ate(F.col("y"), F.col("t"), F.col("w")).alias("a"), causal.ess(F.col("w")).alias("e"), F.count("*").alias("n"), F.min("w").alias("m")).first()
    assert abs(got["a"] + 0.15) < 0.05 < abs(naive + 0.15) and got["e"] <= got["n"] and got["m"] > 0
    smd = {r["feature"]: r for r in causal.smd_table(w, ["z", "x"], w="w").collect()}
    assert abs(smd["z"]["smd_pre"]) > 0.5 and abs(smd["z"]["smd_post"]) < 0.01


def test_one_arm_bin_is_null(spark):
    f = spark.createDataFrame([(0.0, 1, 1, 0.5), (0.0, 1, 0, 0.5), (1.0, 1, 1, 0.5), (1.0, 0, 0, 0.5)], "tau double, t int, y int, ps double")
    rows = {r["bin"]: r for r in causal.calibration_table(f, 2).collect()}
    assert rows[0]["ate_ato"] is None and rows[1]["ate_ato"] == pytest.approx(1.0)


def test_auc_with_ties(spark):
    f = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "s double, l int")
    assert causal.auc(f, "s", "l").first()[0] == pytest.approx(0.875)


def test_constant_and_unusable_columns(spark):
    f = spark.createDataFrame([(3.0, float("inf"), None, 1, 0), (3.0, 2.0, None, 0, 1)], "c double, g double, n double, t int, y int")
    rows = causal.min_max(f, ["c", "g", "n"]).collect()
    assert all(r["c"] == 0 and r["n"] == 0 for r in rows)
    assert [r["n"] for r in causal.group_impute(f, ["n"]).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        bias.standardise(f, ["c"], skip_binary=False)


def test_policy_values(planted):
    s = causal.stratum_scores(planted.withColumn("pos", (F.col("x") > 0).cast("int")), ["z", "pos"])
    p = policy.policy_from_tau(s)
    value = policy.dr_value(p).first()[0]
    report = policy.personalised_report(s).first()
    assert value < report["v_none"] and report["best"] == "policy"
    with pytest.raises(ValueError):
        policy.decide(F.col("tau"), 0.0, "other")


def test_policy_report_has_intervals_of_all_three_values(planted):
    s = causal.stratum_scores(planted.withColumn("pos", (F.col("x") > 0).cast("int")), ["z", "pos"])
    rows = [(r["section"], json.loads(r["json"])) for r in policy_report(s, "id", config("default"), 20).collect()]
    point = next(r for name, r in rows if name == "report")
    values = {r["quantity"]: r for name, r in rows if name == "values"}
    for quantity, v in (("value", "v_policy"), ("none", "v_none"), ("every", "v_all")):
        assert values[quantity]["ci_lo"] - 0.02 < point[v] < values[quantity]["ci_hi"] + 0.02
    tau = next(r for name, r in rows if name == "tau")
    assert tau["p01"] <= tau["p25"] <= tau["p50"] <= tau["p75"] <= tau["p99"]
    assert tau["n_negative"] + tau["n_positive"] == point["n"]


def test_selection_reaches_its_target(planted):
    annotated, selected, _ = bias.selection_pipeline(planted, "id", {"x": 1.0}, 0.37)
    assert annotated.agg(F.avg("selection_probability")).first()[0] == pytest.approx(0.37, abs=1e-8)
    assert abs(selected.count() / 6000 - 0.37) < 0.03
    with pytest.raises(ValueError):
        bias.calibrate_intercept(planted, "x", 1.5)
    with pytest.raises(ValueError):
        bias.parse_weights(["x"])


def test_harmonise_matches_the_reference_schema(planted):
    out = bias.harmonise(planted, planted.withColumn("new", F.lit(1)), "t", "new")
    assert out.schema == planted.schema or out.dtypes == planted.dtypes
    with pytest.raises(ValueError, match="missing"):
        bias.harmonise(planted, planted.drop("x"), "t", "t")


def test_dr_learner_finds_the_planted_effect(planted):
    rows, _ = models.dr_learner(planted, "id", ["x", "z"], [], 2, maxIter=10, minInstancesPerNode=50, stepSize=0.2)
    tau = {r["pos"]: r["m"] for r in rows.groupBy((F.col("x") > 0).alias("pos")).agg(F.avg("tau").alias("m")).collect()}
    assert abs(tau[True] + 0.3) < 0.08 and abs(tau[False]) < 0.08
    assert abs(models.aipw(rows).first()["ate"] + 0.15) < 0.05


@pytest.mark.parametrize("name, function, counts", [("gbt_propensity", "fit_predict", []), ("gbt_outcomes", "cross_fit", [5]), ("gbt_aipw", "cross_fit", [5]), ("gbt_aipw_bootstrap", "bootstrap_aipw", [20]), ("dr_learner", "dr_learner", [5])])
def test_model_queries_fit_all_features_folds_and_replicates(spark, monkeypatch, name, function, counts):
    class Called(Exception):
        pass

    def called(frame, *rest, **boosting):
        raise Called([x for x in rest if isinstance(x, list)], [x for x in rest if isinstance(x, int)][: len(counts)])

    monkeypatch.setattr(models, function, called)
    with pytest.raises(Called) as got:
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.value.args == ([["price", "bal"], ["seg"]], counts)


def test_exact_quantiles_and_ranks(spark):
    draw = np.random.default_rng(5)
    data = [(int(g), float(x), int(k)) for g, x, k in zip(draw.integers(0, 3, 500), np.round(draw.normal(size=500), 1), draw.integers(0, 3, 500), strict=True)] + [(7, None, 1), (7, 1.0, 0), (1, 1e12, 1)]
    frame = spark.createDataFrame(data, "g bigint, x double, k int").repartition(5)
    points = (0.0, 0.013, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: r["q"] for r in ranks.quantiles(frame, "x", points, ["g"], F.col("k")).collect()}
    for g in (0, 1, 2):
        values = [x for a, x, k in data if a == g for _ in range(k)]
        assert np.allclose(got[g], np.quantile(values, points))
        lower = {r["g"]: r["q"] for r in ranks.quantiles(frame.where(F.col("g") == g), "x", points[1:], ["g"], discrete=True).collect()}[g]
        assert np.allclose(lower, np.quantile([x for a, x, _ in data if a == g], points[1:], method="inverted_cdf"))
    assert 7 not in got
    wide = [float(s * 10.0**e) for s, e in zip(draw.normal(size=300), draw.integers(-320, 300, 300), strict=True)] + [0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0, float(np.nextafter(1.0, 2.0))]
    both = ranks.quantiles(spark.createDataFrame([(x,) for x in wide], "x double"), "x", (0.0, 0.2, 0.5, 0.77, 1.0, 0.77), discrete=[False] * 5 + [True]).first()["q"]
    assert np.allclose(both[:5], np.quantile(wide, (0.0, 0.2, 0.5, 0.77, 1.0)), rtol=1e-12, atol=0) and both[5] == np.quantile(wide, 0.77, method="inverted_cdf")
    end = ranks.quantiles(spark.createDataFrame([(x,) for x in (1.0, float("inf"), float("-inf"), 2.0, float("nan"))], "x double"), "x", (0.0, 0.5, 0.75), discrete=True).first()["q"]
    assert end == [float("-inf"), 2.0, float("inf")]
    assert ranks.quantiles(frame.where("false"), "x", (0.5,)).first()["q"] == [None]
    ranked = ranks.numbered(frame.where("x is not null").withColumn("id", F.monotonically_increasing_id()), "x", "g", "id").collect()
    assert sorted(r["__rank"] for r in ranked) == list(range(1, 503)) and {r["__n"] for r in ranked} == {502}
    assert [(r["x"], r["g"]) for r in sorted(ranked, key=lambda r: r["__rank"])] == sorted((x, g) for g, x, _ in data if x is not None)
    assert ranks.numbered(frame.where("false"), "x").isEmpty()


def test_replies(spark):
    texts = [(1, 'x [{"id": 1, "cate": 0.5}, {"id": 1, "cate": 0.9}] y'), (2, "{2, -0.25}"), (3, '{id: 3, cate: 1}'), (4, '{"id": 4.5, "cate": 0.1}'), (5, ""), (6, None), (7, '{"id": true, "cate": 0.1}'), (8, '{"id": 8, "cate": "0.1"}')]
    f = spark.createDataFrame(texts, "k bigint, text string")
    got = {(r["k"], r["id"]): r["cate"] for r in scoring.reply_items(scoring.reply_blocks(f, "k", "text"), "k").collect()}
    assert got == {(1, 1): 0.5, (2, 2): -0.25, (3, 3): 1.0}


def test_reasons_and_status(spark):
    f = spark.createDataFrame([(0.5,), (None,), (float("nan"),), (float("inf"),), (1.5,)], "v double")
    assert [r[0] for r in f.select(scoring.value_reason(F.col("v"))).collect()] == [None, "missing", "nan", "infinite", "out_of_range"]
    want, got = spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(2,), (3,)], "id bigint")
    report = scoring.status_report(want, got)
    assert {r["id"]: r["status"] for r in report.collect()} == {1: "missing", 2: "success", 3: "extra"}
    with pytest.raises(ValueError):
        scoring.require_complete(report)


def test_one_attempt_at_least(spark):
    prompts = spark.createDataFrame([(0, "id\n1\n2")], "chunk bigint, prompt string")
    want = spark.createDataFrame([(0, 1), (0, 2)], "chunk bigint, id bigint")
    out = scoring.score_with_retries(prompts, want, lambda p: '{"id": 1, "cate": 0.5}', "chunk", 0)
    assert {r["id"]: r["reason"] for r in out.collect()} == {1: None, 2: "missing"}


def test_profiles(spark):
    f = spark.createDataFrame([("a", 1), ("a", 2), (None, None)], "s string, n int")
    assert [tuple(r) for r in profiles.missingness(f, ["s", "n"]).collect()] == [("s", 1, 0.333333), ("n", 1, 0.333333)]
    assert profiles.mode(f, "s").first()[0] == "a"
    with pytest.raises(ValueError):
        joins.aligned(f.select("n"), f, "n")


def test_configs():
    assert config("small", seed=1).folds == 2
    with pytest.raises(KeyError):
        config("other")


def test_streamed_log(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(1, 0.5, T, "result"), (2, 0.1, T, "error")], "id bigint, cate double, ts timestamp, data_type string").write.parquet(source)
    stream = results.read_results(spark, source, "id bigint, cate double, ts timestamp, data_type string")
    for _ in range(2):  # the second start finds nothing new
        results.append_results(results.first_results(stream, "id", "ts"), log, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(log).count() == 2
