"""Reports on small fixtures; every query with SQL is compared in test_census."""

import zlib

import pytest
from pyspark.sql import functions as F

from persistra.functions.exprs import mean
from persistra.operators import answers, evaluate, reports


def test_stable_seed_is_crc32_of_joined_parts(spark):
    df = spark.createDataFrame([("a", 1), ("é", 20)], "x string, y long")
    got = [r[0] for r in df.select(reports.stable_seed(F.col("x"), F.col("y"))).collect()]
    assert got == [zlib.crc32(b"a|1"), zlib.crc32("é|20".encode())]


def test_columns_by_prefix_type_and_exclusion(spark):
    df = spark.createDataFrame([(1, 2.0, "s", 3)], "occ__a long, occ__b double, occ__c string, meta long")
    assert reports.columns_by(df, ["occ__"]) == ["occ__a", "occ__b"]
    assert reports.columns_by(df, ["occ__"], ["occ__a"], numeric=False) == ["occ__b", "occ__c"]
    assert reports.columns_by(df, exclude=["meta"]) == ["occ__a", "occ__b"]


def test_integrity_raises_on_what_it_counts(spark):
    good = spark.createDataFrame([("a", 0.5, "i", "g"), ("b", 1.0, "j", "g")], "k string, x double, inst string, grp string")
    reports.checked(reports.integrity(good, "k", ["x"], "inst", "grp"))
    bad = good.unionByName(spark.createDataFrame([("a", 1.5, "i", "h"), ("c", None, "j", "g")], good.schema))
    row = reports.integrity(bad, "k", ["x"], "inst", "grp").first()
    assert (row.n, row.out_of_range, row.nulls, row.repeated, row.split) == (4, 1, 1, 1, 1)
    with pytest.raises(ValueError, match="repeated"):
        reports.checked(reports.integrity(bad, "k", ["x"], "inst", "grp"))


def test_usable_rejects_tools_in_the_closed_arm_only(spark):
    df = spark.createDataFrame([(True, "no", 0), (True, "no", 2), (True, "yes", 2), (False, "yes", 0), (None, "no", 0)], "c boolean, arm string, t int")
    assert [r[0] for r in df.select(reports.usable(F.col("c"), F.col("arm"), F.col("t"), "no")).collect()] == [True, False, True, False, False]


def test_lifetime_plugin_of_dyads_seen_once_is_zero(spark):
    log = spark.createDataFrame([("a", "b", 0.1), ("c", "d", 0.2)], "u string, v string, t double")
    row = reports.lifetime_plugin(log).first()
    assert row.conditional is None and row.share == 0 and row.zero_inclusive == 0
    more = log.unionByName(spark.createDataFrame([("a", "b", 0.5)], log.schema))
    row = reports.lifetime_plugin(more).first()
    assert row.conditional == pytest.approx(0.4) and row.zero_inclusive == pytest.approx(0.2)


def test_sample_gaps(spark):
    log = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.1), ("a", "b", 0.2), ("c", "d", 0.2)], "u string, v string, t double")
    (row,) = reports.sample_gaps(log).collect()
    assert (row.gaps, round(row.mean_gap, 9), round(row.max_gap, 9)) == (2, 0.2, 0.3)


def test_noise_components_by_hand(spark):
    rows = [("g", "i", 0.0), ("g", "i", 0.2), ("g", "j", 1.0), ("g", "j", 1.2), ("h", "k", 3.0), ("h", "k", 3.2), ("h", "l", 9.0)]
    row = reports.noise_components(spark.createDataFrame(rows, "group_id string, instance_id string, x double"), "x").first()
    within, n_rep, n_inst = 0.02, 2.0, 1.5
    inst = 0.5 - within / n_rep
    assert row.within == pytest.approx(within) and row.n_rep == n_rep and row.n_inst == n_inst and row.n_group == 2
    assert row.inst == pytest.approx(inst)
    assert row.group == pytest.approx((3.1 - 0.6) ** 2 / 2 - inst / n_inst - within / (n_inst * n_rep))


def test_bootstrap_counts_have_the_mean_and_variance_of_poisson(spark):
    assert len(answers.POISSON) > 9 and answers.POISSON == sorted(answers.POISSON)
    deltas = spark.range(40).selectExpr("cast(id as string) as case", "id / 40D as d")
    row = answers.bootstrap_delta(deltas, 400).first()
    assert row.n == 40 and row.low < row.delta < row.high
    se = 0.2886 / 40**0.5
    assert 3.0 * se < row.high - row.low < 5.0 * se


def test_empty_tables(spark):
    cases = spark.createDataFrame([], "case_id string, instance_id string, group_id string, strategy string, pred_2 double, true_2 double")
    assert reports.against_baseline(cases.withColumn("b", F.lit(0.2)), [], "strategy", "pred_2", "b", "true_2").count() == 0
    assert reports.rescored(cases, cases, "case_id", "true_2", ["pred_2"]).count() == 0
    assert reports.integrity(cases, "case_id", ["true_2"], "instance_id", "group_id").first().n == 0


def test_fold_means_are_exact_where_a_sum_of_doubles_is_not(spark):
    # (0.971513 + 0.022534) / 2 as doubles is 0.49702349999999995 and rounds down
    y = {"a": [0.971513, 0.022534, None], "b": [1e17, 1e17, 3e17], "c": [float("inf"), 1.0], "d": [1.0 / 3, 1e-20]}
    rows = spark.createDataFrame([(g, x) for g, xs in y.items() for x in xs], "group_id string, y_true double")
    folds = spark.createDataFrame([(g, i, k) for k in y for g, i in ((k, 1), ("none", 0))], "group_id string, fold int, k string")
    got = {r.k: r.mean_floor for r in evaluate.fold_floors(rows.withColumn("k", F.col("group_id")), folds, ["k"]).collect()}
    assert got["a"] == 0.4970235 and abs(got["b"] / (5e17 / 3) - 1) < 1e-15 and got["c"] == float("inf") and abs(got["d"] - 1 / 6) < 1e-16
    assert [r[0] for r in rows.filter("group_id = 'a'").agg(F.round(mean("y_true"), 6)).collect()] == [0.497024]
