"""Case tables derived from the driver tables.

Instances are the nations of the customers in the customer-supplier stream,
groups their regions.  Each instance is sampled by three strategies at two
budgets and up to two seeds; a case holds what the sample says (plug-in) and
the instance's own truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from persistra.functions.exprs import r6, window_index
from persistra.operators import census, estimators, features, samplers
from persistra.sources.scratch import written
from persistra.sources.streams import cust_supp, epoch, table

BUDGETS = (100, 400)


def nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, group_id, u, v, t): the stream by customer nation."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", epoch("o_orderdate").alias("t"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("n"), "c_nationkey").alias("instance_id"), F.concat(F.lit("r"), "n_regionkey").alias("group_id"),
            F.concat(F.lit("c"), "o_custkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v"), "t",
        )
    )


def nation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation_rows`` with t0 and t1, the whole stream's horizon."""
    return census.with_horizon(nation_rows(spark, sf_dir))


def truth(events: DataFrame) -> DataFrame:
    """One row for each instance: the profile of all its dyads."""
    d = events.withColumn("w", window_index("t", "t0", "t1", 5)).groupBy("instance_id", "group_id", "u", "v").agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, w))").alias("mask"))
    d = d.withColumn("w", F.expr("bit_count(mask)"))
    own = estimators.plugin(d, ["instance_id", "group_id"])
    pairs = d.groupBy("instance_id", "group_id").agg(F.count("*").alias("n_pairs"))
    return own.join(pairs, ["instance_id", "group_id"]).select("instance_id", "group_id", "n_pairs", *(r6(f"rho_{k}").alias(f"true_{k}") for k in range(2, 6)), r6("c_one_step").alias("true_c"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case table, written: later branches of a plan read its few rows."""
    e = census.with_horizon(written(samplers.ranked(nation_rows(spark, sf_dir), ["instance_id", "group_id"]), "ranked"))
    log = samplers.positions(e, ["instance_id", "group_id"], max(BUDGETS)).withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS)))).filter("pos <= budget")
    key = ["instance_id", "group_id", "strategy", "seed", "budget"]
    seen = written(features.edge_observations(log.withColumn("w", window_index("t", "t0", "t1", 5)), key), "seen")
    own = estimators.plugin(seen, key)
    counts = seen.groupBy(*key).agg(F.count("*").alias("n_seen"))
    out = (
        own.join(counts, key)
        .join(truth(e), ["instance_id", "group_id"])
        .select(
            F.concat_ws("|", "instance_id", "strategy", F.concat(F.lit("s"), "seed"), F.concat(F.lit("b"), "budget")).alias("case_id"),
            *key,
            (F.col("n_seen") / F.col("n_pairs")).alias("coverage"),
            *(r6(f"rho_{k}").alias(f"pred_{k}") for k in range(2, 6)),
            *(f"true_{k}" for k in range(2, 6)),
            r6("c_one_step").alias("pred_c"),
            "true_c",
        )
    )
    return written(out, "cases")


def predictions(c: DataFrame) -> DataFrame:
    """Long: one row for each case and model; the shrunk models pull the plug-in towards the base rate 0.2."""
    models = F.explode(F.array(*(F.struct(F.lit(f"shrink_{i}").alias("model"), F.lit(i).alias("parameter"), F.lit(1 - i / 4).alias("a")) for i in range(4)))).alias("m")
    value = F.col("m.a") * F.col("pred_2") + (1 - F.col("m.a")) * 0.2
    return c.select("case_id", "instance_id", "group_id", "strategy", "seed", "budget", "coverage", models, "pred_2", "true_2").select(
        "case_id", "instance_id", "group_id", "strategy", "seed", "budget", "coverage", "m.model", "m.parameter", value.alias("prediction"), F.col("true_2").alias("y_true")
    )
