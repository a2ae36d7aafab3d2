"""Model answers as records: parsing, latest-wins, frozen scoring, costs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import u01

KEYS = ("rho_k2", "rho_k3", "rho_k4", "rho_k5")


def last_object(text: Column) -> Column:
    """The last flat JSON object in the text (after any reasoning part), bare NaN read as null."""
    body = F.element_at(F.split(text, "</think>"), -1)
    found = F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.regexp_replace(F.element_at(found, F.nullif(F.size(found), F.lit(0))), r"\bNaN\b", "null")


def valid_unit(obj: Column, key: str) -> Column:
    """The number under ``key`` if it is a JSON number in [0, 1]; text and booleans are not numbers."""
    raw = F.regexp_extract(obj, rf'"{key}"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*[,}}]', 1)
    value = F.nullif(raw, F.lit("")).try_cast("double")
    return F.when(value.between(0.0, 1.0), value)


def latest(records: DataFrame, key: Sequence[str], complete: str, order: Sequence[str]) -> DataFrame:
    """One record for each key: the last complete one, else the last one."""
    w = W.partitionBy(*key).orderBy(F.col(complete).desc(), *(F.col(c).desc() for c in order))
    return records.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def last_values(records: DataFrame, key: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """The legacy rule: the last non-null value of each column on its own."""
    return records.groupBy(*key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def frozen_score(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows: p2..p5 (valid numbers or null), t2..t5, answered.

    An invalid entry costs 1 and is never clipped; a case without an answer is
    missing and costs nothing.  Penalised error over answered cases, plain
    error over complete ones, share of valid entries, monotonicity breaks."""
    loss = [F.coalesce(F.abs(F.col(f"p{k}") - F.col(f"t{k}")), F.lit(1.0)) for k in range(2, 6)]
    ok = [F.col(f"p{k}").isNotNull().cast("int") for k in range(2, 6)]
    s = (
        rows.withColumn("loss", (loss[0] + loss[1] + loss[2] + loss[3]) / 4)
        .withColumn("ok", ok[0] + ok[1] + ok[2] + ok[3])
        .withColumn("broken", F.expr("coalesce(p2 < p3 or p3 < p4 or p4 < p5, false)"))
    )
    answered = lambda c: F.avg(F.when(F.col("answered"), c))
    return s.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.sum((~F.col("answered")).cast("long")).alias("missing"),
        F.sum((F.col("answered") & (F.col("ok") < 4)).cast("long")).alias("failed"),
        answered(F.col("loss")).alias("penalized_pmae"),
        F.avg(F.when(F.col("answered") & (F.col("ok") == 4), F.col("loss"))).alias("complete_pmae"),
        answered(F.col("ok") / 4.0).alias("validity"),
        F.avg(F.when(F.col("p2").isNotNull(), F.abs(F.expr("p2 - t2")))).alias("rho2_mae"),
        F.avg(F.expr("p2 - t2")).alias("rho2_bias"),
        answered(F.col("broken").cast("double")).alias("violation_rate"),
    )


def interval_cover(rows: DataFrame, by: Sequence[str], low: str, high: str, truth: str) -> DataFrame:
    ok = rows.filter(F.col(low).isNotNull() & F.col(high).isNotNull() & F.col(truth).isNotNull())
    return ok.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col(truth).between(F.col(low), F.col(high))).cast("double")).alias("cover"),
        F.avg(F.col(high) - F.col(low)).alias("width"),
    )


def paired_delta(rows: DataFrame, case: str, arm: str, value: str, baseline: str) -> DataFrame:
    """Mean difference to the baseline arm over the cases that both have, with its standard error."""
    base = rows.filter(F.col(arm) == baseline).groupBy(case).agg(F.avg(value).alias("b"))
    arms = rows.filter(F.col(arm) != baseline).groupBy(case, arm).agg(F.avg(value).alias("a"))
    d = arms.join(base, case).withColumn("d", F.expr("a - b"))
    return d.groupBy(arm).agg(F.count("*").alias("n"), F.avg("d").alias("delta"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))


def _poisson_steps(bits: int = 32) -> list[float]:
    """Distribution function of a Poisson(1) variable, as far as a uniform number of ``bits`` bits can reach."""
    steps, p, total = [], math.exp(-1), 0.0
    for k in itertools.count(1):
        total += p
        if 1 - total < 2.0**-bits:
            return steps
        steps.append(total)
        p /= k


POISSON = _poisson_steps()


def bootstrap_delta(deltas: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(case, d) -> mean and percentile interval; each draw weighs cases by hashed Poisson(1) counts, by inversion."""
    n = sum(((F.col("u") >= p).cast("int") for p in POISSON[1:]), (F.col("u") >= POISSON[0]).cast("int"))
    each = deltas.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", u01(str(seed), F.col("case"), F.col("draw"))).withColumn("w", n)
    means = each.groupBy("draw").agg(F.expr("try_divide(sum(w * d), sum(w))").alias("m")).filter("m is not null")
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return deltas.agg(F.avg("d").alias("delta"), F.count("*").alias("n")).crossJoin(F.broadcast(ends))


def cost(rows: DataFrame, by: Sequence[str], hit: float, miss: float, output: float) -> DataFrame:
    """Token sums and their price (per million) from n_hit, n_miss, n_out."""
    price = (F.sum("n_hit") * hit + F.sum("n_miss") * miss + F.sum("n_out") * output) / 1e6
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("n_hit").alias("hit_tokens"), F.sum("n_miss").alias("miss_tokens"), F.sum("n_out").alias("out_tokens"), price.alias("usd"))


def attempts(records: DataFrame, key: str, state: str) -> DataFrame:
    """For each key: attempts, complete ones, whether it is still to do."""
    return records.groupBy(key).agg(
        F.count("*").alias("attempts"), F.sum((F.col(state) == "stop").cast("long")).alias("complete"), (F.sum((F.col(state) == "stop").cast("long")) == 0).alias("todo")
    )


def paired_cases(records: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """Cases answered completely for which a prompt exists: a semi-join; the rest is the anti-join."""
    return records.filter("complete").select(key).distinct().join(prompts.select(key).distinct(), key, "left_semi")
