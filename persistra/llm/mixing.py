"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent in [0, 1] and
normalised.  Bisection finds the exponent: as large as meets the target
entropy (a fraction of the largest possible), but no smaller than the limit on
repetitions allows.  Six levels of the bisection are evaluated in one
aggregation over the per-source table, which never reaches the driver.

The weights are realised under a token budget.  Each source is cut into blocks
by a hash, and the blocks are put in an order drawn by hash; a source is
passed in whole as often as its budget holds it, and the rest is the beginning
of one more pass: whole blocks in that order, and of the block where the budget
ends the documents in hash order that still fit.  A block's place follows from
its own key, so the plan is one row for each source.

The default budget is the least that passes every source once: nothing is
lost, small sources are repeated.

Defined cases.  A null source is a source of its own.  Texts without words
(null, empty) count no tokens; a source without tokens has weight 0 and is
passed once.  Repeated rows are drawn like any others.  One source: weight 1.
An empty table gives an empty result.  Extra columns come along, but for ones
named like those added.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.llm.base import Scratch

TARGET = 0.95
MAX_EPOCHS = 2.0
BLOCK_DOCS = 4096
LEVELS, PASSES = 6, 5


def n_words(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, target: float, max_epochs: float, budget: float | None = None) -> float:
    """sources: n (tokens, over 0) for each source."""
    count, total, largest, least = sources.agg(F.count("*"), F.sum("n"), F.max("n"), F.min("n")).first()
    if count < 2:
        return 1.0
    top, bottom = largest / total, least / total

    def measured(points: list[float]) -> list[tuple[float, float]]:
        """(entropy, passes of the source repeated most) at each exponent."""
        p = F.col("n") / float(total)
        grid = sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("a"))
        sums = grid.groupBy("a").agg(F.sum(F.expr("pow(p, a)")).alias("z"), F.sum(F.expr("pow(p, a) * ln(p)")).alias("l"))
        by = {r["a"]: (r["z"], r["l"]) for r in sums.collect()}
        out = []
        for a in points:
            z, l = by[a]
            drawn = budget / total if budget is not None else z * top ** (1 - a)
            out.append((math.log(z) - a * l / z, bottom ** (a - 1) / z * drawn))
        return out

    def bisect(holds) -> tuple[float, float]:
        """Neighbouring exponents where a condition that holds at the low end does and does not hold."""
        if holds(*measured([1.0])[0]):
            return 1.0, 1.0
        if not holds(*measured([0.0])[0]):
            return 0.0, 0.0
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * i / 2**LEVELS for i in range(2**LEVELS + 1)]
            at = measured(points)
            a, b = 0, 2**LEVELS
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if holds(*at[m]) else (a, m)
            low, high = points[a], points[b]
        return low, high

    even = bisect(lambda entropy, epochs: entropy >= target * math.log(count))[0]
    spare = bisect(lambda entropy, epochs: epochs > max_epochs)[1]
    return max(math.floor(even * 1e8) / 1e8, math.ceil(spare * 1e8) / 1e8)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with n_tokens, weight (of the source) and copies (times drawn)."""
    names = [c for c in docs.columns if c.lower() not in ("n_tokens", "weight", "copies")]
    return planned(docs, **how).select(*(f"row.{c}" for c in names), "n_tokens", "weight", "copies")


def drawn(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn."""
    return planned(docs, **how).filter("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def planned(docs: DataFrame, target: float = TARGET, max_epochs: float = MAX_EPOCHS, budget: float | None = None, block_docs: int = BLOCK_DOCS, seed: int = 1) -> DataFrame:
    """row (all columns of ``docs``), n_tokens, weight, copies."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"))
    named = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), n_words().alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id").alias("draw"))
    counted = scratch.keep(named.select("key", "n_tokens", "draw"), "counted")
    sources = scratch.keep(counted.groupBy("key").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d")), "sources")
    filled = sources.filter("n > 0")
    a = exponent(filled, target, max_epochs, budget)
    z, total, largest = filled.agg(F.sum(F.pow("n", F.lit(a))), F.sum("n"), F.max("n")).first()
    tokens = budget if budget is not None else (largest ** (1 - a) * z if z else 0.0)
    plan = sources.select(
        "key",
        "n",
        F.ceil(F.col("d") / block_docs).alias("blocks"),
        F.when(F.col("n") > 0, F.pow("n", F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0).alias("weight"),
    ).withColumn("goal", F.floor(F.col("weight") * F.lit(float(tokens) * (1 + 1e-12)) + 1e-6)).withColumn("full", F.expr("if(n > 0, goal div n, 1L)")).withColumn("rest", F.expr("if(n > 0, goal % n, 0L)"))
    plan = scratch.keep(plan, "plan")
    block = F.xxhash64(F.lit(seed + 1), "key.s", "key.none", F.pmod("draw", "blocks"))
    sums = counted.join(plan, "key").filter("rest > 0").groupBy("key", "rest", block.alias("block")).agg(F.sum("n_tokens").alias("b"))
    running = sums.withColumn("upto", F.sum("b").over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, 0)))
    ends = running.filter("upto > rest").groupBy("key").agg(F.min("block").alias("end"), F.min("upto").alias("upto"), F.min_by("b", "block").alias("b"))
    plan = scratch.keep(plan.join(ends, "key", "left").selectExpr("key", "blocks", "round(weight, 9) as weight", "full", "end", "rest - (upto - b) as room"), "ends")
    scratch.drop("counted", "sources", "plan")
    placed = named.join(plan, "key").withColumn("block", block)
    whole = placed.filter("end is null or block <> end").withColumn("copies", F.expr("full + if(block < end, 1L, 0L)"))
    last = W.partitionBy("key").orderBy("draw", "row.doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    edge = placed.filter("block = end").withColumn("copies", F.expr("full") + F.when(F.sum("n_tokens").over(last) <= F.col("room"), 1).otherwise(0))
    out = ["row", "n_tokens", "weight", F.col("copies").cast("long").alias("copies")]
    return whole.select(*out).unionByName(edge.select(*out))
