"""Surrogates that keep part of a stream, and synthetic streams.

Permutations are joins of two row numbers over the same rows: one in event
order, one in hash order.  Within-window and per-dyad variants partition both,
so a task sorts one window or dyad.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import u01, window_index
from persistra.operators.census import with_horizon
from persistra.operators.samplers import hash_order, keyed


def _permuted(events: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    w = W.partitionBy(*by)
    slots = events.withColumn("i", F.row_number().over(w.orderBy("t", "eid")))
    draws = events.withColumn("i", F.row_number().over(w.orderBy(hash_order(seed), "eid")))
    return slots.select(*by, "i", "u", "v", "eid").join(draws.select(*by, "i", "t"), [*by, "i"]).drop("i")


def timestamp_shuffle(events: DataFrame, seed: int = 0) -> DataFrame:
    """All times permuted over all events: same dyad counts, same times.

    Both orders are ranked by range partitions and their row counts, so no task
    sorts everything."""
    e = keyed(events)
    slots = ranked(e, ["t", "eid"]).select("i", "u", "v", "eid")
    draws = ranked(e.withColumn("h", hash_order(seed)), ["h", "eid"]).select("i", "t")
    return slots.join(draws, "i").drop("i")


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds i, the row's number (from 1) in the given total order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = rows.repartitionByRange(parts, *order).withColumn("p", F.spark_partition_id()).persist()
    sizes = p.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.select("p", F.coalesce(F.sum("c").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return p.join(F.broadcast(before), "p").withColumn("i", F.row_number().over(W.partitionBy("p").orderBy(*order)) + F.col("before")).drop("p", "before")


def within_window_shuffle(events: DataFrame, seed: int = 0, windows: int = 5) -> DataFrame:
    """Times permuted inside each window: same dyad counts in every window."""
    e = with_horizon(keyed(events)).withColumn("w", window_index("t", "t0", "t1", windows)).drop("t0", "t1")
    return _permuted(e, ["w"], seed)


def lifetime_resample(events: DataFrame, seed: int = 0) -> DataFrame:
    """First and last times of each dyad kept, times between drawn uniformly."""
    e = keyed(events)
    ends = e.groupBy("u", "v").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("c"))
    k = F.element_at(F.split("eid", r"\|"), -1).cast("long")
    drawn = F.col("a") + (F.col("b") - F.col("a")) * u01(str(seed), "life", F.col("eid"))
    return e.join(ends, ["u", "v"]).select("u", "v", "eid", F.when(k == 1, F.col("a")).when(k == F.col("c"), F.col("b")).otherwise(drawn).alias("t"))


def rewire(events: DataFrame, seed: int = 0, swaps_per_edge: int = 5) -> DataFrame:
    """Degree-preserving double edge swaps; series move with their edges.  Sequential by nature: one network, one group."""
    series = keyed(events).groupBy("u", "v").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"]).reset_index(drop=True)
        rng = np.random.default_rng(seed)
        edges = [list(x) for x in zip(pdf["u"], pdf["v"])]
        have = {tuple(e) for e in edges}
        for _ in range(swaps_per_edge * len(edges)):
            i, j = rng.integers(len(edges), size=2)
            (a, b), (c, d) = edges[i], edges[j]
            if rng.random() < 0.5:
                c, d = d, c
            x, y = tuple(sorted((a, d))), tuple(sorted((c, b)))
            if len({a, b, c, d}) == 4 and x not in have and y not in have:
                have -= {tuple(edges[i]), tuple(edges[j])}
                have |= {x, y}
                edges[i], edges[j] = list(x), list(y)
        pdf["u"], pdf["v"] = zip(*edges) if edges else ((), ())
        return pdf

    out = series.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda p: swap(p[["u", "v", "ts"]]), "u string, v string, ts array<double>")
    return out.select("u", "v", F.explode("ts").alias("t"))


def invariants(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either multiset that the other lacks; empty when the surrogate keeps ``keys``."""
    return a.select(*keys).exceptAll(b.select(*keys)).union(b.select(*keys).exceptAll(a.select(*keys)))


# synthetic streams ---------------------------------------------------------


def dar_stream(spark: SparkSession, pairs: int, rho: float, alpha: float, windows: int = 5, seed: int = 0) -> DataFrame:
    """Each dyad's activity in a window copies the one before with probability alpha, else is drawn with
    probability rho; an active window has 1 + Poisson(0.5)-like events at uniform times."""
    e = spark.range(pairs).withColumn("a0", u01(str(seed), "d", F.col("id"), F.lit(0)) < rho)
    for w in range(1, windows):
        keep = u01(str(seed), "k", F.col("id"), F.lit(w)) < alpha
        e = e.withColumn(f"a{w}", F.when(keep, F.col(f"a{w - 1}")).otherwise(u01(str(seed), "d", F.col("id"), F.lit(w)) < rho))
    long = e.select("id", F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.col(f"a{w}").alias("on")) for w in range(windows)))).alias("x")).filter("x.on")
    many = u01(str(seed), "n", F.col("id"), F.col("x.w"))
    count = F.lit(1) + (many > 0.6065).cast("int") + (many > 0.9098).cast("int") + (many > 0.9856).cast("int")
    rows = long.withColumn("j", F.explode(F.sequence(F.lit(1), count)))
    t = (F.col("x.w") + u01(str(seed), "t", F.col("id"), F.col("x.w"), F.col("j"))) / windows
    return rows.select(F.concat(F.lit("a"), F.col("id")).alias("u"), F.concat(F.lit("b"), F.col("id")).alias("v"), t.alias("t"))


def renewal_stream(spark: SparkSession, pairs: int, mean_events: float = 4.0, shape: float = 1.8, seed: int = 0) -> DataFrame:
    """Geometric number of events at Pareto gaps, each dyad scaled to a uniform lifetime."""
    p = 1 / mean_events
    size = F.greatest(F.lit(1), F.least(F.lit(200), F.ceil(F.ln(1 - u01(str(seed), "n", F.col("id"))) / F.lit(float(np.log(1 - p)))))).cast("int")
    e = spark.range(pairs).withColumn("n", size).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n"))))
    e = e.withColumn("gap", F.pow(1 - u01(str(seed), "g", F.col("id"), F.col("j")), F.lit(-1 / shape)) - 1)
    w = W.partitionBy("id")
    e = e.withColumn("past", F.sum("gap").over(w.orderBy("j"))).withColumn("all", F.sum("gap").over(w) + 1)
    start, life = u01(str(seed), "s", F.col("id")), u01(str(seed), "l", F.col("id"))
    return e.select(F.concat(F.lit("a"), F.col("id")).alias("u"), F.concat(F.lit("b"), F.col("id")).alias("v"), (start + (1 - start) * life * F.col("past") / F.col("all")).alias("t"))


def activity_stream(spark: SparkSession, networks: int, nodes: int, slots: int, memory: float = 0.6, seed: int = 0) -> DataFrame:
    """Activity-driven contacts with memory: an active node repeats an earlier partner or finds a new one.
    Sequential in time; networks are independent groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net = int(pdf["id"].iloc[0])
        rng = np.random.default_rng([seed, net])
        rate = np.minimum(1, 0.05 * (1 - rng.random(nodes)) ** -0.6)
        known: list[list[int]] = [[] for _ in range(nodes)]
        out = []
        for s in range(slots):
            for a in np.flatnonzero(rng.random(nodes) < rate):
                if known[a] and rng.random() < memory:
                    b = known[a][rng.integers(len(known[a]))]
                else:
                    b = int(rng.integers(nodes - 1))
                    b += b >= a
                known[a].append(b)
                known[b].append(int(a))
                out.append((f"g{net}", f"n{a}", f"n{b}", (s + rng.random()) / slots))
        return pd.DataFrame(out, columns=["instance_id", "u", "v", "t"])

    return spark.range(networks).groupBy("id").applyInPandas(run, "instance_id string, u string, v string, t double")


def block_graph(spark: SparkSession, nodes: int, blocks: int, degree: float, mixing: float = 0.1, seed: int = 0) -> DataFrame:
    """Degree-corrected block model edges (u < v): Bernoulli 1 - exp(-rate), drawn by hash.  Small graphs: all node pairs are tried."""
    n = spark.range(nodes).withColumn("k", F.exp(F.sqrt(-2 * F.ln(1 - u01(str(seed), "p", F.col("id")))) * F.cos(2 * np.pi * u01(str(seed), "q", F.col("id"))) * 0.8)).withColumn("b", F.pmod("id", F.lit(blocks)))
    m = n.select(F.col("id").alias("j"), F.col("k").alias("kj"), F.col("b").alias("bj"))
    same = F.when(F.col("b") == F.col("bj"), 1 - mixing + mixing / blocks).otherwise(mixing / blocks) * blocks
    rate = F.col("k") * F.col("kj") * same * degree / nodes / 1.9
    return n.join(m, F.col("id") < F.col("j")).filter(u01(str(seed), "e", F.col("id"), F.col("j")) < 1 - F.exp(-rate)).select(F.col("id").alias("u"), F.col("j").alias("v"))
