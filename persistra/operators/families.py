"""Families of synthetic networks, designs of panels, candidate picks.

A family is what timing twins share: dyads, events for each, the multiset of times.  All draws are hashes of ids, so
that a lost task draws the same again.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import u01

#: fixed values: share of dyads with one event; lognormal further events (median 2)
P_SINGLE = 0.35
EXTRA_MEDIAN, EXTRA_SIGMA = 2.0, 0.9
BLOCK = 1 << 16


def normal(seed: str, what: str, key: Column) -> Column:
    """Standard normal of a key, by Box and Muller."""
    radius = F.sqrt(-2 * F.log(1 - u01(seed, f"{what}a", key)))
    return radius * F.cos(2 * F.pi() * u01(seed, f"{what}b", key))


def event_counts(edges: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """m for every dyad: one, or one and a lognormal number of further events, rounded to even, at least one."""
    k, s = F.col(key), str(seed)
    extra = F.greatest(F.lit(1.0), F.bround(EXTRA_MEDIAN * F.exp(EXTRA_SIGMA * normal(s, "extra", k))))
    return edges.withColumn("m", F.when(u01(s, "single", k) < P_SINGLE, 1).otherwise(1 + extra).cast("long"))


def times(spark: SparkSession, events: int, kind: str = "uniform", sigma: float = 1.6, seed: int = 0) -> DataFrame:
    """(i, t): the multiset of times on [0, 1]; bursty ones are running sums of lognormal gaps.

    Sums run inside blocks of ``BLOCK`` and over the blocks' totals, so no task holds the stream."""
    n = spark.range(events).withColumnRenamed("id", "i")
    if kind == "uniform":
        return n.withColumn("t", u01(str(seed), "time", F.col("i")))
    if kind != "bursty":
        raise ValueError(f"times are uniform or bursty, not {kind!r}")
    if events == 1:
        return n.withColumn("t", F.lit(0.5))
    gaps = n.withColumn("block", F.expr(f"i div {BLOCK}")).withColumn("gap", F.exp(sigma * normal(str(seed), "gap", F.col("i"))))
    total = gaps.groupBy("block").agg(F.sum("gap").alias("size"), F.min_by("gap", "i").alias("head"))
    # one row for each BLOCK of events
    before = total.select("block", (F.sum("size").over(W.orderBy("block")) - F.col("size")).alias("before"))
    ends = total.agg(F.sum("size").alias("end"), F.min_by("head", "block").alias("start"))
    run = F.sum("gap").over(W.partitionBy("block").orderBy("i"))
    out = gaps.withColumn("run", run).join(before, "block").crossJoin(F.broadcast(ends))
    return out.select("i", F.expr("(before + run - start) / (end - start) * (1 - 1e-9D)").alias("t"))


def family_from_events(events: DataFrame) -> DataFrame:
    """(u, v, m, deg_u, deg_v): events and both ends' degrees of every dyad of a stream u, v, t."""
    edges = events.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("m"))
    degree = edges.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("deg"))
    of = lambda side: degree.select(F.col("x").alias(side), F.col("deg").alias(f"deg_{side}"))
    return edges.join(of("u"), "u").join(of("v"), "v").select("u", "v", "m", "deg_u", "deg_v")


def grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """One row for each combination of a design's levels; the levels are parameters."""
    out = None
    for name, levels in axes.items():
        one = spark.createDataFrame([(x,) for x in levels], f"{name} {'string' if isinstance(levels[0], str) else 'double' if isinstance(levels[0], float) else 'long'}")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def calibration(rows: DataFrame, by: Sequence[str], target: str, achieved: str) -> DataFrame:
    """For each cell of a design: instances, mean and deviation of what was achieved, mean distance from the target."""
    return rows.groupBy(*by).agg(
        F.count(achieved).alias("n_inst"), F.avg(achieved).alias("achieved_mean"), F.stddev_samp(achieved).alias("achieved_sd"),
        F.avg(F.abs(F.col(achieved) - F.col(target))).alias("abs_dev_mean"), F.max(F.abs(F.col(achieved) - F.col(target))).alias("abs_dev_max"),
    )


def near_profile_candidates(pairs: DataFrame, delta: str, gap: str, keys: Sequence[str], near: float = 0.03, least: int = 20, top: int = 100) -> DataFrame:
    """Pairs with profiles within ``near``, widest gap first; all pairs by nearness where those are under ``least``."""
    close = pairs.agg(F.sum(F.expr(f"bigint({delta} <= {near})")).alias("_close"))
    enough = f"_close >= {least}"
    some = pairs.crossJoin(F.broadcast(close)).filter(f"not ({enough}) or {delta} <= {near}")
    return some.orderBy(F.expr(f"if({enough}, 0D, {delta})"), F.desc(gap), *keys).limit(top).drop("_close")


def farthest_pick(rows: DataFrame, by: Sequence[str], key: str, y: str, quota: int) -> DataFrame:
    """``quota`` rows of every group: the one nearest the median of y first, then always the row whose y is farthest
    from those picked, ties to the least key.

    Sequential by nature and for panels of cases: a task holds one candidate (the least key) of each distinct y of its
    group.  Repeats of a value are picked only after all distinct values, least keys first; rows without y never."""
    order = W.partitionBy(*by, y).orderBy(key)
    ranked = rows.filter(F.col(y).isNotNull()).withColumn("_again", F.row_number().over(order))
    heads = ranked.filter("_again = 1")
    middle = rows.groupBy(*by).agg(F.percentile(y, F.lit(0.5)).alias("_mid"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, ignore_index=True)
        gap = (group[y] - group["_mid"]).abs()
        chosen: list[int] = []
        at = int(gap.idxmin())
        far = pd.Series(float("inf"), index=group.index)
        while len(chosen) < min(quota, len(group)):
            chosen.append(at)
            far = far.combine((group[y] - group[y][at]).abs(), min)
            far[at] = -1.0
            at = int(far.idxmax())
        out = group.loc[chosen, [*by, key, y]]
        return out.assign(pick=range(1, len(out) + 1))

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, key, y]) + ", pick long"
    first = heads.select(*by, key, y).join(middle, list(by)).groupBy(*by).applyInPandas(pick, schema)
    distinct = heads.groupBy(*by).agg(F.count("*").alias("_n"))
    rest = ranked.filter("_again > 1").join(distinct, list(by)).withColumn("pick", F.col("_n") + F.row_number().over(W.partitionBy(*by).orderBy(key)))
    return first.unionByName(rest.filter(F.col("pick") <= quota).select(*by, key, y, "pick"))


BINS = ("1", "2", "3", "4", "5", "6-10", "11+")


def prompt_table(seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The counts of (n, w) as the text that a prompt shows: a head, then a line for each bin of n, w from 1 to 5."""
    label = F.when(F.col("n") <= 5, F.col("n").cast("string")).when(F.col("n") <= 10, "6-10").otherwise("11+")
    cells = seen.withColumn("bin", label).groupBy(*by).agg(*(F.count(F.expr(f"if(bin = '{b}' and w = {w}, 1, null)")).alias(f"_{i}_{w}") for i, b in enumerate(BINS) for w in range(1, 6)))
    head = F.lit("events | w=1 w=2 w=3 w=4 w=5")
    lines = [F.format_string(f"n = {b} | %d %d %d %d %d", *(F.col(f"_{i}_{w}") for w in range(1, 6))) for i, b in enumerate(BINS)]
    return cells.select(*by, F.concat_ws("\n", head, *lines).alias("table"))
