"""Feature tables from a sample log (pos, u, v, t, w): one row of a log is one event seen.

``w`` is the event's window on the whole horizon.  A smaller budget is a
filter on pos before any of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import ratio, window_mask

LOWEST = "cast(log2(double(mask & -mask)) as int)"
HIGHEST = "cast(floor(log2(double(mask)) + 1e-9) as int)"


def edge_observations(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n events, window mask and active windows of every dyad seen."""
    seen = log.groupBy(*by, "u", "v").agg(F.count("*").alias("n"), window_mask("w").alias("mask"))
    return seen.withColumn("w", F.expr("bit_count(mask)"))


def nw_histogram(seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return seen.groupBy(*by, "n", "w").agg(F.count("*").alias("c"))


def nmask_histogram(seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return seen.groupBy(*by, "n", F.lpad(F.lower(F.hex("mask")), 2, "0").alias("mask_hex")).agg(F.count("*").alias("c"))


def window_counts(log: DataFrame, windows: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """c0..c4 for every dyad: events in each window."""
    return log.groupBy(*by, "u", "v").agg(*(F.sum(F.expr(f"bigint(w = {i})")).alias(f"c{i}") for i in range(windows)))


def window_count_histogram(log: DataFrame, windows: int = 5, by: Sequence[str] = ()) -> DataFrame:
    keys = [f"c{i}" for i in range(windows)]
    return window_counts(log, windows, by).groupBy(*by, *keys).agg(F.count("*").alias("c"))


def window_count_features(log: DataFrame, windows: int = 5) -> DataFrame:
    """(i, j): correlation and both-positive share of two windows' counts; (i, i): mean and log mean."""
    counts = window_counts(log, windows)
    pairs = F.explode(
        F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i in range(windows) for j in range(i, windows)))
    ).alias("p")
    return (
        counts.select(pairs)
        .select("p.*")
        .groupBy("i", "j")
        .agg(
            F.avg("x").alias("mean_x"),
            F.avg(F.log1p("x")).alias("mean_log1p"),
            F.avg(F.expr("double(x > 0 and y > 0)")).alias("both_share"),
            ratio(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("corr"),
        )
    )


def occupancy_features(seen: DataFrame) -> DataFrame:
    """Shares of (n up to 20, w) and quantiles of n."""
    total = seen.agg(F.count("*").alias("total"), *(F.percentile("n", F.lit(q)).alias(f"n_q{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9)))
    bins = seen.groupBy(F.least("n", F.lit(20)).alias("n_bin"), "w").agg(F.count("*").alias("c"))
    return bins.crossJoin(F.broadcast(total)).withColumn("share", F.col("c") / F.col("total"))


def pattern_features(seen: DataFrame, windows: int = 5) -> DataFrame:
    width = f"({HIGHEST} - {LOWEST} + 1)"
    return seen.agg(
        F.avg(F.expr(LOWEST)).alias("first_window_mean"),
        F.avg(F.expr(HIGHEST)).alias("last_window_mean"),
        F.avg(F.expr(f"double({width})")).alias("mask_width_mean"),
        F.avg(F.expr(f"double({width} > w)")).alias("noncontiguous_share"),
        ratio(F.sum(F.expr("bit_count(mask & shiftright(mask, 1))")), F.sum(F.expr(f"bit_count(mask & {(1 << (windows - 1)) - 1}L)"))).alias("adjacent_c"),
        *(F.avg(F.expr(f"double((mask & {1 << i}L) > 0)")).alias(f"active_w{i}") for i in range(windows)),
    )


def mask_shares(seen: DataFrame) -> DataFrame:
    total = seen.agg(F.count("*").alias("total"))
    return seen.groupBy("mask").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("mask", (F.col("c") / F.col("total")).alias("share"))


def steps(log: DataFrame) -> DataFrame:
    """The log with gap (rows since the dyad was last seen) and fresh (first sight of the dyad)."""
    w = W.partitionBy("u", "v").orderBy("pos")
    return log.withColumn("gap", F.col("pos") - F.lag("pos").over(w)).withColumn("fresh", F.row_number().over(w) == 1)


def crawl_features(log: DataFrame, budget: int) -> DataFrame:
    """Unique dyads and nodes, revisit rate, discovery at parts of the log, return gaps, degree."""
    s = steps(log)
    nodes = log.select(F.col("u").alias("x"), "pos").union(log.select(F.col("v").alias("x"), "pos"))
    again = nodes.withColumn("k", F.row_number().over(W.partitionBy("x").orderBy("pos"))).filter("k = 2").agg(F.min("pos").alias("first_node_collision"))
    degree = nodes.groupBy("x").agg(F.count("*").alias("d")).agg(F.count("*").alias("unique_nodes"), F.avg("d").alias("node_hits_mean"), F.max("d").alias("node_hits_max"))
    parts = []
    for q in (10, 25, 50, 75, 100):
        n = -(-budget * q // 100)
        parts.append((F.sum(F.expr(f"bigint(fresh and pos <= {n})")) / F.sum(F.expr(f"bigint(pos <= {n})"))).alias(f"discovery_{q}"))
    seen = s.agg(
        F.count("*").alias("steps"),
        F.sum(F.expr("bigint(fresh)")).alias("unique_edges"),
        F.avg(F.expr("double(not fresh)")).alias("revisit_rate"),
        F.percentile("gap", F.lit(0.5)).alias("return_gap_median"),
        F.percentile("gap", F.lit(0.9)).alias("return_gap_q90"),
        *parts,
    )
    return seen.crossJoin(F.broadcast(degree)).crossJoin(F.broadcast(again))


def recent_events(log: DataFrame, limit: int = 100) -> DataFrame:
    """The last events with anonymous node numbers in order of first appearance."""
    last = log.orderBy(F.desc("pos")).limit(limit)
    nodes = last.select(F.col("u").alias("x"), F.struct("pos", F.lit(0).alias("s")).alias("at")).union(last.select(F.col("v").alias("x"), F.struct("pos", F.lit(1).alias("s")).alias("at")))
    ids = nodes.groupBy("x").agg(F.min("at").alias("at")).withColumn("i", F.row_number().over(W.orderBy("at")) - 1)
    return (
        last.join(ids.select(F.col("x").alias("u"), F.col("i").alias("a")), "u")
        .join(ids.select(F.col("x").alias("v"), F.col("i").alias("b")), "v")
        .select("pos", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.bround("t", 8).alias("t"))
    )


def nonstationarity(log: DataFrame, bins: int = 10) -> DataFrame:
    """Rate variation over ten bins, slope over mean, late over early share.  t on [0, 1]."""
    b = log.groupBy(F.expr(f"least({bins - 1}, cast(floor(t * {bins}) as int))").alias("b")).agg(F.count("*").alias("c"))
    frame = log.sparkSession.range(bins).select(F.col("id").cast("int").alias("b")).join(F.broadcast(b), "b", "left").select("b", F.coalesce("c", F.lit(0)).cast("double").alias("c"))
    return frame.agg(
        ratio(F.stddev_pop("c"), F.avg("c")).alias("rate_cv"),
        ratio(F.regr_slope("c", F.col("b").cast("double")), F.avg("c")).alias("slope_over_mean"),
        ratio(F.sum(F.expr(f"if(b >= {bins // 2}, c, 0D)")), F.sum(F.expr(f"if(b < {bins // 2}, c, 0D)"))).alias("late_early_ratio"),
    )


def degree_ks(population: DataFrame, sample: DataFrame) -> DataFrame:
    """(x) values of all and of sampled nodes: mean ratio and the two-sample Kolmogorov-Smirnov distance."""
    both = population.select("x", F.lit(1).alias("p"), F.lit(0).alias("s")).union(sample.select("x", F.lit(0).alias("p"), F.lit(1).alias("s")))
    by = both.groupBy("x").agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
    run = W.orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    total = by.agg(F.sum("p").alias("np"), F.sum("s").alias("ns"), F.sum(F.expr("x * p")).alias("xp"), F.sum(F.expr("x * s")).alias("xs"))
    cum = by.withColumn("cp", F.sum("p").over(run)).withColumn("cs", F.sum("s").over(run)).crossJoin(F.broadcast(total))
    return cum.agg(
        F.first("ns").alias("n_sampled"),
        F.first(F.expr("(xs / ns) / (xp / np)")).alias("mean_ratio"),
        F.max(F.expr("abs(cp / np - cs / ns)")).alias("ks"),
    )
