"""Persistence census: how many windows each dyad is active in.

Everything follows from one grouped aggregate for each dyad: event count,
first and last time, and a bit mask of active windows for every grid asked
for.  Profiles, adjacent-window retention and censoring are bit arithmetic on
the masks, so the census takes one shuffle of the events.  ``by`` names key
columns (for example instance_id) for many networks at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import ratio, window_index, window_mask

GRID = (4, 5, 8)
SWEEP = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20)
HEADLINE, ALPHA = 5, 0.4


def canonical(events: DataFrame) -> DataFrame:
    """Undirected dyads: no self-loops, u < v as text."""
    return events.filter("u <> v").withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def with_horizon(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds t0 and t1, the least and greatest time (of each key); one row for each key is joined."""
    ends = events.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return events.join(ends, list(by)) if by else events.crossJoin(F.broadcast(ends))


def dyads(events: DataFrame, grid: Sequence[int] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """One row for each dyad: n, first, last, t0, t1, m<W> for every W, ms (W=5 moved by half a window)."""
    e = with_horizon(canonical(events), by)
    half = "(t1 - t0) / 10D"
    cols = {f"w{w}": window_index("t", "t0", "t1", w) for w in grid}
    cols["ws"] = window_index("t", "t0", "t1", HEADLINE, half, HEADLINE + 1)
    masks = [window_mask(f"w{w}").alias(f"m{w}") for w in grid] + [window_mask("ws").alias("ms")]
    return (
        e.withColumns(cols)
        .groupBy(*by, "u", "v")
        .agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.first("t0").alias("t0"), F.first("t1").alias("t1"), *masks)
    )


def at_least(mask: str, k: int) -> Column:
    return F.avg(F.expr(f"double(bit_count({mask}) >= {k})"))


def retention(mask: str, windows: int) -> Column:
    """Share of active windows but the last that are followed by an active one."""
    kept = F.sum(F.expr(f"bit_count({mask} & shiftright({mask}, 1))"))
    base = F.sum(F.expr(f"bit_count({mask} & {(1 << (windows - 1)) - 1}L)"))
    return ratio(kept, base)


def event_weighted(mask: str, k: int = 2) -> Column:
    return ratio(F.sum(F.expr(f"if(bit_count({mask}) >= {k}, n, 0L)")), F.sum("n"))


def profile(d: DataFrame, grid: Sequence[int] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """(by, w, k, rho): share of dyads active in at least k of w windows."""
    spans = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.expr(f"bit_count(m{w})").alias("a")) for w in grid))).alias("s")
    counts = d.select(*by, spans).groupBy(*by, "s.w", "s.a").agg(F.count("*").alias("c"))
    total = counts.groupBy(*by, "w").agg(F.sum("c").alias("total"))
    ks = counts.select(*by, "w", "a", "c", F.explode(F.sequence(F.lit(1), F.col("a"))).alias("k")).groupBy(*by, "w", "k").agg(F.sum("c").alias("c"))
    frame = total.select("*", F.explode(F.sequence(F.lit(1), F.col("w"))).alias("k"))
    return frame.join(ks, [*by, "w", "k"], "left").select(*by, "w", "k", (F.coalesce("c", F.lit(0)) / F.col("total")).alias("rho"))


def headline(d: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """rho_1..5, mean occupancy, event-weighted rho and retention on the five-window grid."""
    return d.groupBy(*by).agg(
        F.count("*").alias("n_pairs"),
        F.sum("n").alias("n_events"),
        *(at_least("m5", k).alias(f"rho_{k}") for k in range(1, 6)),
        F.avg(F.expr("bit_count(m5) / 5D")).alias("mean_occupancy"),
        event_weighted("m5").alias("rho_event_weighted"),
        retention("m5", 5).alias("c_one_step"),
    )


def lifetimes(d: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    life = F.col("last") - F.col("first")
    return d.groupBy(*by).agg(
        F.avg(life).alias("lifetime_mean"),
        F.percentile(life, F.lit(0.5)).alias("lifetime_median"),
        ratio(F.avg(life), F.first(F.expr("t1 - t0"))).alias("lifetime_mean_over_t"),
        F.percentile(F.col("n"), F.lit(0.5)).alias("events_per_pair_median"),
        F.avg(F.expr("double(n = 1)")).alias("share_single_event_pairs"),
        F.avg(F.expr("double(n > 1)")).alias("repeat_rate"),
        F.first(F.expr("t1 - t0")).alias("horizon_t"),
    )


def gaps(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, u, v, gap): times between consecutive events of a dyad."""
    w = W.partitionBy(*by, "u", "v").orderBy("t")
    return canonical(events).withColumn("gap", F.col("t") - F.lag("t").over(w)).filter("gap is not null").select(*by, "u", "v", "gap")


def burstiness(mean: Column, sd: Column) -> Column:
    return ratio(sd - mean, sd + mean)


def gap_statistics(g: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median gap and pooled burstiness (population deviation; null under two gaps)."""
    return g.groupBy(*by).agg(
        F.percentile("gap", F.lit(0.5)).alias("median_iet"),
        F.when(F.count("*") >= 2, burstiness(F.avg("gap"), F.stddev_pop("gap"))).alias("burstiness_pooled"),
    )


def pair_burstiness(g: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median over dyads with two gaps or more of each one's burstiness."""
    sums = g.groupBy(*by, "u", "v").agg(F.count("*").alias("c"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("q")).filter("c >= 2")
    mean = F.col("s") / F.col("c")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("c") - mean * mean))
    return sums.select(*by, burstiness(mean, sd).alias("b")).groupBy(*by).agg(F.percentile("b", F.lit(0.5)).alias("burstiness_pair_median"))


def node_count(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct endpoints of the raw stream, those of self-loops included."""
    ends = events.select(*by, F.col("u").alias("x")).union(events.select(*by, F.col("v").alias("x")))
    return ends.distinct().groupBy(*by).agg(F.count("*").alias("n_nodes"))


def equal_event_rho(events: DataFrame, windows: int = 5, k: int = 2) -> DataFrame:
    """rho_k with windows of equally many events: the i-th of n in (t, u, v) order falls in floor(i W / n).

    Ranks come from a range partitioning and the partitions' row counts, so no
    task sorts all events.
    """
    e = canonical(events)
    parts = max(1, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = e.repartitionByRange(parts, "t", "u", "v").withColumn("p", F.spark_partition_id()).persist()
    sizes = ordered.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("c").alias("total"))
    rank = F.row_number().over(W.partitionBy("p").orderBy("t", "u", "v")) - 1 + F.col("before")
    w = F.expr(f"cast(floor(i * {windows} / total) as int)")
    ranked = ordered.join(F.broadcast(before.select("p", "before")), "p").crossJoin(F.broadcast(total)).withColumn("i", rank).withColumn("w", w)
    masks = ranked.groupBy("u", "v").agg(window_mask("w").alias("m"))
    return masks.agg(at_least("m", k).alias("rho_equal_event"), F.avg(F.expr(f"bit_count(m) / {windows}D")).alias("mean_occupancy"))


def censoring_share(d: DataFrame, by: Sequence[str] = (), windows: int = 5) -> DataFrame:
    first = window_index("first", "t0", "t1", windows)
    return d.groupBy(*by).agg(F.avg((first == windows - 1).cast("double")).alias("censoring_share_lastwin"))


def terciles(rows: DataFrame, column: str, key: str) -> DataFrame:
    """hard up to the first third's quantile, easy beyond the second's, medium between."""
    q = rows.agg(F.percentile(column, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    label = F.when(F.col(column) <= F.col("q")[0], "hard").when(F.col(column) > F.col("q")[1], "easy").otherwise("medium")
    return rows.crossJoin(F.broadcast(q)).select(key, column, label.alias("tercile"))


def temporal_chunks(events: DataFrame, chunks: int, least: int) -> DataFrame:
    """Equal-duration panels, each rescaled to [0, 1]; panels with under ``least`` events go."""
    e = with_horizon(canonical(events)).withColumn("chunk", window_index("t", "t0", "t1", chunks)).drop("t0", "t1")
    ends = e.groupBy("chunk").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("c")).filter((F.col("c") >= least) & (F.col("b") > F.col("a")))
    return e.join(F.broadcast(ends), "chunk").select("chunk", "u", "v", ((F.col("t") - F.col("a")) / (F.col("b") - F.col("a"))).alias("t"))


def rescaled(events: DataFrame, horizon: float = 1.0) -> DataFrame:
    """Times moved to [0, horizon]; zeros where all are equal."""
    span = F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0))
    return with_horizon(events).select("u", "v", F.coalesce((F.col("t") - F.col("t0")) / span * horizon, F.lit(0.0)).alias("t"))


def dense_ids(events: DataFrame) -> DataFrame:
    """Endpoints numbered from 0 in order of their text, u < v; times on [0, 1]."""
    e = rescaled(canonical(events))
    ends = e.select(F.col("u").alias("x")).union(e.select(F.col("v").alias("x"))).distinct()
    ids = ends.withColumn("i", F.row_number().over(W.orderBy("x")) - 1)
    return (
        e.join(ids.select(F.col("x").alias("u"), F.col("i").cast("long").alias("ui")), "u")
        .join(ids.select(F.col("x").alias("v"), F.col("i").cast("long").alias("vi")), "v")
        .select(F.least("ui", "vi").alias("u"), F.greatest("ui", "vi").alias("v"), "t")
    )
