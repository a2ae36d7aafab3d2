"""Whole feature blocks of sample logs, long: one row for each feature of each log.

A log has the columns ``by`` (which log), pos (from 1), kind (1 a step, 0 a restart), u, v, t on [0, 1], w (window of
t); walks also have node and dt.  All logs are made into features together: every block is grouped by ``by`` first, and
a log is a budgeted sample, so its exact quantiles stay small.  Features that are not defined are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import ratio
from persistra.operators.features import HIGHEST, LOWEST, edge_observations, window_counts

WINDOWS = 5
QUANTILES = (25, 50, 75, 90)
PARTS = (10, 25, 50, 75, 100)


def _long(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [c for c in wide.columns if c not in by]
    return wide.select(*by, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(list(by), names, "feature", "value")


def _quantiles(x: str, stem: str) -> list[Column]:
    return [F.percentile(x, F.lit(q / 100)).alias(f"{stem}_q{q}") for q in QUANTILES]


def _steps(log: DataFrame) -> DataFrame:
    return log.filter("kind = 1")


def _shares(cells: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, feature, c, total) counts -> the share of every name, also of those that no row has.

    A log's counts become one map, no larger than the fixed list of names."""
    found = cells.groupBy(*by).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("feature", "c"))).alias("found"))
    each = found.select(*by, "total", "found", F.explode(F.array(*map(F.lit, names))).alias("feature"))
    return each.select(*by, "feature", (F.coalesce(F.try_element_at("found", "feature"), F.lit(0)) / F.col("total")).alias("value"))


def capped(n: str, cap: int) -> Column:
    """Label of a count: itself below ``cap``, then the cap and p."""
    return F.when(F.col(n) >= cap, F.lit(f"{cap}p")).otherwise(F.col(n).cast("string"))


def labels(cap: int) -> list[str]:
    return [*map(str, range(1, cap)), f"{cap}p"]


def window_count_block(log: DataFrame, by: Sequence[str], cap: int = 5) -> DataFrame:
    """Shares of dyads by events in each window (up to ``cap``), means, correlations and both-positive shares of windows."""
    ws = range(WINDOWS)
    out = []
    for w in ws:
        out += [F.avg(F.expr(f"double(least(c{w}, {cap}) = {k})")).alias(f"wcnt__w{w}_n{k}{'p' if k == cap else ''}") for k in range(cap + 1)]
        out.append(F.avg(f"c{w}").alias(f"wcnt__w{w}_mean"))
    for a in ws:
        for b in range(a + 1, WINDOWS):
            x, y = f"c{a}", f"c{b}"
            out.append(ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"wcnt__corr_w{a}_w{b}"))
            out.append(F.avg(F.expr(f"double({x} > 0 and {y} > 0)")).alias(f"wcnt__both_positive_w{a}_w{b}"))
    out += [F.log1p(F.count("*")).alias("wcnt__log_observed_dyads"), F.count("*").alias("wcnt__normalization_denom")]
    return _long(window_counts(_steps(log), WINDOWS, by).groupBy(*by).agg(*out), by)


def occupancy_block(log: DataFrame, by: Sequence[str], cap: int = 20) -> DataFrame:
    """Shares of dyads by (n up to ``cap``, active windows), number of dyads, events a dyad, quantiles of n."""
    seen = edge_observations(_steps(log), by)
    name = F.concat(F.lit("occ__n"), capped("n", cap), F.lit("_w"), F.col("w"))
    cells = seen.groupBy(*by, name.alias("feature")).agg(F.count("*").alias("c"))
    cells = cells.withColumn("total", F.sum("c").over(W.partitionBy(*by)))
    names = [f"occ__n{n}_w{w}" for n in labels(cap) for w in range(1, WINDOWS + 1)]
    rest = seen.groupBy(*by).agg(
        F.log1p(F.count("*")).alias("occ__log_unique_edges"), F.avg("n").alias("occ__observations_per_edge"), *_quantiles("n", "occ__n")
    )
    return _shares(cells, by, names).unionByName(_long(rest, by))


def pattern_block(log: DataFrame, by: Sequence[str], cap: int = 10) -> DataFrame:
    """Shares of dyads by window mask, alone and with n; first and last windows; retention; gaps; lifetimes."""
    steps = _steps(log)
    seen = edge_observations(steps, by)
    mask = F.lpad(F.lower(F.hex("mask")), 2, "0")
    two = F.array(F.concat(F.lit("pat__mask_"), mask), F.concat(F.lit("pat__n"), capped("n", cap), F.lit("_mask"), mask))
    cells = seen.select(*by, F.explode(two).alias("feature")).groupBy(*by, "feature").agg(F.count("*").alias("c"))
    cells = cells.withColumn("total", F.sum("c").over(W.partitionBy(*by)) / 2)  # each dyad is in two cells
    masks = [f"{m:02x}" for m in range(1, 1 << WINDOWS)]
    names = [f"pat__mask_{m}" for m in masks] + [f"pat__n{n}_mask{m}" for n in labels(cap) for m in masks]
    shape = seen.groupBy(*by).agg(
        *(F.avg(F.expr(f"double({LOWEST} = {w})")).alias(f"pat__first_w{w}") for w in range(WINDOWS)),
        *(F.avg(F.expr(f"double({HIGHEST} = {w})")).alias(f"pat__last_w{w}") for w in range(WINDOWS)),
        ratio(F.sum(F.expr("bit_count(mask & shiftright(mask, 1))")), F.sum(F.expr(f"bit_count(mask & {(1 << (WINDOWS - 1)) - 1}L)"))).alias("pat__adjacent_observed_C"),
        F.avg(F.expr(f"double({HIGHEST} - {LOWEST} + 1 > w)")).alias("pat__noncontiguous_edge_share"),
        F.avg(F.expr(f"double({HIGHEST} - {LOWEST})")).alias("pat__mean_mask_width"),
    )
    events = steps.groupBy(*by).agg(*(F.avg(F.expr(f"double(w = {w})")).alias(f"pat__event_share_w{w}") for w in range(WINDOWS)))
    gap = steps.withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy(*by, "u", "v").orderBy("t")))
    gaps = gap.groupBy(*by).agg(*_quantiles("gap", "pat__iet"), F.avg("gap").alias("pat__iet_mean"))
    life = steps.groupBy(*by, "u", "v").agg(F.expr("if(count(*) > 1, max(t) - min(t), null)").alias("life"))
    lives = life.groupBy(*by).agg(*_quantiles("life", "pat__lifetime"), F.avg("life").alias("pat__lifetime_mean"))
    out = _shares(cells, by, names)
    for wide in (shape, events, gaps, lives):
        out = out.unionByName(_long(wide, by))
    return out


def _numbered(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Steps with their number i, the log's number of steps, the gap to the dyad's last step and fresh (first sight)."""
    dyad = W.partitionBy(*by, "u", "v").orderBy("i")
    i = _steps(log).withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("pos"))).withColumn("steps", F.count("*").over(W.partitionBy(*by)))
    return i.withColumn("gap", F.col("i") - F.lag("i").over(dyad)).withColumn("fresh", F.row_number().over(dyad) == 1)


def _degrees(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    ends = steps.filter("fresh").select(*by, F.explode(F.array("u", "v")).alias("x"))
    return ends.groupBy(*by, "x").agg(F.count("*").alias("d"))


def _visits(log: DataFrame, by: Sequence[str], node: str | None) -> DataFrame:
    """(by, x, i): nodes in the order they were met: where a walk stood, or both ends of every event."""
    if node:
        return log.select(*by, F.col(node).alias("x"), (F.row_number().over(W.partitionBy(*by).orderBy("pos")) - 1).alias("i"))
    steps = _steps(log).withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("pos")) - 1)
    return steps.select(*by, F.posexplode(F.array("u", "v")).alias("side", "x"), "i").select(*by, "x", (F.col("i") * 2 + F.col("side")).alias("i"))


def crawl_block(log: DataFrame, by: Sequence[str], budget: int, node: str | None = "node") -> DataFrame:
    """Steps, restarts, discovery, returns, hits and degrees of a log; ``node`` is None for logs of events."""
    log = log.filter(F.col("pos") <= budget)
    steps = _numbered(log, by)
    visits = _visits(log, by, node)
    size = log.groupBy(*by).agg(
        F.lit(budget).alias("budget"), F.log1p(F.lit(float(budget))).alias("crawl__log_budget"),
        (F.sum("kind") / budget).alias("crawl__step_fraction"), (F.sum(1 - F.col("kind")) / budget).alias("crawl__restart_fraction"),
    ).drop("budget")
    stops = []
    for q in PARTS:
        stop = f"greatest(1, cast(ceil({q / 100}D * steps) as int))"
        stops.append(F.avg(F.expr(f"if(i <= {stop}, double(fresh), null)")).alias(f"crawl__discovery_{q:03d}"))
    found = steps.groupBy(*by).agg(
        F.log1p(F.sum(F.expr("bigint(fresh)"))).alias("crawl__log_unique_edges"), F.avg(F.expr("double(not fresh)")).alias("crawl__edge_revisit_rate"),
        *stops, *_quantiles("gap", "crawl__return_gap"), *(_quantiles("dt", "crawl__dt") if "dt" in log.columns else []),
        (F.max("t") - F.min("t")).alias("crawl__observed_time_span"),
    )
    edge_hits = steps.groupBy(*by, "u", "v").agg(F.count("*").alias("n")).groupBy(*by).agg(*_quantiles("n", "crawl__edge_hits"))
    met = visits.groupBy(*by, "x").agg(F.count("*").alias("n"))
    node_hits = met.groupBy(*by).agg(F.log1p(F.count("*")).alias("crawl__log_unique_nodes"), *_quantiles("n", "crawl__node_hits"))
    degree = _degrees(steps, by).groupBy(*by).agg(F.avg("d").alias("crawl__observed_degree_mean"), F.max("d").alias("crawl__observed_degree_max"))
    again = visits.withColumn("k", F.row_number().over(W.partitionBy(*by, "x").orderBy("i")))
    clash = again.groupBy(*by).agg(F.coalesce(F.min(F.expr("if(k = 2, i, null)")) / F.count("*"), F.lit(1.0)).alias("crawl__first_node_collision_frac"))
    out = _long(size, by)
    for wide in (found, edge_hits, node_hits, degree, clash):
        out = out.unionByName(_long(wide, by))
    return out


def walk_summary(log: DataFrame, by: Sequence[str], node: str = "node") -> DataFrame:
    """One row for each log: what a pilot keeps of a walk."""
    steps = _numbered(log, by)
    half = "cast(floor(steps / 2) as int)"
    size = log.groupBy(*by).agg(F.sum("kind").alias("n_observed_events"), F.sum(1 - F.col("kind")).alias("n_restarts"), F.count_distinct(node).alias("unique_nodes"))
    found = steps.groupBy(*by).agg(
        F.sum(F.expr("bigint(fresh)")).alias("unique_edges"), F.avg(F.expr("double(not fresh)")).alias("edge_revisit_rate"),
        F.avg(F.expr(f"if(i <= {half}, double(fresh), null)")).alias("discovery_rate_first_half"),
        F.avg(F.expr(f"if(steps > 1 and i > {half}, double(fresh), null)")).alias("discovery_rate_second_half"),
        F.avg("gap").alias("return_time_steps_mean"), (F.count_distinct("w") / WINDOWS).alias("windows_covered_frac"),
        F.avg("dt").alias("step_dt_mean"), F.percentile("dt", F.lit(0.5)).alias("step_dt_median"),
    )
    degree = _degrees(steps, by).groupBy(*by).agg(F.avg("d").alias("observed_deg_mean"), F.max("d").alias("observed_deg_max"))
    seen = edge_observations(_steps(log).filter("t is not null"), by).groupBy(*by).agg(
        F.avg(F.expr("double(w >= 2)")).alias("walk_rho_plugin"), F.avg(F.expr("double(n >= 2)")).alias("share_edges_multi_observed"),
        F.avg(F.expr("if(n >= 2, double(w >= 2), null)")).alias("walk_rho_conditional"), F.avg("w").alias("mean_windows_per_observed_edge"),
        F.avg(F.expr(f"if(w >= 2, double({HIGHEST} - {LOWEST}), null)")).alias("mean_window_gap_revisits"),
    )
    out = size
    for part in (found, degree, seen):
        out = out.join(part, list(by), "left")
    return out


def walk_checkpoints(log: DataFrame, by: Sequence[str], budgets: Sequence[int], node: str = "node") -> DataFrame:
    """Summaries of the prefixes of every log that are no longer than the log itself, all in one pass."""
    size = log.groupBy(*by).agg(F.count("*").alias("size"))
    each = log.join(size, list(by)).select("*", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).filter("pos <= budget and budget <= size")
    return walk_summary(each.drop("size"), [*by, "budget"], node)
