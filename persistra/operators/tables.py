"""Panels as tables: set operations, pivots, bins, joins with checks, and the summaries read off them.

Values that become columns are given by the caller, so a pivot is one grouped
aggregate and never a pass to find them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from persistra.functions.exprs import ratio

# sets ------------------------------------------------------------------------


def keep_last(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of all frames with one row for each key: of the last frame that has it, the last by ``order``."""
    columns = frames[0].columns
    rows = reduce(DataFrame.unionByName, [f.select(*columns, F.lit(i).alias("_from")) for i, f in enumerate(frames)])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("_from", *order)).alias("_row")).select("_row.*")


def common(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Keys that occur with every value of ``by``."""
    pairs = rows.select(key, by).filter(F.col(by).isNotNull()).distinct()
    total = pairs.agg(F.count_distinct(by).alias("_all"))
    return pairs.groupBy(key).agg(F.count("*").alias("_n")).join(F.broadcast(total), F.col("_n") == F.col("_all")).select(key)


def missing(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys ``done`` lacks."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def shard(rows: DataFrame, key: str, shards: int, which: int) -> DataFrame:
    """One of ``shards`` disjoint parts that together hold all rows with a key."""
    return rows.filter(F.pmod(F.col(key), F.lit(shards)) == which)


# pivots ----------------------------------------------------------------------


def _each(column: str, names: Sequence, value: Column, how, prefix: str = "") -> list[Column]:
    return [how(F.when(F.col(column) == F.lit(n), value)).alias(f"{prefix}{n}") for n in names]


def wide(rows: DataFrame, keys: Sequence[str], column: str, names: Sequence[str], value: str) -> DataFrame:
    """Long to wide; rows that lack any of the named values are left out."""
    return rows.groupBy(*keys).agg(*_each(column, names, F.col(value), F.max)).dropna(subset=list(names))


def mean_pivot(rows: DataFrame, keys: Sequence[str], column: str, names: Sequence, value: str, total: str | None = None, prefix: str = "") -> DataFrame:
    """Means of ``value`` for every value of ``column``; with ``total`` also over all of them."""
    every = [F.avg(value).alias(total)] if total else []
    return rows.groupBy(*keys).agg(*_each(column, names, F.col(value), F.avg, prefix), *every)


def cross_tab(rows: DataFrame, keys: Sequence[str], column: str, names: Sequence) -> DataFrame:
    """Counts, zero where there is none."""
    return rows.groupBy(*keys).agg(*_each(column, names, F.lit(1), F.count))


def quantile_bins(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds ``bin``: 0-based quantile bin, closed on the right; equal edges count once.

    Edges are one row of ``bins + 1`` numbers."""
    edges = rows.agg(F.array_distinct(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(bins + 1))))).alias("_edges"))
    below = F.expr(f"size(filter(_edges, e -> e < {value}))")
    return rows.join(F.broadcast(edges)).withColumn("bin", F.when(F.col(value).isNotNull(), F.greatest(F.lit(0), below - 1))).drop("_edges")


def nearest_to_quantile(rows: DataFrame, by: Sequence[str], value: str, q: float, key: str) -> DataFrame:
    """Of each group the row nearest to the group's quantile, the smaller key on a tie."""
    target = rows.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("target"))
    far = F.round(F.abs(F.col(value) - F.col("target")), 9)
    return rows.join(target, list(by)).groupBy(*by).agg(F.min_by(F.struct(key, value, "target"), F.struct(far, key)).alias("r")).select(*by, f"r.{key}", f"r.{value}", "r.target")


# joins with checks -----------------------------------------------------------


def with_metadata(cases: DataFrame, panel: DataFrame, key: str) -> DataFrame:
    """Cases with their panel's columns, null where the panel has none."""
    return cases.join(panel, key, "left")


def with_baselines(cases: DataFrame, predictions: DataFrame, key: str, models: Sequence[str], limit: float = 0.01) -> DataFrame:
    """Cases with one column of predictions for each model; an error where more than ``limit`` of a model's are missing."""
    columns = predictions.groupBy(key).agg(*_each("model", models, F.col("prediction"), F.max))
    out = cases.join(columns, key, "left")
    lost = out.agg(*(F.avg(F.col(m).isNull().cast("double")).alias(m) for m in models)).first()
    if bad := {m: lost[m] for m in models if lost[m] is not None and lost[m] > limit}:
        raise ValueError(f"predictions missing for too many cases: {bad}")
    return out


# summaries -------------------------------------------------------------------


def panel_metrics(rows: DataFrame, by: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """Share of valid answers, profile error (all, mean over groups, worst group), error and bias of rho_2."""
    error = sum((F.abs(F.col(f"pred_{k}") - F.col(f"true_{k}")) for k in ks[1:]), F.abs(F.col(f"pred_{ks[0]}") - F.col(f"true_{ks[0]}"))) / len(ks)
    one = F.col("pred_2") - F.col("true_2")
    groups = rows.withColumn("_e", error).groupBy(*by, "group_id").agg(
        F.count("*").alias("n"), F.count("_e").alias("ok"), F.sum("_e").alias("e"), F.avg("_e").alias("g"),
        F.sum(F.when(F.col("_e").isNotNull(), F.abs(one))).alias("a"), F.sum(F.when(F.col("_e").isNotNull(), one)).alias("s"),
    )
    return groups.groupBy(*by).agg(
        F.sum("n").alias("n"), ratio(F.sum("ok"), F.sum("n")).alias("valid_share"), ratio(F.sum("e"), F.sum("ok")).alias("pmae"), F.avg("g").alias("macro_pmae"),
        F.max("g").alias("worst_pmae"), ratio(F.sum("a"), F.sum("ok")).alias("rho2_mae"), ratio(F.sum("s"), F.sum("ok")).alias("rho2_bias"),
    )


def captured(rows: DataFrame, by: Sequence[str], truth: str, floor: str, best: str, models: Sequence[str]) -> DataFrame:
    """MAE of a floor, a best reference and each model, and the share of the gap between the two that a model closes."""
    mae = {c: F.avg(F.abs(F.col(c) - F.col(truth))) for c in (floor, best, *models)}
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *(e.alias(f"mae_{c}") for c, e in mae.items()))
    gap = F.col(f"mae_{floor}") - F.col(f"mae_{best}")
    return out.select("*", *(F.when(gap > 0, (F.col(f"mae_{floor}") - F.col(f"mae_{m}")) / gap).alias(f"captured_{m}") for m in models))


def floor_effects(rows: DataFrame, value: str, by: Sequence[str], low: float = 0.05) -> DataFrame:
    """Shares of values under ``low`` and of zeros, and the median."""
    c = F.col(value)
    return rows.filter(c.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((c < low).cast("double")).alias("share_low"), F.avg((c == 0).cast("double")).alias("share_zero"), F.percentile(c, F.lit(0.5)).alias("median")
    )


def spread_summary(rows: DataFrame, value: str, by: Sequence[str], full: float = 1.0) -> DataFrame:
    """Count, median, tenth and ninetieth percentile, and the share at or over ``full``."""
    c = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(c).alias("n"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.1)).alias("q10"), F.percentile(c, F.lit(0.9)).alias("q90"),
        F.avg((c >= full).cast("double")).alias("saturated"),
    )


def binned_histogram(seen: DataFrame, by: Sequence[str] = (), windows: int = 5) -> DataFrame:
    """Dyads by bins of n (1 to 5, 6 to 10, more) and windows w, as 7 x ``windows`` columns, and their number."""
    b = F.when(F.col("n") <= 5, F.col("n")).when(F.col("n") <= 10, 6).otherwise(7)
    cells = [F.count(F.when((b == i) & (F.col("w") == w), 1)).alias(f"n{i}_w{w}") for i in range(1, 8) for w in range(1, windows + 1)]
    return seen.groupBy(*by).agg(*cells, F.count("*").alias("n_seen"))


def window_activity(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """events: u, v, w -> events and active dyads of each window."""
    dyads = events.groupBy(*by, "w", "u", "v").agg(F.count("*").alias("c"))
    return dyads.groupBy(*by, "w").agg(F.sum("c").alias("events"), F.count("*").alias("active"))


def expected_cases(strategies: int, budgets: int, seeds: int, instances: int, sentinel: float) -> int:
    """Cases of a design in which a share of instances gets further seeds."""
    first = strategies * budgets * instances
    return int(first + round(instances * sentinel) * strategies * budgets * (seeds - 1))


# answers ---------------------------------------------------------------------


def coerced(values: Sequence[str]) -> list[Column]:
    """Numbers clipped to [0, 1], and whether a later one exceeds an earlier one."""
    clipped = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double"))) for c in values]
    rises = reduce(lambda a, b: a | b, [F.coalesce(b > a, F.lit(False)) for a, b in zip(clipped, clipped[1:])])
    return [*(x.alias(c) for x, c in zip(clipped, values)), rises.alias("not_monotone")]


def losses(rows: DataFrame, answer: str, truth: str) -> DataFrame:
    """Adds ``loss``: the absolute error of a valid answer in [0, 1], one for any other."""
    ok = F.col(answer).isNotNull() & F.col(answer).between(0, 1)
    return rows.withColumn("loss", F.when(ok, F.abs(F.col(answer) - F.col(truth))).otherwise(F.lit(1.0)))


def cell_metrics(rows: DataFrame, cell: str, case: str, rep: str) -> DataFrame:
    """Mean loss of a cell over cases of their means over repetitions, and the mean spread between repetitions."""
    reps = rows.groupBy(cell, case, rep).agg(F.avg("loss").alias("x"))
    cases = reps.groupBy(cell, case).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count("*").alias("r"))
    return cases.groupBy(cell).agg(F.count("*").alias("n_cases"), F.avg("m").alias("mean_loss"), F.avg(F.when(F.col("r") > 1, F.col("sd"))).alias("stability_sd"))


def todo(prompts: DataFrame, records: DataFrame, key: str, cap: int, length: str) -> DataFrame:
    """Prompts not longer than ``cap`` without a complete record, and how often they were tried; fewest attempts come first."""
    tried = records.groupBy(key).agg(F.count("*").alias("attempts"), F.max("complete").alias("done"))
    open_ = prompts.filter(F.col(length) <= cap).join(tried, key, "left").filter(~F.coalesce("done", F.lit(False)))
    return open_.select(key, F.coalesce("attempts", F.lit(0)).alias("attempts")).orderBy("attempts", key)
