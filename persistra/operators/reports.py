"""Reports over case tables and answers: joined frames, comparisons with baselines, noise, designs, checks.

Every report is one or two levels of grouped aggregates over keys; designs are
expansions of a small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from persistra.functions.exprs import ratio
from persistra.operators.evaluate import spearman

ALL = "ALL"


def _mae(value: str, truth: str) -> Column:
    return F.avg(F.abs(F.col(value) - F.col(truth)))


def _with_total(rows: DataFrame, by: str) -> DataFrame:
    """Every row twice: under its own value of ``by`` and under ``ALL``; aggregates combine before the shuffle."""
    return rows.withColumn(by, F.explode(F.array(F.col(by), F.lit(ALL))))


# projections and predicates -----------------------------------------------------


def columns_by(rows: DataFrame, prefixes: Sequence[str] = (), exclude: Sequence[str] = (), numeric: bool = True) -> list[str]:
    """Columns with one of the prefixes (any, if none is given) that are not excluded; numeric ones only, if asked."""
    named = [f for f in rows.schema if f.name not in exclude and (not prefixes or f.name.startswith(tuple(prefixes)))]
    return [f.name for f in named if not numeric or isinstance(f.dataType, NumericType)]


def mapped(rows: DataFrame, column: str, groups: Mapping[str, str], into: str) -> DataFrame:
    """Adds ``into``, the group of ``column``; rows without a group go."""
    pairs = [F.lit(x) for pair in groups.items() for x in pair]
    return rows.withColumn(into, F.create_map(*pairs)[F.col(column)]).filter(F.col(into).isNotNull())


def usable(complete: Column, arm: Column, tool_events: Column, closed_arm: str) -> Column:
    """A record counts if it is complete and, in the arm without tools, called none."""
    return F.coalesce(complete & ~((arm == closed_arm) & (tool_events > 0)), F.lit(False))


def stable_seed(*parts: Column) -> Column:
    """crc32 of the parts joined by '|'."""
    return F.crc32(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))


def integrity(rows: DataFrame, key: str, unit: Sequence[str], inner: str, outer: str) -> DataFrame:
    """One row: rows, repeated keys, values outside [0, 1], nulls among them, and inner keys that lie in several outer ones."""
    bad = [F.sum((~F.col(c).between(0, 1)).cast("long")) for c in unit]
    none = [F.sum(F.col(c).isNull().cast("long")) for c in unit]
    add = lambda cs: F.coalesce(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs]), F.lit(0))
    counts = rows.agg(F.count("*").alias("n"), add(bad).alias("out_of_range"), add(none).alias("nulls"))
    again = rows.groupBy(key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"))
    pairs = rows.groupBy(inner).agg(F.min(outer).alias("a"), F.max(outer).alias("b")).agg(F.count_if(F.expr("a <> b")).alias("split"))
    return counts.crossJoin(F.broadcast(again)).crossJoin(F.broadcast(pairs))  # one row each


def checked(report: DataFrame) -> None:
    """Raises where a report of ``integrity`` has anything but rows."""
    row = report.first().asDict()
    if bad := {k: v for k, v in row.items() if k != "n" and v}:
        raise ValueError(f"case table: {bad}")


# joins ------------------------------------------------------------------------


def answer_frame(records: DataFrame, prompts: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Answers with their prompt's and truth's columns; answers without a truth go."""
    values = [c for c in truth.columns if c != key]
    return records.join(prompts, key, "left").join(truth, key, "left").dropna(subset=values)


def intersected(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Cases that are whole in both tables."""
    return predictions.dropna().join(truth.dropna(), key)


def rescored(cases: DataFrame, answered: DataFrame, key: str, truth: str, columns: Sequence[str]) -> DataFrame:
    """Baselines, one column each, scored on the answered cases alone."""
    kept = cases.join(answered.select(key), key, "left_semi")
    long = kept.select(F.col(truth).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("method"), F.col(c).alias("p")) for c in columns))).alias("m"))
    return long.select("y", "m.*").groupBy("method").agg(F.count("p").alias("n"), _mae("p", "y").alias("mae"), F.avg(F.expr("p - y")).alias("bias"))


# comparisons --------------------------------------------------------------------


def against_baseline(rows: DataFrame, by: Sequence[str], strategy: str, model: str, baseline: str, truth: str) -> DataFrame:
    """Errors of a model and a baseline on the same cases, their difference and the share the model wins; with ``ALL``."""
    both = rows.filter(F.col(model).isNotNull() & F.col(baseline).isNotNull() & F.col(truth).isNotNull())
    wins = F.abs(F.col(model) - F.col(truth)) < F.abs(F.col(baseline) - F.col(truth))
    return _with_total(both, strategy).groupBy(*by, strategy).agg(
        F.count("*").alias("n"), _mae(model, truth).alias("model_mae"), _mae(baseline, truth).alias("baseline_mae"),
        (_mae(model, truth) - _mae(baseline, truth)).alias("delta"), F.avg(wins.cast("double")).alias("win_share"),
    )


def anchored(rows: DataFrame, strategy: str, model: str, plugin: str, truth: str, anchor: float, within: float) -> DataFrame:
    """MAE, share of answers within ``within`` of the anchor, and mean distance to the plug-in; with ``ALL``."""
    return _with_total(rows.filter(F.col(model).isNotNull()), strategy).groupBy(strategy).agg(
        F.count("*").alias("n"), _mae(model, truth).alias("mae"),
        F.avg((F.abs(F.col(model) - anchor) <= within).cast("double")).alias("anchor_share"), _mae(model, plugin).alias("plugin_gap"),
    )


def dissociation(rows: DataFrame, by: Sequence[str], prediction: str, truth: str, least: int = 10) -> DataFrame:
    """Rank correlation beside the error, for groups of ``least`` rows or more."""
    ok = rows.filter(F.col(prediction).isNotNull() & F.col(truth).isNotNull())
    errors = ok.groupBy(*by).agg(_mae(prediction, truth).alias("mae"))
    return spearman(ok, prediction, truth, by).join(errors, list(by)).filter(F.col("n") >= least)


def redundancy(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Linear and rank correlation of two targets."""
    ok = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(*by).agg(F.corr(x, y).alias("pearson")).join(spearman(ok, x, y, by), list(by))


def noise_components(rows: DataFrame, value: str) -> DataFrame:
    """One row: variance within instances of two rows or more, between instances of a group, and between groups."""
    each = rows.filter(F.col(value).isNotNull()).groupBy("group_id", "instance_id")
    each = each.agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n")).filter("n >= 2")
    groups = each.groupBy("group_id").agg(F.avg("m").alias("m"), F.var_samp("m").alias("v"), F.count("*").alias("k"), F.sum("v").alias("sv"), F.sum("n").alias("sn"))
    total = groups.agg(
        (F.sum("sv") / F.sum("k")).alias("within"), (F.sum("sn") / F.sum("k")).alias("n_rep"), F.avg("k").alias("n_inst"),
        F.count("*").alias("n_group"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("_inst"), F.var_samp("m").alias("_group"),
    )
    total = total.withColumn("inst", F.expr("greatest(_inst - within / greatest(n_rep, 1D), 0D)"))
    group = F.expr("greatest(_group - inst / greatest(n_inst, 1D) - within / greatest(n_inst * n_rep, 1D), 0D)")
    return total.select("within", "inst", group.alias("group"), "n_rep", "n_inst", "n_group")


def example_anchor(cases: DataFrame, strategy: str, key: str, truth: str, examples: int) -> DataFrame:
    """Mean truth of the first examples of each strategy in hash order."""
    first = cases.withColumn("_r", F.row_number().over(W.partitionBy(strategy).orderBy(F.md5(F.col(key)), key))).filter(F.col("_r") <= examples)
    return first.groupBy(strategy).agg(F.avg(truth).alias("anchor"), F.count("*").alias("n"))


# samples ------------------------------------------------------------------------


def lifetime_plugin(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean lifetime of dyads seen twice, their share, and the mean over all seen (zero where there is none)."""
    seen = log.groupBy(*by, "u", "v").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("life"))
    out = seen.groupBy(*by).agg(F.avg(F.when(F.col("n") >= 2, F.col("life"))).alias("conditional"), F.avg((F.col("n") >= 2).cast("double")).alias("share"))
    return out.withColumn("zero_inclusive", F.coalesce("conditional", F.when(F.col("share") == 0, 0.0)) * F.col("share"))


def sample_gaps(log: DataFrame) -> DataFrame:
    """Gaps between the successive recorded times of each dyad seen twice or more."""
    gap = F.col("t") - F.lag("t").over(W.partitionBy("u", "v").orderBy("t"))
    return log.withColumn("gap", gap).filter("gap is not null").groupBy("u", "v").agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))


def table_plugin(text: Column, pattern: str) -> Column:
    """Share of dyads in two windows or more, read back from the count rows of a rendered table."""
    rows = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.trim(r), " +"), lambda x: x.cast("long")))
    total = lambda xs: F.aggregate(F.flatten(xs), F.lit(0).cast("long"), lambda a, x: a + x)
    return ratio(total(F.transform(cells, lambda a: F.slice(a, 2, 4))), total(cells))


# designs ------------------------------------------------------------------------


def expanded(cells: DataFrame, key: str, reps: int, shards: int) -> DataFrame:
    """Cells times repetitions, with ids and strided shards; a plan is a small table."""
    out = cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("plan_id", F.concat_ws("__r", F.col(key).cast("string"), F.col("rep").cast("string")))
    return out.withColumn("shard", (F.row_number().over(W.orderBy("rep", key)) - 1) % shards)


def noise_design(cells: DataFrame, repeats: int, seeds: int) -> DataFrame:
    """Two arms for each cell: the first seed repeated, and redrawn seeds once; the cell they share is in both."""
    arm = lambda name, seed, rep: cells.withColumn("arm", F.lit(name)).withColumn("seed", seed).withColumn("rep", rep)
    upto = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    return arm("response", F.lit(1), upto(repeats)).unionByName(arm("input", upto(seeds), F.lit(1)))


def inventory(records: DataFrame, by: Sequence[str], value: str, complete: str, anchor: float, near: float = 1e-6) -> DataFrame:
    """What a set of answers holds, for each condition: records, distinct prompts, complete and valid shares, the share
    at the anchor value that a prompt shows, the share of answers that some other answer repeats."""
    valid = F.expr(f"{complete} and {value} between 0 and 1")
    marked = records.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    counts = marked.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_distinct("prompt_id").alias("prompts"), F.avg(F.expr(f"double(coalesce({complete}, false))")).alias("complete_share"),
        F.avg(F.expr("double(_ok)")).alias("valid_share"), F.avg(F.expr(f"if(_ok, double(abs({value} - {anchor}D) <= {near}D), null)")).alias("anchor_share"),
    )
    again = marked.filter("_ok").groupBy(*by, value).agg(F.count("*").alias("c")).groupBy(*by)
    repeats = again.agg((F.sum(F.expr("if(c > 1, c, 0)")) / F.sum("c")).alias("repeated_share"))
    return counts.join(repeats, list(by), "left")
