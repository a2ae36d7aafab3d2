"""Scoring of predictions: folds, floors, metrics, slices, rankings, variance components.

A prediction table is long: case keys, group_id, y_true, prediction.  Missing
is NULL everywhere; only rows where both numbers are there count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import mean, ratio


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def band(c: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Names of the bands (.., e1], (e1, e2], ..; right-closed."""
    out = F.lit(names[-1])
    for e, name in reversed(list(zip(edges, names))):
        out = F.when(c <= e, name).otherwise(out)
    return F.when(c.isNotNull(), out)


def average_rank(score: str | Column, *by: str) -> Column:
    """Rank with ties shared: rank() + (ties - 1) / 2."""
    s = F.col(score) if isinstance(score, str) else score
    return F.rank().over(W.partitionBy(*by).orderBy(s)) + (F.count("*").over(W.partitionBy(*by, s)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation within groups of three rows or more."""
    ok = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ok.withColumn("_rx", average_rank(x, *by)).withColumn("_ry", average_rank(y, *by))
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= 3, correlation("_rx", "_ry")).alias("spearman"), F.count("*").alias("n"))


def metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE, its mean, worst and 90th percentile over groups, RMSE and bias: two levels of aggregation."""
    e = rows.filter("prediction is not null and y_true is not null").withColumn("err", F.expr("prediction - y_true"))
    inner = e.groupBy(*by, "group_id").agg(
        F.count("*").alias("n"), F.sum(F.abs("err")).alias("a"), F.sum(F.expr("err * err")).alias("q"), F.sum("err").alias("s"), F.avg(F.abs("err")).alias("g")
    )
    return inner.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.round(F.sum("a") / F.sum("n"), 9).alias("mae"),
        F.avg("g").alias("macro_mae"),
        F.max("g").alias("worst_group_mae"),
        F.percentile("g", F.lit(0.9)).alias("p90_group_mae"),
        F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"),
        (F.sum("s") / F.sum("n")).alias("bias"),
    )


def metric_slices(rows: DataFrame, keys: Sequence[str], slices: Sequence[str]) -> DataFrame:
    """MAE and bias overall and along each slice column: one pass with GROUPING SETS."""
    e = rows.filter("prediction is not null and y_true is not null").withColumn("err", F.expr("prediction - y_true"))
    view = "_slices"
    e.createOrReplaceTempView(view)
    k = ", ".join(keys)
    sets = ", ".join([f"({k})", *(f"({k}, {s})" for s in slices)])
    name = "case " + " ".join(f"when grouping({s}) = 0 then '{s}'" for s in slices) + " else 'overall' end"
    value = "coalesce(" + ", ".join(f"cast({s} as string)" for s in slices) + ", 'all')"
    return rows.sparkSession.sql(
        f"select {k}, {name} as slice, {value} as slice_value, count(*) as n, avg(abs(err)) as mae, avg(err) as bias from {view} group by {k}, {', '.join(slices)} grouping sets ({sets})"
    )


def rankings(scores: DataFrame, by: Sequence[str], score: str = "macro_mae") -> DataFrame:
    return scores.withColumn("rank", average_rank(score, *by))


def group_folds(rows: DataFrame, by: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """Fold of each group: largest groups first, each to the lightest fold (then the lower number).

    The assignment is sequential; it folds over one array of group sizes for
    each key, which has as many entries as there are groups.
    """
    sizes = rows.groupBy(*by, "group_id").agg(F.count("*").alias("size"))
    ordered = sizes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("m"), "group_id"))).alias("g"))
    lightest = "array_position(acc.load, array_min(acc.load))"
    state = (
        f"aggregate(g, named_struct('load', array_repeat(0L, least({folds}, size(g))), 'out', cast(array() as array<struct<group_id: string, fold: int>>)), "
        f"(acc, x) -> named_struct('load', transform(acc.load, (l, i) -> if(i + 1 = {lightest}, l - x.m, l)), "
        f"'out', concat(acc.out, array(named_struct('group_id', x.group_id, 'fold', int({lightest} - 1))))), acc -> acc.out)"
    )
    return ordered.select(*by, F.explode(F.expr(state)).alias("f")).select(*by, "f.group_id", "f.fold")


def fold_floors(rows: DataFrame, folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and median of y_true outside each fold: what a model without features predicts there."""
    placed = rows.join(folds, [*by, "group_id"])
    each = folds.select(*by, F.col("fold").alias("held")).distinct()
    train = placed.join(each, list(by)) if by else placed.crossJoin(F.broadcast(each))
    return train.filter("fold <> held").groupBy(*by, F.col("held").alias("fold")).agg(mean("y_true").alias("mean_floor"), F.percentile("y_true", F.lit(0.5)).alias("median_floor"))


def logo_floor(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of y_true over all other groups: totals less the group's own."""
    g = rows.groupBy(*by, "group_id").agg(F.sum("y_true").alias("s"), F.count("y_true").alias("c"))
    w = W.partitionBy(*by)
    return g.select(*by, "group_id", ratio(F.sum("s").over(w) - F.col("s"), F.sum("c").over(w) - F.col("c")).alias("floor"))


def select_parameter(rows: DataFrame, folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each fold the parameter of least error outside it, the lower on a tie.  rows: parameter, prediction."""
    placed = rows.join(folds, "group_id").withColumn("err", F.expr("abs(prediction - y_true)"))
    sums = placed.groupBy(*by, "fold", "parameter").agg(F.sum("err").alias("s"), F.count("err").alias("c"))
    w = W.partitionBy(*by, "parameter")
    outside = sums.withColumn("mae", ratio(F.sum("s").over(w) - F.col("s"), F.sum("c").over(w) - F.col("c")))
    return outside.groupBy(*by, "fold").agg(F.min_by("parameter", F.struct(F.round("mae", 9), "parameter")).alias("parameter"), F.min("mae").alias("train_mae"))


def profile_mae(rows: DataFrame, keys: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """Mean absolute error over the profile's entries; null where one is missing."""
    parts = [F.abs(F.col(f"pred_{k}") - F.col(f"true_{k}")) for k in ks]
    return rows.select(*keys, (sum(parts[1:], parts[0]) / len(parts)).alias("pmae"))


def variance_components(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Group > instance > seed components by moments, floored at zero, with SE and detectable difference."""
    seeds = rows.groupBy(*by, "group_id", "instance_id").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("s"))
    inst = seeds.groupBy(*by, "group_id").agg(F.avg("m").alias("m"), F.var_samp("m").alias("v"), F.count("*").alias("i"), F.avg("v").alias("vs"), F.avg("s").alias("s"))
    top = inst.groupBy(*by).agg(
        F.count("*").alias("groups"), F.var_samp("m").alias("vg"), F.avg("v").alias("vi"), F.avg("vs").alias("vs"), F.avg("i").alias("i"), F.avg("s").alias("s"), F.avg("m").alias("macro")
    )
    seed = F.coalesce("vs", F.lit(0.0))
    instance = F.greatest(F.lit(0.0), F.coalesce("vi", F.lit(0.0)) - seed / F.col("s"))
    group = F.greatest(F.lit(0.0), F.coalesce("vg", F.lit(0.0)) - instance / F.col("i") - seed / (F.col("i") * F.col("s")))
    se = F.sqrt(F.coalesce("vg", F.lit(0.0)) / F.col("groups"))
    return top.select(*by, "groups", "macro", seed.alias("seed_var"), instance.alias("instance_var"), group.alias("group_var"), se.alias("se"), (2.8 * se).alias("mdd"))


def distribution(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.percentile(c, F.lit(0.5)).alias("median"), F.max(c).alias("max")
    )


def seed_noise(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Deviation over seeds (population) of each instance, then mean, median and greatest."""
    sd = rows.groupBy(*by, "instance_id").agg(F.stddev_pop(value).alias("sd"))
    return sd.groupBy(*by).agg(F.avg("sd").alias("mean_sd"), F.percentile("sd", F.lit(0.5)).alias("median_sd"), F.max("sd").alias("max_sd"))


def even_pick(rows: DataFrame, order: Sequence[str], m: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows at round(i (n - 1) / (m - 1)), i = 0..m-1, half to even, of each ordered stratum."""
    w = W.partitionBy(*by)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    spots = f"transform(sequence(0, {m - 1}), i -> cast(bround(double(i) * (_n - 1) / {max(1, m - 1)}, 0) as int))"
    return ranked.filter(F.expr(f"array_contains({spots}, _r)")).drop("_r", "_n")


def round_robin(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The first n rows when strata take turns."""
    turn = rows.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(key)))
    return turn.orderBy("turn", stratum, key).limit(n)


def hash_pick(rows: DataFrame, by: Sequence[str], key: str, m: int, seed: int = 0) -> DataFrame:
    """m rows of each block in the order of sha256(seed|key)."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key)), 256)
    return rows.withColumn("pick", F.row_number().over(W.partitionBy(*by).orderBy(order, key))).filter(F.col("pick") <= m)


def nearest_profiles(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Unordered pairs of each row and its nearest other row in standardised columns (few rows: one for each network)."""
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    z = rows.crossJoin(F.broadcast(stats)).select(key, *(F.coalesce(ratio(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in columns))
    other = z.select(F.col(key).alias("other"), *(F.col(c).alias(f"o_{c}") for c in columns))
    dist = F.sqrt(sum(((F.col(c) - F.col(f"o_{c}")) ** 2 for c in columns[1:]), (F.col(columns[0]) - F.col(f"o_{columns[0]}")) ** 2))
    pairs = z.join(other, F.col(key) != F.col("other")).withColumn("distance", F.round(dist, 9))
    near = pairs.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("distance", "other"))).filter("r = 1")
    return near.select(F.least(key, "other").alias("a"), F.greatest(key, "other").alias("b"), "distance").distinct()


def useful_columns(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that vary: one aggregation, one row to the driver."""
    sd = rows.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    return [c for c in columns if sd[c] is not None and sd[c] > 1e-12]


#: feature families by column prefix; estimators and diagnostics are inputs only where asked for
FAMILIES = {"occupancy": ("occ__",), "patterns": ("pat__",), "crawl": ("crawl__",), "combined": ("occ__", "pat__", "crawl__"), "combined+estimators": ("occ__", "pat__", "crawl__", "est__")}


def input_columns(rows: DataFrame, name: str) -> list[str]:
    return [c for c in rows.columns if c.startswith(FAMILIES[name])]


def oof_line(rows: DataFrame, key: str, fold: str, x: str, y: str) -> DataFrame:
    """(key, fold, y_true, prediction): least squares of y on x over the other folds, from sums of each fold.

    One aggregate over the rows; what is joined back has one row for each fold.  Null where the others do not vary."""
    ok = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(y)}
    by = ok.groupBy(fold).agg(*(F.sum(e).alias(c) for c, e in sums.items()))
    whole = by.agg(*(F.sum(c).alias(f"t{c}") for c in sums))
    rest = by.crossJoin(F.broadcast(whole)).select(fold, *((F.col(f"t{c}") - F.col(c)).alias(c) for c in sums))
    slope = F.expr("try_divide(n * sxy - sx * sy, nullif(round(n * sxx - sx * sx, 12), 0D))")
    lines = rest.withColumn("slope", slope).select(fold, "slope", F.expr("try_divide(sy - slope * sx, n)").alias("start"))
    return ok.join(F.broadcast(lines), fold).select(key, fold, F.col(y).alias("y_true"), (F.col("start") + F.col("slope") * F.col(x)).alias("prediction"))


def fit_quality(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, R2, mean absolute error, variance of what is left and of the target."""
    e = F.col("y_true") - F.col("prediction")
    ok = predictions.filter("prediction is not null and y_true is not null")
    return ok.groupBy(*by).agg(
        F.count("*").alias("n"), (1 - ratio(F.avg(e * e), F.var_pop("y_true"))).alias("r2_oof"), F.avg(F.abs(e)).alias("mae_oof"),
        F.var_pop(e).alias("residual_variance"), F.var_pop("y_true").alias("target_variance"),
    )
