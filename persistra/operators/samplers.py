"""Access models: what a budget of events shows of a network.

Randomness is a hash order: an event's priority is the md5 of the seed and the
event's own key, so a sample of a smaller budget is a prefix of a larger one,
retries give the same rows, and SQL can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from persistra.functions.exprs import u01
from persistra.operators.census import canonical


def keyed(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Canonical events with eid: endpoints and the event's number within its dyad."""
    k = F.row_number().over(W.partitionBy(*by, "u", "v").orderBy("t"))
    return canonical(events).withColumn("eid", F.concat_ws("|", "u", "v", k.cast("string")))


def hash_order(seed: int, key: str = "eid"):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))


def reservoir(events: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """Uniform sample of ``budget`` events: pos (from 1), u, v, t, eid.  Top-k, no global sort."""
    top = keyed(events).withColumn("h", hash_order(seed)).orderBy("h", "eid").limit(budget)
    return top.withColumn("pos", F.row_number().over(W.orderBy("h", "eid"))).select("pos", "u", "v", "t", "eid")


def time_prefix(events: DataFrame, budget: int) -> DataFrame:
    """The first events by (t, eid)."""
    top = keyed(events).orderBy("t", "eid").limit(budget)
    return top.withColumn("pos", F.row_number().over(W.orderBy("t", "eid"))).select("pos", "u", "v", "t", "eid")


def ranked(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Canonical events with eid, rank by time from 0 and the number of events of each instance."""
    whole = W.partitionBy(*by)
    return keyed(events, by).withColumn("r", F.row_number().over(whole.orderBy("t", "eid")) - 1).withColumn("size", F.count("*").over(whole))


def positions(rows: DataFrame, by: Sequence[str], most: int, seeds: Sequence[int] = (0, 1)) -> DataFrame:
    """``ranked`` rows -> the first ``most`` events of every (instance, strategy, seed) with pos, so that a budget is ``pos <= B``.

    Strategies: reservoir (hash order), time_prefix (time order, one seed), block (ranks nearest a hashed anchor, lower
    rank first).  Prefixes and blocks are cut by rank before anything is sorted, reservoirs are top-k.
    """
    prefix = rows.filter(F.col("r") < most).withColumn("strategy", F.lit("time_prefix")).withColumn("seed", F.lit(0)).withColumn("pos", F.col("r") + 1)
    many = rows.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    seeded = W.partitionBy(*by, "seed")
    sampled = many.withColumn("strategy", F.lit("reservoir")).withColumn(
        "pos", F.row_number().over(seeded.orderBy(F.md5(F.concat_ws("|", F.col("seed").cast("string"), "eid")), "eid"))
    )
    anchor = F.floor(u01("anchor", F.col("seed"), *(F.col(b) for b in by)) * F.col("size"))
    # the nearest ranks lie within this distance, also where the anchor is near an end
    block = many.withColumn("strategy", F.lit("block")).withColumn("far", F.abs(F.col("r") - anchor)).filter(F.col("far") <= most)
    block = block.withColumn("pos", F.row_number().over(seeded.orderBy("far", "r"))).drop("far")
    return prefix.unionByName(sampled.filter(F.col("pos") <= most)).unionByName(block.filter(F.col("pos") <= most)).drop("r", "size")


def node_panel_size(nodes: DataFrame) -> DataFrame:
    """(nodes, events, budget) rows -> size: panel size whose expected induced events are nearest the budget."""
    # the root of x (x - 1) = budget * nodes (nodes - 1) / events; the best whole number is beside it
    root = "0.5 + sqrt(0.25 + double(budget) * double(nodes) * (nodes - 1) / events)"
    near = f"transform(sequence(-2, 2), i -> least(nodes, greatest(2L, bigint(floor(least({root}, double(nodes)))) + i)))"
    size = F.expr(f"array_min(transform({near}, x -> struct(round(abs(double(events) * x * (x - 1) / (double(nodes) * (nodes - 1)) - budget), 9) as miss, x as size))).size")
    return nodes.withColumn("size", size)


def node_panel(events: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Events between ``size`` nodes drawn by hash: two semi-joins with the panel."""
    e = canonical(events)
    nodes = e.select(F.col("u").alias("x")).union(e.select(F.col("v").alias("x"))).distinct()
    panel = nodes.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), "x"))).orderBy("h", "x").limit(size).select("x")
    return e.join(panel.withColumnRenamed("x", "u"), "u", "left_semi").join(panel.withColumnRenamed("x", "v"), "v", "left_semi").select("u", "v", "t")


def sentinel(rows: DataFrame, key: str, fraction: float, tag: str = "sentinel", seed: int = 0) -> DataFrame:
    return rows.filter(u01(str(seed), tag, F.col(key)) < fraction)


def crc_sentinel(rows: DataFrame, key: str, fraction: float, tag: str = "sentinel", seed: int = 0) -> DataFrame:
    """As ``sentinel``, with the crc32 of the joined parts."""
    return rows.filter(F.crc32(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col(key)).cast("binary")) / 4294967296.0 < fraction)


def block_window(sample: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Where a contiguous sample lies in time."""
    return sample.groupBy(*by).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")).withColumn("width", F.expr("end - start"))
