"""Event streams (u, v, t): from the driver tables and from edge-list text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch(ts: str) -> Column:
    """Seconds since 1970 as a double, of a timestamp without zone (UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), "o_custkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v"), epoch("o_orderdate").alias("t")
    )


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v"), epoch("l_shipdate").alias("t")
    )


def user_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("u"), F.concat(F.lit("i"), "event_type").alias("v"), epoch("ts").alias("t")
    )


def nation_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.concat(F.lit("n"), "c_nationkey").alias("u"), F.concat(F.lit("n"), "s_nationkey").alias("v"), epoch("o_orderdate").alias("t"))
    )


STREAMS = {"cust_supp": cust_supp, "part_supp": part_supp, "user_type": user_type, "nation_pair": nation_pair}


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return STREAMS[name](spark, sf_dir)


def all_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream, told apart by instance_id."""
    parts = [f(spark, sf_dir).withColumn("instance_id", F.lit(name)) for name, f in STREAMS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_edges(
    lines: DataFrame,
    columns: dict[str, int],
    delimiter: str | None = None,
    comments: tuple[str, ...] = ("#", "%"),
    bipartite: bool = False,
) -> DataFrame:
    """(value) text lines -> (u, v, t).  Columns are 0-based places of u, v and t.

    Comment and empty lines, short rows and rows whose t is no number are
    dropped; a bipartite list gets ``u:`` and ``i:`` ids.
    """
    text = F.trim(F.col("value"))
    fields = F.split(text, r"\s+" if delimiter is None else rf"\s*\Q{delimiter}\E\s*")
    starts = F.lit(False)
    for c in comments:
        starts = starts | text.startswith(c)
    parsed = lines.filter((text != "") & ~starts).select(fields.alias("f")).filter(F.size("f") > max(columns.values()))
    u, v = F.col("f")[columns["u"]], F.col("f")[columns["v"]]
    if bipartite:
        u, v = F.concat(F.lit("u:"), u), F.concat(F.lit("i:"), v)
    t = F.col("f")[columns["t"]].try_cast("double")
    return parsed.select(u.alias("u"), v.alias("v"), t.alias("t")).filter("t is not null and not isnan(t)")


def read_edges(spark: SparkSession, path: str, columns: dict[str, int], **how) -> DataFrame:
    """An edge list on disk; files that end in .gz are decompressed."""
    return parse_edges(spark.read.text(path), columns, **how)


def robust_parse(lines: DataFrame, columns: dict[str, int], delimiter: str | None, **how) -> DataFrame:
    """As ``parse_edges``; another delimiter where fewer than half of the filled lines parse."""
    filled = lines.filter(F.trim("value") != "").count()
    first = parse_edges(lines, columns, delimiter, **how)
    if 2 * first.count() >= filled:
        return first
    return parse_edges(lines, columns, "," if delimiter is None else None, **how)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad")


def write_events(events: DataFrame, path: str) -> None:
    """Sink of streams: Parquet by instance, sorted by time in each file."""
    events.sortWithinPartitions("instance_id", "t", "u", "v").write.mode("overwrite").partitionBy("instance_id").parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_cases(spark: SparkSession, *paths: str, key: str = "case_id") -> DataFrame:
    """Union of case tables; a key that occurs twice is an error."""
    out = spark.read.option("mergeSchema", "true").parquet(*paths)
    twice = out.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated {key}: {[r[0] for r in twice]}")
    return out
