"""Registries of edge lists, merged shards, table files, bundles.

Files are reached through Spark's file systems only.  Tables are written by the executors; what passes through the
driver (a registry, a rendered table, a bundle) is small by definition and checked to be.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from persistra.sources.streams import parse_edges, read_cases

#: rows of a rendered table, bytes of a bundle or a registry
MOST_ROWS, MOST_BYTES = 10_000, 256 << 20


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def size_of(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file, None where there is none."""
    fs, where = _fs(spark, path)
    return fs.getFileStatus(where).getLen() if fs.exists(where) else None


def read_bytes(spark: SparkSession, path: str) -> bytes:
    size = size_of(spark, path)
    if size is None:
        raise FileNotFoundError(path)
    if size > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes, {MOST_BYTES} at most")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_registry(spark: SparkSession, path: str) -> dict[str, dict]:
    """name -> entry of a YAML registry of edge lists; an entry names its file and the columns of u, v and t."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("registries need the yaml package") from e
    entries = yaml.safe_load(read_bytes(spark, path).decode())["datasets"]
    for name, entry in entries.items():
        if "file" not in entry or not {"u", "v", "t"} <= set(entry.get("format", {}).get("columns", {})):
            raise ValueError(f"registry entry {name} lacks its file or a column of u, v, t")
    return entries


def skip_head(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """Text lines of ``path`` without the first ``rows`` lines of every file.

    Lines of a split have ascending ids; a file's first split tells where its ids begin, one row for each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    if rows <= 0:
        return lines.select("value")
    head = lines.filter("at = 0").groupBy("file").agg(F.min("id").alias("first"))
    return lines.join(head, "file", "left").filter(f"at > 0 or id >= first + {int(rows)}").select("value")


def read_registered(spark: SparkSession, entries: dict[str, dict], name: str, folder: str) -> DataFrame:
    """(u, v, t) of a registry's edge list, by the format that its entry states."""
    entry = entries[name]
    how = entry["format"]
    delimiter = how.get("delimiter", "whitespace")
    return parse_edges(
        skip_head(spark, f"{folder.rstrip('/')}/{entry['file']}", how.get("skiprows", 0)),
        how["columns"],
        None if delimiter == "whitespace" else delimiter,
        tuple(how.get("comment", "#%")),
        how.get("bipartite", False),
    )


def presence(spark: SparkSession, entries: dict[str, dict], names: Sequence[str], folder: str, least: int = 0) -> list[tuple[str, int | None]]:
    """(name, bytes or None) of the files that a plan needs; an error where fewer than ``least`` are there."""
    found = [(n, size_of(spark, f"{folder.rstrip('/')}/{entries[n]['file']}")) for n in names]
    there = sum(b is not None for _, b in found)
    if there < least:
        raise FileNotFoundError(f"{there} of {len(found)} files are there, {least} needed; missing: {[n for n, b in found if b is None]}")
    return found


def merge_shards(spark: SparkSession, paths: Sequence[str], out: str, key: str = "case_id") -> DataFrame:
    """Case shards as one table ordered by key over its files; a key that occurs twice is an error."""
    read_cases(spark, *paths, key=key).orderBy(key).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_delimited(rows: DataFrame, path: str, delimiter: str = ",", gzip: bool = False) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", delimiter).option("compression", "gzip" if gzip else "none").csv(path)


def markdown(rows: DataFrame, places: int = 4) -> str:
    """A report as a pipe table, null as an empty cell; more than ``MOST_ROWS`` rows are an error."""
    got = rows.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"a rendered table has {MOST_ROWS} rows at most")

    def cell(x) -> str:
        text = "" if x is None else f"{x:.{places}f}" if isinstance(x, float) else str(x)
        return text.replace("|", "\\|").replace("\n", " ")

    lines = [rows.columns, ["---"] * len(rows.columns), *([cell(x) for x in r] for r in got)]
    return "".join("| " + " | ".join(line) + " |\n" for line in lines)


def bundle(spark: SparkSession, out: str, folder: str, required: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """A zip of result files; a required one that is missing is an error, optional ones are taken if there."""
    sizes = {n: size_of(spark, f"{folder.rstrip('/')}/{n}") for n in [*required, *optional]}
    missing = [n for n in required if sizes[n] is None]
    if missing:
        raise FileNotFoundError(f"required files are missing: {missing}")
    names = [n for n, b in sizes.items() if b is not None]
    if sum(sizes[n] for n in names) > MOST_BYTES:
        raise ValueError(f"a bundle holds {MOST_BYTES} bytes at most")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(n, read_bytes(spark, f"{folder.rstrip('/')}/{n}"))
    write_bytes(spark, out, data.getvalue())
    return names
