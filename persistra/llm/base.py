"""What the operators of this subpackage share: words, hashes, scratch tables.

Nothing here is specific to one operator.  Scratch tables go to the folder the
cluster names in ``spark.checkpoint.dir``; a folder of our own is made only
where that setting is absent and driver and executors are one process (tests).
"""

from __future__ import annotations

import gc
import itertools
import math
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of an Arrow batch between the engine and a Python worker
BATCH_BYTES = 4 << 20


def lean(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of the session are of ``BATCH_BYTES`` at most from here on.

    Kernels hold a batch as Python objects, so this bounds a worker's memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="persistra-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Intermediate tables of one call, written as Parquet in the shared folder.

    A written table cuts lineage: a lost executor costs a re-read, not a
    recomputation of everything before it.  A result may still read them, so
    they stay until the caller says ``clear`` (the pipeline does, after every
    stage) or removes the folder.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{what}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    @classmethod
    def clear(cls, *but: Scratch) -> None:
        """Removes the tables of all calls so far but those named."""
        for scratch in [x for x in cls.made if x not in but]:
            cls.made.remove(scratch)
            if scratch.spark.sparkContext._jsc is not None:  # its session has not ended
                scratch.drop("")
                scratch.forget_shuffles()

    def forget_shuffles(self) -> None:
        """The engine deletes the shuffle files of plans that nothing refers to any more when the driver collects garbage.

        Its listeners hold the last query's plan until another query ends, so an empty one is run before."""
        self.spark.sql("select 1").collect()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)


def block_count(df: DataFrame, target_mb: int = 8) -> int:
    """Blocks of about ``target_mb`` of stored input, two per shuffle partition at least."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    per_split = math.ceil(conf.filesMaxPartitionBytes() / (target_mb << 20))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * shuffle, df.rdd.getNumPartitions() * per_split)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to ``limit`` words at a time; one for each task."""

    def __init__(self, limit: int = 1 << 17):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def portions(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges (end exclusive) of about ``most`` bytes, one row at least."""
    if not len(sizes):
        return []
    part = (np.cumsum(sizes) - sizes) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return list(zip(cut, cut[1:]))


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D, as they stand."""
    return text.split() if text else []


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) long edges -> (node, label): label is the least node of its component.

    Alternates large-star and small-star until the edges stay as they are.  A node's neighbours are never
    gathered: each half is a grouped minimum (combined before the shuffle) and
    an equi-join whose hot keys the engine may split.  Nothing but one row of
    sums per round reaches the driver.
    """
    from pyspark.sql import functions as F

    e = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc_0"
    )
    state = None
    for i in itertools.count(1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .selectExpr("stack(2, v, m, u, m) as (u, v)")
            .filter("u <> v")
            .selectExpr("greatest(u, v) as u", "least(u, v) as v")
            .distinct()
        )
        e = scratch.keep(small, f"cc_{i}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"cc_{i - 1}")
        if now == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
