"""Intermediate tables that several branches of a plan read.

A written table is computed once and cuts lineage.  It goes to the folder the
cluster names in ``spark.checkpoint.dir``; a folder of our own is made only
where that is unset and driver and executors are one process, and it goes when
the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="persistra-core-")
    atexit.register(shutil.rmtree, where, True)
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table of their own; ``clear`` removes it."""
    path = f"{shared_dir(df.sparkSession)}/table-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables written so far; no result that reads them may be in use."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
