"""Tables cut out of a lineage: written once to the folder that all executors share, then read back.

A lost executor then costs the tasks it was running, never an earlier pass. The folder is the one the
cluster names in ``spark.checkpoint.dir``; only where that is unset (tests on one machine) is a local
temporary folder used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tallystone-"))
    return _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at interpreter exit; the folder is scratch space
        pass


class Scratch:
    """A folder of intermediate tables of one operator call; removed when the interpreter ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.path)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        where = self.folder(name)
        df.write.mode("overwrite").option("compression", "lz4").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)
