"""Exports, snapshots and their manifests."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that leave with internal exports only.
INTERNAL = ("raw_json", "quoted_excerpt", "payload_json", "result_json", "payload")


def _root(spark: SparkSession) -> str:
    """The place that the cluster shares; a local one only where none is named and there is no cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tallystone-")


def _removed(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: S110  the JVM may be gone at interpreter exit; the folder is scratch space
        pass


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that the cluster shares."""
    return f"{_root(spark)}/export-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and scan it, so that later steps don't repeat the work before; what was
    written is removed when the interpreter ends."""
    where = shared_folder(df.sparkSession)
    atexit.register(_removed, df.sparkSession, where)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def sanitised(rows: DataFrame) -> DataFrame:
    return rows.drop(*INTERNAL)


def json_lines(rows: DataFrame, *, internal: bool) -> DataFrame:
    """One JSON object per row in the column ``value``."""
    kept = rows if internal else sanitised(rows)
    return kept.select(F.to_json(F.struct(*kept.columns)).alias("value"))


def nested(merchants: DataFrame, evidence: DataFrame) -> DataFrame:
    """One JSON document per entity with its observations in order of id."""
    item = F.struct("evidence_id", "claim_type", "sentiment", "confidence")
    own = evidence.groupBy("merchant_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    joined = merchants.join(own, "merchant_id", "left")
    return joined.select("merchant_id", F.to_json(F.struct(*merchants.columns, "evidence")).alias("doc"))


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def verified(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The manifest, or an error in the row whose count differs from the table's."""
    found = counted(tables).withColumnRenamed("n", "found")
    same = F.coalesce(F.col("n") == F.col("found"), F.lit(False))
    return manifest.join(found, "table_name", "full").select("table_name", F.when(same, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("manifest differs for "), "table_name")).cast("bigint")).alias("n"))


def round_trip(rows: DataFrame, kind: str, by: str | None = None) -> DataFrame:
    """Publish to a new folder (each write is atomic by Spark's committer) and read it back."""
    where = shared_folder(rows.sparkSession)
    writer = rows.write.format(kind)
    (writer.partitionBy(by) if by else writer).save(where)
    return rows.sparkSession.read.format(kind).schema(rows.schema).load(where)


def published(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Write a version of several tables with a manifest of their counts, and open it as a reader does."""
    where = shared_folder(spark)
    for name, df in tables.items():
        df.write.parquet(f"{where}/{name}")
    held = {name: spark.read.parquet(f"{where}/{name}") for name in tables}
    counted(held).coalesce(1).write.parquet(f"{where}/_manifest")
    return verified(spark.read.parquet(f"{where}/_manifest"), held)


def appended(parts: list[DataFrame]) -> DataFrame:
    where = shared_folder(parts[0].sparkSession)
    for part in parts:
        part.write.mode("append").parquet(where)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(where)


def maybe_apply(rows: DataFrame, *, apply: bool) -> DataFrame:
    """The same rows either way; written only if asked for."""
    return (cut(rows) if apply else rows).withColumn("applied", F.lit(apply))
