"""Write disciplines: once, only additions, last file wins. A write is one job whose committer makes it whole or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str) -> None:
    """Refuses a path that exists."""
    df.write.mode("errorifexists").parquet(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Adds the rows whose key the table at path hasn't; what is there is never overwritten."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).select(*key)
    except Exception as error:  # noqa: BLE001  only a missing table is nothing
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df.dropDuplicates(key).write.parquet(path)
        return
    df.dropDuplicates(key).join(known, key, "left_anti").write.mode("append").parquet(path)


def conflicts(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Keys that both have with different rows: what a write-once table refuses."""
    mark = lambda d: d.select(*key, F.sha2(F.to_json(F.struct(*sorted(d.columns))), 256).alias("h"))
    return mark(new).join(mark(old).withColumnRenamed("h", "_o"), key).where("h <> _o").select(*key)


def last_wins(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key by file, then line."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc(o) for o in order]))).where("_n = 1").drop("_n")


def export_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a total order, in as many files as the ranges need."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").json(path)


def document(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def rocks(spark: SparkSession) -> None:
    """State of streams in RocksDB, which keyed state with timers needs; a session that names a store of its own keeps it."""
    key, plain = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state."
    if spark.conf.get(key).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, f"{plain}RocksDBStateStoreProvider")
