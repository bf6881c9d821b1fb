"""A table that is read, merged and written by buckets of its key, and committed by a manifest.

    <path>/data/<version>/bucket=<b>/*.parquet     rows of one bucket, never changed once written
    <path>/manifest/v=<n>/*.json                   of every bucket the version that holds it

A merge reads only the buckets that its updates touch, stages them under a new version, and commits by one small file, the
next manifest. Until that file is there readers see the old table; a write that ends before leaves only files that nothing
names. Untouched buckets keep their files. There is one writer at a time: a second one that wants the same manifest is refused.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, MANIFEST = 64, "bucket int, version string, v int"


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The number of the newest manifest and the version of each bucket: at most as many entries as there are buckets. 0 and none for a table that isn't there."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    newest = rows.agg(F.max("v")).first()[0] or 0
    return newest, {r["bucket"]: r["version"] for r in rows.where(F.col("v") == newest).collect()}


def bucket_of(key: list[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def folders(path: str, entries: dict[int, str]) -> list[str]:
    return [f"{path.rstrip('/')}/data/{version}/bucket={b}" for b, version in sorted(entries.items())]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as its newest manifest has it; a table that isn't there has no rows."""
    _, entries = manifest(spark, path)
    return spark.read.schema(schema).parquet(*folders(path, entries)) if entries else spark.createDataFrame([], schema)


def commit(spark: SparkSession, path: str, number: int, entries: dict[int, str]) -> None:
    """One file, that appears whole or not at all; refused if the manifest is there."""
    rows = spark.createDataFrame(sorted(entries.items()), "bucket int, version string")
    rows.coalesce(1).write.mode("errorifexists").json(f"{path.rstrip('/')}/manifest/v={number}")


def merge(path: str, updates: DataFrame, key: list[str], by: list[str], wins: str = "new", buckets: int = BUCKETS) -> dict[int, str]:
    """Merges updates into the table by key, and gives the buckets' versions. by: the part of the key that rows are put into buckets by, a round say.

    wins: `new` (an update replaces the row of its key), or `old` (what is there is never replaced: a merge only adds).
    Several updates of one key are refused. Rows that no update names stay. Of a table, buckets are always the same number.
    """
    if wins not in ("new", "old"):
        raise ValueError(f"wins: new or old, not {wins!r}")
    spark = updates.sparkSession
    number, entries = manifest(spark, path)
    columns = updates.columns
    new = updates.withColumn("bucket", bucket_of(by, buckets))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets`
    if not touched:
        return entries
    held = {b: entries[b] for b in touched if b in entries}
    once = new.groupBy(*key, "bucket").agg(F.count("*").alias("_n"), F.any_value(F.struct(*columns)).alias("_new"))
    once = once.withColumn("_new", F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.raise_error(F.lit("several updates of one key")).cast(once.schema["_new"].dataType)))
    if held:
        old = spark.read.schema(updates.schema).parquet(*folders(path, held)).withColumn("bucket", bucket_of(by, buckets))
        old = old.select(*key, "bucket", F.struct(*columns).alias("_old"))
        both = once.join(old, [*key, "bucket"], "full")
        row = F.coalesce("_new", "_old") if wins == "new" else F.coalesce("_old", "_new")
    else:
        both, row = once, F.col("_new")
    version = uuid.uuid4().hex
    merged = both.select("bucket", row.alias("_r")).select("bucket", "_r.*")
    merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/data/{version}")
    entries = entries | dict.fromkeys(touched, version)
    commit(spark, path, number + 1, entries)
    return entries
