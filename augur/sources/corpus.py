"""A corpus of page revisions as a dictionary that grows: every item's text is stored once a day's pool, revisions hold references.

    <path>/items/day=<day>/       item_id, category, text: appended, never changed
    <path>/revisions/day=<day>/   revision, place, item_id: appended, a revision once ever

A load reads the pools of its own days only. Of their items those that the load might hold are kept by a Bloom filter made
from the load (bits of its hashed ids, in bitmaps that are broadcast while they have a bounded size), before the anti-join
that finds what is new: what is shuffled is as large as the load, not as what is stored. Items go first, so a load that ends
halfway leaves items that nothing names, and the same load again adds neither item nor revision twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS, REVISIONS = "item_id string, category string, text string, day date", "revision bigint, place int, item_id string, day date"

#: Bits of the filter for each id, hashes, bits of one bitmap, and the most ids whose filter is broadcast (32 MB).
BITS, HASHES, BITMAP, MOST_IDS = 8, 3, 32_768, 1 << 25


def item_id(category: Column, text: Column) -> Column:
    """128 bits of a hash: what tells items apart."""
    return F.substring(F.sha2(F.to_json(F.struct(category.alias("c"), text.alias("t"))).cast("binary"), 256), 1, 32)


def held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def places(ids: Column, size: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), ids), F.lit(size)) for i in range(HASHES)])


def bloom(ids: DataFrame, column: str, size: int) -> DataFrame:
    """bucket, bits: the bitmaps of a Bloom filter of `size` bits."""
    at = ids.select(F.explode(places(F.col(column), size)).alias("at"))
    return at.groupBy((F.col("at") / BITMAP).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits"))


def maybe(rows: DataFrame, column: str, filter_: DataFrame, size: int) -> DataFrame:
    """The rows whose id may be in the filter: none that is in it is lost."""
    found = rows
    for i in range(HASHES):
        at = F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(size))
        byte = F.conv(F.hex(F.substr("bits", (at % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        own = filter_.select("bucket", "bits")
        found = found.join(F.broadcast(own), ((at / BITMAP).cast("long") == own["bucket"]) & (F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1), "left_semi")
    return found


def load(path: str, revisions: DataFrame) -> dict[str, int]:
    """Adds revisions (day, revision, place, category, text) to the corpus, and tells how many items and rows of revisions were added.

    Revisions that are there already are left out whole: a revision's text is stored once ever. Nulls in category or text
    are values like others. An item that stands twice in a revision is two places of one item.
    """
    spark, path = revisions.sparkSession, path.rstrip("/")
    rows = revisions.withColumn("item_id", item_id(F.col("category"), F.col("text")))
    days = [r["day"] for r in rows.select("day").distinct().collect()]  # of one load
    known = held(spark, f"{path}/revisions", REVISIONS).where(F.col("day").isin(days)).select("day", "revision").distinct()
    new = rows.join(known, ["day", "revision"], "left_anti")
    fresh = new.groupBy("day", "item_id").agg(F.any_value("category").alias("category"), F.any_value("text").alias("text"))
    stored = held(spark, f"{path}/items", ITEMS).where(F.col("day").isin(days)).select("day", "item_id")
    count = fresh.count()
    if 0 < count <= MOST_IDS:
        size = -(-count * BITS // BITMAP) * BITMAP
        stored = maybe(stored, "item_id", bloom(fresh, "item_id", size), size)
    added = fresh.join(stored, ["day", "item_id"], "left_anti")
    told = {}
    for name, part, columns in (("items", added, ITEMS), ("revisions", new, REVISIONS)):
        counted = part.select(*[c.split(" ")[0] for c in columns.split(", ")])
        before = held(spark, f"{path}/{name}", columns).where(F.col("day").isin(days)).count()
        if count:
            counted.write.mode("append").partitionBy("day").parquet(f"{path}/{name}")
        told[name] = held(spark, f"{path}/{name}", columns).where(F.col("day").isin(days)).count() - before
    return told


def read(spark: SparkSession, path: str) -> DataFrame:
    """day, revision, place, category, text of all revisions."""
    path = path.rstrip("/")
    return held(spark, f"{path}/revisions", REVISIONS).join(held(spark, f"{path}/items", ITEMS), ["day", "item_id"]).select("day", "revision", "place", "category", "text")
