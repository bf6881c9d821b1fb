"""Text corpora: dictionary-encoded items and the digests that are shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def encoded(revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: item_id, item; revision_items: revision, place, item_id) of rows revision, place, item. An item's id is its hash, so no task asks another."""
    ids = revisions.withColumn("item_id", F.xxhash64("item"))
    return ids.select("item_id", "item").distinct(), ids.select("revision", "place", "item_id")


def decoded(items: DataFrame, revision_items: DataFrame) -> DataFrame:
    return revision_items.join(items, "item_id").select("revision", "place", "item")


def digest(items: DataFrame, by: list[str], limit: int) -> DataFrame:
    """by, digest: the first `limit` items as lines. items: by, place, item."""
    kept = items.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("place", "item"))).where(F.col("_n") <= limit)
    return kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", "item"))).alias("_l")).select(*by, F.concat(F.lit("- "), F.array_join(F.col("_l.item"), "\n- ")).alias("digest"))


def history_lines(obs: DataFrame, keep: int) -> DataFrame:
    """series, lines: the last `keep` points, oldest first, as a prompt shows them."""
    recent = obs.withColumn("_n", F.row_number().over(W.partitionBy("series").orderBy(F.desc("date")))).where(F.col("_n") <= keep)
    line = F.format_string("%s: %.2f", F.col("date").cast("string"), F.col("value"))
    return recent.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("date", line.alias("line")))).alias("_l")).select("series", F.array_join(F.col("_l.line"), "\n").alias("lines"))


def notes_fields(notes: DataFrame) -> DataFrame:
    """notes (column notes) with filed: what a note says after filed=."""
    return notes.withColumn("filed", F.nullif(F.regexp_extract("notes", r"filed=([^\s;]+)", 1), F.lit("")))
