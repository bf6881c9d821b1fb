"""Sharding (4): a consistent-hash ring with virtual nodes and bounded loads.

Law `rows`: every shard's row count is floor(n / shards) or one more. A row's key is its doc_id, hashed to a place on
the ring; it belongs to the next virtual node clockwise. Each shard takes rows of its own arcs up to its capacity;
the rest of an arc continues clockwise to the next virtual nodes whose shards have room. The capacities add up to n,
so all are filled and the balance is exact, while every row that fits stays where plain consistent hashing puts it.

Only counts by arc (shards x VIRTUAL numbers, whatever the input) reach the driver; rows find their place in their
arc by a distributed running total.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.util import KEY_BITS, in_range, running_total, save, shielded, spread, table

SHARDS, VIRTUAL, OVERHEAD = 40, 64, 16


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in order, and the shard of each arc. Arc i ends at place i; the last wraps around."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") >> (64 - KEY_BITS), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in nodes], dtype=np.int64), np.array([s for _, s in nodes] + [nodes[0][1]], dtype=np.int32)


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(counts: list[int], owner: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int]]:
    """(first rank, shard, slot of the first) of runs of ring ranks. counts: rows in each arc, in ring order."""
    room, used, runs, spilt, rank = list(capacity), [0] * len(capacity), [], [], 0

    def put(shard: int, start: int, rows: int) -> int:
        take = min(rows, room[shard])
        if take:
            runs.append((start, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        return take

    for arc, rows in enumerate(counts):
        took = put(int(owner[arc]), rank, rows)
        if took < rows:
            spilt.append((arc, rank + took, rows - took))
        rank += rows
    for arc, start, rows in spilt:
        while rows:
            arc = (arc + 1) % len(owner)
            took = put(int(owner[arc]), start, rows)
            start, rows = start + took, rows - took
    return sorted(runs)


def assign(keys: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """keys with shard and slot. keys: a saved table with _place (a hash) and _tie; read twice.

    Rows that agree in _place and _tie are interchangeable. An empty table gives an empty result.
    """
    spark = keys.sparkSession
    places, owner = ring(shards, virtual)
    ends = [-1, *places.tolist(), (1 << KEY_BITS) - 1]
    arcs = spark.createDataFrame([(i, a + 1, b + 1) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))], "arc int, _from long, _to long")
    found = {r["arc"]: r["n"] for r in in_range(keys.select("_place"), "_place", arcs, 1 << KEY_BITS, bounded=True).groupBy("arc").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(a, 0) for a in range(len(owner))]
    n = sum(counts)
    runs = fill(counts, owner, capacities(n, shards))
    ends = [*(r[0] for r in runs), n][1:]
    seats = spark.createDataFrame([(shard, slot - start, start, end) for (start, shard, slot), end in zip(runs, ends, strict=True)], "shard int, _shift long, _from long, _to long")
    ranked = running_total(keys, [], "_place", ["_tie"], F.lit(1), "_rank", n)
    return in_range(ranked, "_rank", seats, n, bounded=True).withColumn("slot", F.col("_rank") + F.col("_shift")).drop("_rank", "_shift")


def place_columns(docs: DataFrame) -> DataFrame:
    """A null doc_id is placed by its text; a null text counts as none."""
    text = F.coalesce("text", F.lit(""))
    tie = F.xxhash64(text)
    return docs.withColumns({"_place": F.when(F.col("doc_id").isNull(), spread(tie)).otherwise(spread("doc_id")), "_tie": tie})


@shielded("doc_id", "text")
def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, any others) with shard and slot. Columns named shard or slot give way."""
    return assign(save(place_columns(docs), "keys"), shards).drop("_place", "_tie")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in 40 shards, by the law `rows`. Edge cases as in the module's docstring."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    keys = place_columns(docs).select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "_place", "_tie")
    return assign(save(keys, "keys")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
