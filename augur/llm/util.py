"""Helpers shared by the training-data operators: tables, shared storage, distributed running totals."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one window group of a running total holds on average, and the log2 of a level's fan-out.
LEAF_ROWS, FANOUT_BITS, KEY_BITS = 64, 6, 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has the default of 10,000, which with whole texts fill an executor's memory outside the heap.

    This stays set for the session; a caller who has set another number keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="augur-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet under the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/augur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(*columns: str | Column) -> Column:
    """A KEY_BITS-bit non-negative hash of the columns."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def levels(rows: int) -> int:
    """Levels of fan-out that leave LEAF_ROWS rows in a leaf."""
    return max(0, math.ceil(math.log2(max(rows, 1) / LEAF_ROWS) / FANOUT_BITS)) if rows > LEAF_ROWS else 0


def running_total(df: DataFrame, by: list[str], key: str, order: list[str], value: Column, out: str, rows: int, bits: int = KEY_BITS) -> DataFrame:
    """df and out: the sum of value over the rows of the same `by` before this one, by (key, *order).

    No group is sorted as a whole. Rows are dealt into leaves by the top bits of key (spread evenly over `bits` bits);
    windows run within a leaf, then over at most 2**FANOUT_BITS sums of each level above. `by` holds no nulls.
    df is read twice, so it should be a saved table.
    """
    depth = min(levels(rows), math.ceil(bits / FANOUT_BITS))
    shift = max(0, bits - FANOUT_BITS * depth)
    df = df.withColumn("_leaf", F.shiftright(F.col(key), shift) if depth else F.lit(0).cast("long")).withColumn("_value", value.cast("long"))
    before = lambda part, *sort: F.coalesce(F.sum("_value").over(W.partitionBy(*part).orderBy(*sort).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = df.withColumn(out, before([*by, "_leaf"], key, *order))
    if not depth:
        return local.drop("_leaf", "_value")

    def bases(sums: DataFrame, depth: int) -> DataFrame:
        sums = sums.withColumn("_up", F.shiftright("_leaf", FANOUT_BITS))
        inner = sums.withColumn("_base", before([*by, "_up"], "_leaf"))
        if depth > 1:
            ups = bases(sums.groupBy(*by, F.col("_up").alias("_leaf")).agg(F.sum("_value").alias("_value")), depth - 1)
            inner = inner.join(ups.select(*by, F.col("_leaf").alias("_up"), F.col("_base").alias("_more")), [*by, "_up"]).withColumn("_base", F.col("_base") + F.col("_more"))
        return inner.select(*by, "_leaf", "_base")

    base = bases(df.groupBy(*by, "_leaf").agg(F.sum("_value").alias("_value")), depth)
    return local.join(base, [*by, "_leaf"]).withColumn(out, F.col(out) + F.col("_base")).drop("_leaf", "_value", "_base")


def in_range(points: DataFrame, point: str, ranges: DataFrame, total: int, bounded: bool = False) -> DataFrame:
    """points joined with the one of ranges (_from, _to) that holds point; an equi-join on stretches of [0, total).

    bounded: the number of ranges has a fixed bound, so they are broadcast (with at most 4096 stretches more).
    """
    width = max(1, total // 4096)
    cut = ranges.where("_to > _from").withColumn("_cut", F.explode(F.sequence(F.expr(f"_from div {width}"), F.expr(f"(_to - 1) div {width}"))))
    return points.withColumn("_cut", F.expr(f"{point} div {width}")).join(F.broadcast(cut) if bounded else cut, "_cut").where(f"{point} >= _from and {point} < _to").drop("_cut", "_from", "_to")


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, label) of at most `rows` documents, drawn by a hash of doc_id; nulls don't count, the largest label holds."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(rows)


def shielded(*core: str) -> Callable:
    """For an operator over docs: columns other than the core ones have neutral names while it runs, so none can clash.

    They come back under their own names; one named like a column of the result gives way to it.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def call(docs: DataFrame, *args: object, **named: object) -> DataFrame:
            hidden = {c: f"extra__{i}" for i, c in enumerate(docs.columns) if c not in core}
            out = operator(docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns]), *args, **named)
            back = {h: c for c, h in hidden.items()}
            results = {c.lower() for c in out.columns if c not in back}
            return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns if c not in back or back[c].lower() not in results])

        return call

    return wrap
