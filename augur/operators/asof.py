"""AS-OF joins: what was known at a moment.

Both sides are united and sorted within stretches of time of each key, so a key with a third of all rows is many tasks.
The last row of each stretch goes to the later ones through a window over stretches, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a stretch of time.
STRETCH = 86_400


def _asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: list[str], forward: bool, strict: bool, stretch: int) -> DataFrame:
    kinds = right.select(F.struct(*value).alias("v")).schema[0].dataType, left.select(F.struct(*left.columns).alias("l")).schema[0].dataType
    at = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / stretch)
    a = left.select(*on, at(left_time).alias("_s"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(kinds[0]).alias("_right"))
    b = right.select(*on, at(right_time).alias("_s"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kinds[1]).alias("_left"), F.struct(*value).alias("_right"))
    time = F.desc("_t") if forward else F.asc("_t")
    near = W.partitionBy(*on, "_s").orderBy(time, F.col("_side") * (-1 if strict else 1)).rowsBetween(W.unboundedPreceding, 0)
    own = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(near)).where("_side = 1")
    edge = (F.min_by if forward else F.max_by)("_right", "_t").alias("_edge")
    edges = b.groupBy(*on, "_s").agg(edge)
    far = W.partitionBy(*on).orderBy(F.desc("_s") if forward else F.asc("_s")).rowsBetween(W.unboundedPreceding, -1)
    stretches = a.select(*on, "_s").distinct().join(edges, [*on, "_s"], "full").withColumn("_before", F.last("_edge", ignorenulls=True).over(far)).drop("_edge")
    found = own.join(stretches, [*on, "_s"], "left").withColumn("_found", F.coalesce("_found", "_before"))
    return found.select("_left.*", *[F.col(f"_found.{v}") for v in value])


def asof_backward(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: list[str], strict: bool = False, stretch: int = STRETCH) -> DataFrame:
    """left with `value` of the newest row of right (same `on`) at or before its time; strict: before it. Keys hold no nulls."""
    return _asof(left, right, on, left_time, right_time, value, False, strict, stretch)


def asof_forward(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: list[str], stretch: int = STRETCH) -> DataFrame:
    """left with `value` of the oldest row of right at or after its time. Keys hold no nulls."""
    return _asof(left, right, on, left_time, right_time, value, True, False, stretch)


def latest(df: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """The last row of each key by `order` (all ascending), as a maximum: partial aggregates, no sort."""
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*by, "_row.*")


def earliest(df: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*by, "_row.*")


def last_rows(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """The k newest rows of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_n") <= k).drop("_n")


def only_new(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not known yet: merges only add."""
    return df.join(known.select(*on).distinct(), on, "left_anti")
