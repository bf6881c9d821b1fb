"""Idempotent intake: of each key the first body holds, a replay of it is told so, and another body is refused. One pass, three outputs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from augur.sources.sinks import rocks

#: Lengths of a key.
SHORTEST, LONGEST = 8, 200

OUTCOMES = ("accepted", "repeated", "refused", "invalid")
TOLD = "key string, seq bigint, digest string, outcome string, first_at bigint, at bigint"
DAY = 86_400_000_000


def valid(key: Column) -> Column:
    return F.coalesce(F.length(key).between(SHORTEST, LONGEST), F.lit(False))


def judged(submissions: DataFrame) -> DataFrame:
    """submissions (key, seq, at, digest) with outcome and first_at (when the body that holds was received): the batch form.

    The first of a key is an aggregate, so keys with very many replays cost no window. Of equal times the smaller seq is first.
    """
    fine = submissions.withColumn("_fine", valid(F.col("key")))
    first = fine.where("_fine").groupBy("key").agg(F.min_by(F.struct("seq", "at", "digest"), F.struct("at", "seq")).alias("_first"))
    same = F.col("digest").eqNullSafe(F.col("_first.digest"))
    outcome = F.when(~F.col("_fine"), "invalid").when((F.col("seq") == F.col("_first.seq")) & (F.col("at") == F.col("_first.at")), "accepted").when(same, "repeated").otherwise("refused")
    return fine.join(first, "key", "left").select(*submissions.columns, outcome.alias("outcome"), F.when(F.col("_fine"), F.col("_first.at")).alias("first_at"))


class Intake(StatefulProcessor):
    """A row of state for each key: the digest that holds and when it was received; forgotten keep_days after."""

    def __init__(self, keep_days: int) -> None:
        self.keep = keep_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "digest string, at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = self.held.get() if self.held.exists() else None
        for at, seq, digest, fine in sorted((r["at"], r["seq"], r["digest"], r["fine"]) for r in rows):  # digests, not bodies
            if not fine:
                yield Row(key=key[0], seq=seq, digest=digest, outcome="invalid", first_at=None, at=at)
            elif held is None:
                held = (digest, at)
                self.held.update(held)
                self.handle.registerTimer((at + self.keep) // 1000)
                yield Row(key=key[0], seq=seq, digest=digest, outcome="accepted", first_at=at, at=at)
            else:
                yield Row(key=key[0], seq=seq, digest=digest, outcome="repeated" if digest == held[0] else "refused", first_at=held[1], at=at)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def intake(submissions: DataFrame, late: str = "1 day", keep_days: int = 90) -> DataFrame:
    """A stream of submissions (key, seq, ts, body; a null body is one like others) with outcome and first_at, for every row that comes."""
    rocks(submissions.sparkSession)
    slim = submissions.select("key", "seq", "ts", F.unix_micros("ts").alias("at"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"), valid(F.col("key")).alias("fine"))
    told = slim.withWatermark("ts", late).groupBy("key").transformWithState(statefulProcessor=Intake(keep_days), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")
    return told.withColumns({"first_at": F.timestamp_micros("first_at"), "at": F.timestamp_micros("at")})


def write_outcomes(told: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """A query that writes each outcome to a folder of its own. A batch that is replayed replaces its own files, so it adds nothing."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outcome", "batch").parquet(path)

    return told.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
