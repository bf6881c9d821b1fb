"""The run ledger as a stream: one row of state for each source or entrant's round, with timers for deadlines and for what nobody asks about any more."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from augur.operators.ledger import MISS, NO_FORECAST, ROW
from augur.sources.sinks import rocks

#: Times are microseconds in the state and on the way to and from Python, so no time zone can come between.
TOLD = ROW.replace("timestamp", "bigint")
STATE = TOLD.split(", ", 1)[1].replace("evidence array<string>", "evidence string") + ", forget bigint"
DAY = 86_400_000_000


class Ledger(StatefulProcessor):
    """Folds effects (operators.ledger.EFFECT) in the order of ts and seq, as far as they come in order.

    missing: whether a unit that has not succeeded when the watermark passes its deadline has missed its lock. keep_days
    after the last event or the deadline, whichever is later, a unit's state is dropped, so the state stays as large as the
    units that are being worked on.
    """

    def __init__(self, missing: bool, keep_days: int = 90) -> None:
        self.missing, self.keep = missing, keep_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        held = self.row.get() if self.row.exists() else None
        state, attempts, error, retry, action, alert, route, told, deadline, forget = held or ("retryable_failure", 0, None, None, "none", False, None, "", None, None)
        evidence, newest = set(filter(None, told.split("\n"))), None
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            attempts = max(r["least"], attempts + r["more"], 0)
            state, alert, route = r["state"] or state, alert if r["alert"] is None else r["alert"], r["route"] or route
            error, retry = r["error"] if r["sets_error"] else error, r["retry"] if r["sets_retry"] else retry
            action, deadline, newest = r["action"], max(filter(None, (deadline, r["due"])), default=None), r["at"]
            evidence |= set(r["evidence"])
        due = max(filter(None, (newest, deadline))) + self.keep
        if self.missing and deadline is not None and held is None:
            self.handle.registerTimer(millis(deadline))
        if forget is not None and forget != due:
            self.handle.deleteTimer(millis(forget))
        if forget != due:
            self.handle.registerTimer(millis(due))
        self.row.update((state, attempts, error, retry, action, alert, route, "\n".join(sorted(evidence)), deadline, due))
        yield self.told(key)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if not self.row.exists():
            return
        state, attempts, error, retry, action, alert, route, told, deadline, forget = self.row.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.missing and deadline is not None and at == millis(deadline) and state not in ("succeeded", "missed_lock"):
            self.row.update(("missed_lock", attempts, NO_FORECAST, None, MISS, True, route, told, deadline, forget))
            yield self.told(key)
        if at == millis(forget):
            self.row.clear()

    def told(self, key: tuple) -> Row:
        state, attempts, error, retry, action, alert, route, told, deadline, _ = self.row.get()
        return Row(unit=key[0], state=state, attempts=attempts, last_error=error, next_retry=retry, required_action=action, alert=alert, route=route, evidence=list(filter(None, told.split("\n"))), deadline=deadline)

    def close(self) -> None:
        pass


def millis(micros: int) -> int:
    return micros // 1000


def ledger(steps: DataFrame, missing: bool, late: str = "1 day", keep_days: int = 90) -> DataFrame:
    """ROW of each unit with every batch that changes it (update mode). steps: a stream of effects."""
    rocks(steps.sparkSession)
    micros = steps.withColumns({"at": F.unix_micros("ts"), "due": F.unix_micros("deadline"), "retry": F.unix_micros("next_retry")}).drop("deadline", "next_retry")
    told = micros.withWatermark("ts", late).groupBy("unit").transformWithState(statefulProcessor=Ledger(missing, keep_days), outputStructType=TOLD, outputMode="Update", timeMode="EventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("next_retry", "deadline")})
