"""The work queue as a state machine over a stream of its events.

An event (id, ts, seq, event, last_error, bundle_id) sets a row's status (`queued`, `resolving`, `graphed`,
`failed`), or is `reset_quota`, which queues a row that failed for the quota. A row that has been resolving
without a bundle for `minutes` is queued again by a timer.

Events wait in list state until the watermark has passed them, and are then folded in the order of (ts, seq); so
the states do not depend on the order of arrival, and a stream ends in what `replayed` gives for the same
events as a table. Rows whose work is done leave the state `keep` hours later.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = ("queued", "resolving", "graphed", "failed")
STALE_MINUTES, KEEP_HOURS = 60, 72
QUOTA = "quotaexceeded"
COLUMNS = "id bigint, status string, last_error string, bundle_id string, updated_at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def is_quota(error: str | None) -> bool:
    return QUOTA in (error or "").lower()


def folded(state: tuple | None, events: list[tuple], upto: int, stale: int) -> tuple | None:
    """The state (status, last_error, bundle_id, updated_at) after events (ts, seq, event, error, bundle) and the
    time up to `upto`; all times in microseconds."""
    for ts, _, event, error, bundle in sorted(events, key=lambda e: e[:2]):
        state = _waited(state, ts, stale)
        if event in STATES:
            state = (event, error, bundle, ts)
        elif event == "reset_quota" and state and state[0] == "failed" and is_quota(state[1]):
            state = ("queued", None, state[2], ts)
    return _waited(state, upto, stale)


def _waited(state: tuple | None, now: int, stale: int) -> tuple | None:
    if state and state[0] == "resolving" and state[2] is None and state[3] + stale <= now:
        return "queued", state[1], None, state[3] + stale
    return state


class QueueMachine(StatefulProcessor):
    """One row's state, the events that wait for the watermark, and its timers."""

    def __init__(self, minutes: int = STALE_MINUTES, keep: int = KEEP_HOURS):
        self.stale, self.keep = minutes * 60_000_000, keep * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, last_error string, bundle_id string, updated_at bigint")
        self.waiting = handle.getListState("waiting", "ts bigint, seq bigint, event string, last_error string, bundle_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            for ts, seq, event, error, bundle in zip(micros, part["seq"], part["event"], part["last_error"], part["bundle_id"]):
                clean = [None if pd.isna(x) else x for x in (error, bundle)]
                self.waiting.appendValue((int(ts), int(seq), event, *clean))
                self.handle.registerTimer(-(-int(ts) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(e) for e in self.waiting.get()]
        ready, later = [e for e in waiting if e[0] <= now * 1000], [e for e in waiting if e[0] > now * 1000]
        before = tuple(self.state.get()) if self.state.exists() else None
        after = folded(before, ready, now * 1000, self.stale)
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if after is None:
            return
        if after[0] == "graphed" and not later and expiredTimerInfo.getExpiryTimeInMs() >= after[3] // 1000 + self.keep:
            self.state.clear()  # the table keeps the row
        elif after != before:
            self.state.update(after)
        if after != before:
            wait = self.stale // 1000 + 1 if after[0] == "resolving" and after[2] is None else self.keep if after[0] == "graphed" else 0
            if wait and after[3] // 1000 + wait > now:
                self.handle.registerTimer(after[3] // 1000 + wait)
            yield pd.DataFrame({"id": [key[0]], "status": [after[0]], "last_error": [after[1]], "bundle_id": [after[2]],
                "updated_at": [pd.Timestamp(after[3], unit="us")]})

    def close(self) -> None:
        pass


def queue_states(events: DataFrame, *, minutes: int = STALE_MINUTES, late: str = "1 hour", keep: int = KEEP_HOURS) -> DataFrame:
    """A stream of the rows' states as they change. Sets the session's state store to RocksDB, which
    stateful processors need."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.withWatermark("ts", late).groupBy("id").transformWithStateInPandas(QueueMachine(minutes, keep), COLUMNS, "Update", "EventTime")


def replayed(events: DataFrame, as_of, *, minutes: int = STALE_MINUTES) -> DataFrame:
    """The states at `as_of` of a table of events: each row's last status, then what befell it after that."""
    place = F.struct("ts", "seq")
    sets = events.where(F.col("event").isin(*STATES))
    last = sets.groupBy("id").agg(F.max_by(F.struct("event", "last_error", "bundle_id", "ts", "seq"), place).alias("e")).select("id", "e.*")
    failed = F.lower(F.coalesce("last_error", F.lit(""))).contains(QUOTA) & (F.col("event") == "failed")
    resets = events.where("event = 'reset_quota'").select("id", F.col("ts").alias("reset_at"), F.col("seq").alias("reset_seq"))
    after = last.where(failed).select("id", "ts", "seq").join(resets, "id").where(F.struct("reset_at", "reset_seq") > place)
    out = last.join(after.groupBy("id").agg(F.min("reset_at").alias("reset_at")), "id", "left")
    due = F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
    stale = (F.col("event") == "resolving") & F.col("bundle_id").isNull() & (due <= F.lit(as_of).cast("timestamp"))
    reset = F.col("reset_at").isNotNull()
    return out.select("id", F.when(stale | reset, "queued").otherwise(F.col("event")).alias("status"),
        F.when(~reset, F.col("last_error")).alias("last_error"), "bundle_id",
        F.when(reset, F.col("reset_at")).when(stale, due).otherwise(F.col("ts")).alias("updated_at"))


def transitions(events: DataFrame) -> DataFrame:
    """How often one status followed another, over all rows."""
    sets = events.where(F.col("event").isin(*STATES))
    before = F.lag("event").over(Window.partitionBy("id").orderBy("ts", "seq"))
    return sets.withColumn("before", before).groupBy("before", F.col("event").alias("after")).agg(F.count("*").alias("n"))
