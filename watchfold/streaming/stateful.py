"""Per-key stateful streams: temporal drive features and the review lifecycle.

Both keep their state in RocksDB, so that it may exceed memory, and forget idle drives and subjects by event-time timers. (Spark calls
`handleExpiredTimer` by the names of its parameters.) (A time to live needs processing time, with which a stream that drains what is there never ends.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from watchfold.operators.audit import ALLOWED, MIN_RATIONALE, TARGET

HISTORY = 7
DRIVES_BITS = 6
DRIVES = 1 << DRIVES_BITS
DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEMPORAL = ("serial_number long, date string, value double, value_delta_1 double, value_delta_7 double, value_7obs_mean double, "
            "late boolean, expired boolean")
LIFECYCLE = "subject_id long, position long, action string, from_state string, to_state string, accepted boolean, reason string"


def use_rocksdb(spark: SparkSession) -> None:
    """State variables and timers need this store; a stream keeps the one it was started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Forgetting(StatefulProcessor):
    """A processor whose keys leave the state some time after their last row. `idle_ms` None: never."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def wake_after(self, at: int) -> None:
        """One timer per key: the later one replaces the earlier."""
        if self.idle_ms is None:
            return
        at += self.idle_ms
        if self.due.exists():
            (before,) = self.due.get()
            if before >= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def overdue(self, timer_values) -> bool:
        """Whether the key's time was over before this batch: Spark hands out a batch's rows before its timers."""
        if self.idle_ms is None or not self.due.exists():
            return False
        (at,) = self.due.get()
        if at > timer_values.getCurrentWatermarkInMs():
            return False
        self.handle.deleteTimer(at)
        return True

    def close(self) -> None:
        pass


class DriveHistory(StatefulProcessor):
    """State of up to DRIVES drives with neighbouring numbers: the last seven observations of each, and when it is forgotten.

    A key costs some milliseconds in messages for its state, its timer and its frames, whatever it brings, and most drives bring a few rows in
    a batch. So drives share a key; its state stays small however many drives there are, and its timer is that of the drive due first."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.observed = handle.getValueState("observed", "slots array<int>, dates array<string>, values array<double>, drives array<int>, due array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        slots, dates, values, due = before = self.held()
        # Spark hands out a batch's rows before its timers
        gone, (slots, dates, values, due) = self.without_overdue(before, timer_values)
        yield self.shaped(key, *gone, expired=True)
        rows = pd.concat(list(rows))
        slot, date, value = rows["slot"].to_numpy(dtype=np.int64), rows["date"].to_numpy(dtype=object), rows["value"].to_numpy(dtype=np.float64)
        last = np.full(DRIVES + 1, "", dtype=object)
        last[slots] = dates  # by date, so that the last one stays
        undated = rows["date"].isna().to_numpy()
        late = undated | (np.where(undated, "", date) <= last[slot]).astype(bool)
        yield self.shaped(key, slot[late], date[late], value[late], late=True)
        came, event_ms = slot[~late], rows["event_ms"].to_numpy()[~late]
        for one in np.unique(came).tolist():
            due[one] = max(due.get(one, 0), int(event_ms[came == one].max()) + self.idle_ms)
        fresh = np.repeat([False, True], [len(slots), len(came)])
        slots, dates, values = np.append(slots, came), np.append(dates, date[~late]), np.append(values, value[~late])
        order = np.lexsort((dates.astype(str), slots))
        slots, dates, values, fresh = slots[order], dates[order], values[order], fresh[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        def back(n):
            return np.where(place >= n, np.roll(values, n), np.nan)
        seven = np.stack([back(n) for n in range(HISTORY)])
        known = ~np.isnan(seven)
        counts = known.sum(axis=0)
        mean = np.where(counts >= 2, np.where(known, seven, 0.0).sum(axis=0) / np.maximum(counts, 1), np.nan)
        yield self.shaped(key, *[c[fresh] for c in (slots, dates, values, values - back(1), values - back(HISTORY), mean)])
        kept = np.searchsorted(slots, slots, "right") - np.arange(len(slots)) <= HISTORY
        self.keep(before[-1], (slots[kept], dates[kept], values[kept], due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.held()
        gone, after = self.without_overdue(before, timerValues)
        self.keep(before[-1], after)
        yield self.shaped(key, *gone, expired=True)

    def held(self) -> tuple:
        """(slots, dates, values) by slot and date, and the time of each drive's end by slot."""
        slots, dates, values, drives, due = self.observed.get() or ([], [], [], [], [])
        return np.array(slots, dtype=np.int64), np.array(dates, dtype=object), np.array(values, dtype=np.float64), dict(zip(drives, due))

    def without_overdue(self, state: tuple, timer_values) -> tuple:
        """(slots, last dates) of the drives whose time is over, and the state of the others."""
        slots, dates, values, due = state
        now = timer_values.getCurrentWatermarkInMs()
        over = np.isin(slots, [one for one, at in due.items() if at <= now])
        last = np.append(slots[1:] != slots[:-1], True)[:len(slots)]
        return (slots[over & last], dates[over & last]), (slots[~over], dates[~over], values[~over], {one: at for one, at in due.items() if at > now})

    def keep(self, due_before: dict, state: tuple) -> None:
        slots, dates, values, due = state
        first_before, first = min(due_before.values(), default=None), min(due.values(), default=None)
        if first != first_before:
            if first_before is not None:
                self.handle.deleteTimer(first_before)
            if first is not None:
                self.handle.registerTimer(first)
        if due:
            self.observed.update((slots.tolist(), dates.tolist(), [None if np.isnan(v) else v for v in values.tolist()], list(due), list(due.values())))
        elif due_before:
            self.observed.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def shaped(key, slots, dates, values=None, delta_1=None, delta_7=None, mean=None, late=False, expired=False) -> pd.DataFrame:
        column = lambda c: np.full(len(dates), np.nan) if c is None else c
        numbers = [None if slot == DRIVES else key[0] * DRIVES + slot for slot in slots.tolist()]
        return pd.DataFrame({"serial_number": pd.Series(numbers, dtype="Int64"), "date": pd.Series(dates, dtype="object"), "value": column(values), "value_delta_1": column(delta_1),
                             "value_delta_7": column(delta_7), "value_7obs_mean": column(mean), "late": late, "expired": expired})


def temporal_stream(days: DataFrame, idle_days: int = 365, watermark: str = "30 days") -> DataFrame:
    """W1/W2 on a stream of (serial_number, date, value): deltas to 1 and 7 observations back and the
    seven-observation mean with at least two values. `date` sorts as text and begins with yyyy-MM-dd.

    A row dated at or before the last one of its drive comes out with late = true and no features; it changes no state. Rows further behind
    the newest date than `watermark` are left to Spark's late-row count. A drive without a row for `idle_days` leaves the state once the
    watermark is that far past its last date; a row with expired = true and that date says so, and a later row begins a new history."""
    use_rocksdb(days.sparkSession)
    day = F.to_timestamp(F.substring("date", 1, 10), "yyyy-MM-dd")
    # neighbours share a key; a missing number has a slot of its own
    number = F.col("serial_number").cast("long")
    keyed = [F.coalesce(F.shiftright(number, DRIVES_BITS), F.lit(0)).alias("drives"), F.coalesce(F.pmod(number, F.lit(DRIVES)), F.lit(DRIVES)).cast("int").alias("slot")]
    timed = days.select(*keyed, "date", "value", day.alias("event_time")).withWatermark("event_time", watermark)
    timed = timed.withColumn("event_ms", F.unix_millis("event_time"))
    return timed.groupBy("drives").transformWithStateInPandas(DriveHistory(idle_days * DAY_MS), TEMPORAL, "Append", "EventTime")


class ReviewState(Forgetting):
    """State: where the review of a subject stands, who has it, and when the subject is forgotten."""

    COLUMNS = ["subject_id", "position", "action", "from_state", "to_state", "accepted", "reason"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.current = handle.getValueState("current", "state string")
        self.assignee = handle.getValueState("assignee", "actor string")

    def handleInitialState(self, key, rows: pd.DataFrame, timer_values) -> None:
        row = rows.iloc[-1]
        self.current.update((row["state"],))
        if row["assignee"] is not None:
            self.assignee.update((row["assignee"],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if self.overdue(timer_values):
            yield self.forgotten(key)
        held, actor = self.current.get(), self.assignee.get()
        current, assignee = held[0] if held else "OPEN", actor[0] if actor else None
        rows = pd.concat(list(rows)).sort_values("position")
        before, out = (current, assignee), []
        for r in rows.itertuples():
            short = len((r.rationale or "").strip()) < MIN_RATIONALE
            reason = None
            if r.action not in ALLOWED:
                reason = "UNKNOWN_ACTION"
            elif current not in ALLOWED[r.action]:
                reason = "NOT_ALLOWED_FROM_STATE"
            elif r.action == "RESOLVE" and r.actor != assignee and not r.is_admin:
                reason = "NOT_ASSIGNED_REVIEWER"
            elif r.action == "RESOLVE" and (r.resolution is None or short or not r.acknowledged):
                reason = "INCOMPLETE_RESOLUTION"
            elif r.action == "REOPEN" and short:
                reason = "RATIONALE_TOO_SHORT"
            target = current if reason else TARGET[r.action]
            out.append((key[0], r.position, r.action, current, target, reason is None, reason))
            if not reason:
                assignee = r.actor if r.action == "START_REVIEW" else assignee
                current = target
        if held or (current, assignee) != before:  # refusals alone make no state; any request puts the timer off
            self.current.update((current,))
            if assignee is not None:
                self.assignee.update((assignee,))
            if "event_ms" in rows:
                self.wake_after(int(rows["event_ms"].max()))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.forgotten(key)

    def forgotten(self, key) -> pd.DataFrame:
        (current,) = self.current.get()
        for state in (self.current, self.assignee, self.due):
            state.clear()
        return pd.DataFrame([(key[0], None, "EXPIRED", current, "OPEN", True, "IDLE")], columns=self.COLUMNS).astype({"position": "Int64"})


def lifecycle_stream(requests: DataFrame, idle_days: int = 730, watermark: str = "1 day", known: DataFrame | None = None) -> DataFrame:
    """START_REVIEW / RESOLVE / REOPEN requests per subject (subject_id, position, action, actor, is_admin,
    resolution, rationale, acknowledged) to accepted transitions and refusals with a reason; an action that
    is none of the three is refused as UNKNOWN_ACTION.

    Requests with a column `requested_at` have event time: a subject without a request for `idle_days` leaves the state, an EXPIRED
    row says so, and it is OPEN again. Without the column all subjects are kept. `known` (subject_id, state, assignee), as the
    audit store has it, is the state that a new stream starts from."""
    use_rocksdb(requests.sparkSession)
    start = None if known is None else known.select("subject_id", "state", "assignee").groupBy("subject_id")
    timed = "requested_at" in requests.columns
    if timed:
        requests = requests.withWatermark("requested_at", watermark).withColumn("event_ms", F.unix_millis("requested_at"))
    work = ReviewState(idle_days * DAY_MS if timed else None)
    return requests.groupBy("subject_id").transformWithStateInPandas(work, LIFECYCLE, "Append", "EventTime" if timed else "None", initialState=start)
