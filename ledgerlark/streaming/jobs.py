"""Structured Streaming jobs over transactions, with the columns of the batch jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlark.functions import columns as C
from ledgerlark.operators.behaviour import is_extreme, new_daily_alerts
from ledgerlark.sources import tables as S

_OUT = (
    "event_id long, transaction_id string, user_id long, amount double, tx_type string, timestamp timestamp, "
    "delta_prev_seconds double, rolling_mean_10 double, rolling_count_10 long, device_change int, "
    "prior_count long, prior_max double, late boolean"
)


#: Groups of users whose histories are kept together; a group's state is read and written once a micro-batch.
PROFILE_BUCKETS = 1024
#: A user's history: last holds the last amounts, right-aligned, and size how many there are; highest is -inf without any.
_HISTORY = np.dtype([("user", "i8"), ("n", "i8"), ("highest", "f8"), ("micros", "i8"), ("id", "i8"), ("size", "i8"), ("last", "f8", (C.ROLLING,))])


class Profile(StatefulProcessor):
    """The running histories of a group of users: count, greatest amount, last time and device, last amounts.

    Rows of a micro-batch are taken in order of time and id; a row older than the last one seen
    meets the history as it is and is flagged late. The users of a group are array work in one call, since a call for
    each user costs far more than its rows; a call holds a group's rows of one micro-batch, which the source's files
    a trigger bound. In scoring mode a row without a device changes none.
    """

    def __init__(self, mode: str = "training"):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profiles", "users binary, devices array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        raw, worn_last = self.state.get() if self.state.exists() else (b"", [])
        held, worn_last = np.frombuffer(raw, _HISTORY), np.array(worn_last, object)
        frame = pd.concat(list(rows)).sort_values(["user_id", "timestamp", "event_id"], ignore_index=True)
        out = frame[["event_id", "transaction_id", "user_id", "amount", "tx_type", "timestamp"]].copy()
        now, ids = frame["timestamp"].to_numpy("datetime64[us]").astype(np.int64), frame["event_id"].to_numpy()
        mine = frame["device_id"].where(frame["device_id"].notna(), "").to_numpy(object)
        # u is the place of a row's user among the group's users of this call, place that of a row among its user's
        users, start, u, rows_of = np.unique(frame["user_id"].to_numpy(np.int64), return_index=True, return_inverse=True, return_counts=True)
        place = np.arange(len(now)) - start[u]
        was, device = np.zeros(len(users), _HISTORY), np.full(len(users), None, object)
        was["user"], was["highest"] = users, -np.inf
        known, at = np.isin(users, held["user"]), np.searchsorted(held["user"], users)
        was[known], device[known] = held[at[known]], worn_last[at[known]]
        # rows are sorted, so that a user's late ones lead
        late = known[u] & ((now < was["micros"][u]) | ((now == was["micros"][u]) & (ids < was["id"][u])))
        lates = np.bincount(u, late, len(users)).astype(np.int64)
        lead = place <= lates[u]
        before, worn = np.where(lead, was["micros"][u], np.roll(now, 1)), np.where(lead, device[u], np.roll(mine, 1))
        new = ~known[u] & (place == 0)
        changed = new | (worn != mine)
        if self.mode == "scoring":
            changed &= mine != ""
        # amounts before each row: those of its user's state, then this batch's
        amounts = frame["amount"].to_numpy(float)
        there = ~np.isnan(amounts)
        seen = np.cumsum(there) - there
        earlier = seen[start]
        seen = seen - earlier[u]
        added = np.bincount(u, there, len(users)).astype(np.int64)
        order = np.arange(len(users))
        first = earlier + C.ROLLING * order
        places = np.flatnonzero(there)
        padded = np.empty(len(places) + C.ROLLING * len(users))
        padded[first[:, None] + np.arange(C.ROLLING)] = was["last"]
        padded[(first + C.ROLLING)[u[places]] + seen[places]] = amounts[places]
        windows = np.lib.stride_tricks.sliding_window_view(padded, C.ROLLING)
        recent, window = windows[first[u] + seen], np.minimum(was["size"][u] + seen, C.ROLLING)
        top = earlier + order
        tops = np.empty(len(places) + len(users))
        tops[top], tops[(top + 1)[u[places]] + seen[places]] = was["highest"], amounts[places]
        tops = pd.Series(tops).groupby(np.repeat(order, added + 1)).cummax().to_numpy()
        prior_max = tops[top[u] + seen]
        out["delta_prev_seconds"] = np.where(new, 0.0, (now - before) / 1e6)
        out["rolling_mean_10"] = recent.sum(axis=1) / np.maximum(window, 1)
        out["rolling_count_10"], out["device_change"], out["prior_count"] = window, changed.astype(np.int32), was["n"][u] + seen
        out["prior_max"], out["late"] = np.where(np.isneginf(prior_max), np.nan, prior_max), late
        if key[0] < 0:
            out["user_id"] = None
        end, moved = start + rows_of - 1, lates < rows_of
        was["n"], was["highest"], was["size"] = was["n"] + added, tops[top + added], np.minimum(was["size"] + added, C.ROLLING)
        was["last"] = windows[first + added]
        was["micros"][moved], was["id"][moved], device[moved] = now[end][moved], ids[end][moved], mine[end][moved]
        idle = ~np.isin(held["user"], users)
        merged, devices = np.concatenate((held[idle], was)), np.concatenate((worn_last[idle], device))
        by_user = np.argsort(merged["user"])
        self.state.update((merged[by_user].tobytes(), devices[by_user].tolist()))
        yield out

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with bucket, the group of their user. Those without a user are group -1 and have user 0 there, since pandas has no whole numbers beside nulls."""
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    return rows.withColumns({"bucket": bucket.cast("int"), "user_id": F.coalesce("user_id", F.lit(0))})


_CHECK = "user_id long, day date, n long, z double, severity string"
_CHECK_NAMES = [x.split()[0] for x in _CHECK.split(", ")]
_DAY_MS = 86_400_000
#: Groups of users whose closed days are judged together; a group's state is read and written once a micro-batch.
DAY_BUCKETS = 1024


def _day_found(user: Any, day: int, n: int, past: tuple[int, int, int]) -> tuple | None:
    """The row of a day that stands out of a user's days until then (their number, transactions, sum of squared counts), else None."""
    days, total, squares = past
    over, spread = days * n - total, days * squares - total * total
    if total < C.DAILY_HISTORY or not spread or over <= 0 or over * over < C.Z_ALERT**2 * spread:
        return None
    severity = "High" if over * over >= C.Z_HIGH**2 * spread else "Medium"
    return user, np.datetime64(day, "D").astype(object), n, over / math.sqrt(spread), severity


class DailyCheck(StatefulProcessor):
    """For streams of few users, since each row's user costs a call: closes a user's days by event time and judges each against the days until then, itself included.

    State is the counts of open days and, of closed ones, three whole numbers: days, transactions and the
    sum of squared counts. Comparisons are in whole numbers, so that rows may come in any
    grouping and order. A day closes when the watermark passes its end; rows of closed days are left out. A user
    without an open day for idle_days is forgotten.
    """

    def __init__(self, idle_days: int = 400):
        self.idle = idle_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "days long, total long, squares long, closed long")
        self.open = handle.getMapState("open", "day long", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        closed = self.past.get()[3] if self.past.exists() else None
        for frame in rows:
            days = frame["timestamp"].dropna().to_numpy("datetime64[D]").astype(np.int64)
            for day, n in zip(*np.unique(days, return_counts=True), strict=True):
                day = int(day)
                if closed is not None and day <= closed:
                    continue
                had = self.open.getValue((day,))[0] if self.open.containsKey((day,)) else 0
                self.open.updateValue((day,), (had + int(n),))
                if not had:
                    self.handle.registerTimer((day + 1) * _DAY_MS)
        yield pd.DataFrame(columns=_CHECK_NAMES, dtype=object)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        days, total, squares, closed = self.past.get() if self.past.exists() else (0, 0, 0, None)
        mark, found = timerValues.getCurrentWatermarkInMs(), []
        due = sorted((k[0], v[0]) for k, v in self.open.iterator() if (k[0] + 1) * _DAY_MS <= mark)
        for day, n in due:
            days, total, squares, closed = days + 1, total + n, squares + n * n, day
            self.open.removeKey((day,))
            if row := _day_found(key[0], day, n, (days, total, squares)):
                found.append(row)
        if due:
            self.past.update((days, total, squares, closed))
            self.handle.registerTimer((closed + 1) * _DAY_MS + self.idle)
        elif closed is not None and (closed + 1) * _DAY_MS + self.idle <= mark and not any(True for _ in self.open.keys()):
            self.past.clear()
        yield pd.DataFrame(found, columns=_CHECK_NAMES, dtype=object)

    def close(self) -> None:
        pass


class ClosedDays(StatefulProcessor):
    """Judges closed days (user_id, day, n) of a group of users, each against the user's days until then, itself included.

    Days come once each and, of one user, in order over micro-batches. State has five whole numbers for each
    user: its id, days, transactions, the sum of squared counts, and the last day closed. A user whose next day comes over idle_days
    after the last one begins anew, and users whom the group's last day leaves that far behind are forgotten.
    """

    def __init__(self, idle_days: int = 400):
        self.idle = idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "users array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = np.array(self.past.get()[0] if self.past.exists() else [], np.int64).reshape(-1, 5).tolist()
        past, found = {u: values for u, *values in held}, []
        frame = pd.concat(list(rows))
        frame["day"] = frame["day"].to_numpy("datetime64[D]").astype(np.int64)
        for user, day, n in sorted(zip(*(frame[c].tolist() for c in ("user_id", "day", "n")), strict=True), key=lambda r: r[1]):
            days, total, squares, closed = past.get(user, (0, 0, 0, day))
            if day - closed > self.idle:
                days = total = squares = 0
            past[user] = days, total, squares, _ = days + 1, total + n, squares + n * n, day
            if row := _day_found(None if key[0] < 0 else user, day, n, (days, total, squares)):
                found.append(row)
        last = int(frame["day"].max())
        self.past.update(([x for u, values in past.items() if last - values[3] <= self.idle for x in (u, *values)],))
        yield pd.DataFrame(found, columns=_CHECK_NAMES, dtype=object)

    def close(self) -> None:
        pass


def daily_check(txns: DataFrame, delay: str = "1 day", idle_days: int = 400) -> DataFrame:
    """user_id, day, n, z and severity of the days that stand out, each once, when it closes.

    Spark counts days and closes them by event time; Python gets a row for each closed day, and a call for each group of users.
    """
    closed = stream_daily_counts(txns.filter("timestamp IS NOT NULL"), delay)
    groups = _grouped(closed, DAY_BUCKETS).select("bucket", "user_id", "day", "n").groupBy("bucket")
    return groups.transformWithStateInPandas(ClosedDays(idle_days), _CHECK, "Append", "None")


def daily_sink(folder: str, existing: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes the alerts of closed days for which existing (user_id, day) has none."""

    def sink(rows: DataFrame, batch: int) -> None:
        new = rows if existing is None else new_daily_alerts(rows, existing)
        new = new.withColumn("alert_id", C.stable_key(F.col("user_id"), F.col("day"), F.lit("daily")))
        new.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return sink


def unique(txns: DataFrame, delay: str = "1 day") -> DataFrame:
    """The stream without repeats of a transaction id, which are looked for as long as delay."""
    return txns.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["transaction_id"])


def stream_features(txns: DataFrame, mode: str = "training") -> DataFrame:
    """Point-in-time features of a stream, from keyed state instead of each user's whole history."""
    groups = _grouped(txns.filter("timestamp IS NOT NULL"), PROFILE_BUCKETS).groupBy("bucket")
    found = groups.transformWithStateInPandas(Profile(mode), _OUT, "Append", "None")
    return found.withColumn("is_extreme", is_extreme(F.col("amount"), F.col("prior_count"), F.col("prior_max")))


def stream_daily_counts(txns: DataFrame, delay: str = "1 day") -> DataFrame:
    """user_id, day and n, emitted once the watermark has passed the day."""
    return (
        txns.withWatermark("timestamp", delay)
        .groupBy("user_id", F.window("timestamp", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.to_date("w.start").alias("day"), "n")
    )


def stream_scored(bodies: DataFrame, score: Callable[[DataFrame], DataFrame], delay: str = "1 day") -> DataFrame:
    """From a stream of request bodies (event_id, user_id, body, received_at) to its features and score().

    Bodies are parsed and validated, faulty ones dropped, repeats of an event left out.
    """
    good = S.accepted(S.validate_payloads(S.parse_bodies(bodies)))
    txns = good.select(
        "event_id", F.col("event_id").cast("string").alias("transaction_id"), "user_id", F.col("parsed_amount").alias("amount"),
        "tx_type", F.col("parsed_time").alias("timestamp"), F.nullif("device", F.lit("")).alias("device_id"),
    )
    return score(stream_features(unique(txns, delay)))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what has arrived, into Parquet files with exactly-once output."""
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over what has arrived, each micro-batch through sink(rows, batch_id)."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def alert_sink(folder: str, score: Callable[[DataFrame], DataFrame], raise_alerts: Callable[[DataFrame], DataFrame]):
    """A foreachBatch sink that writes scored rows and then alerts, each under its batch's id.

    A replayed batch overwrites its own folders, so nothing is written twice; alerts, which
    notifications are sent from, come last.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        scored = score(rows)
        scored.write.mode("overwrite").parquet(f"{folder}/scored/batch={batch}")
        again = rows.sparkSession.read.parquet(f"{folder}/scored/batch={batch}")
        raise_alerts(again).write.mode("overwrite").parquet(f"{folder}/alerts/batch={batch}")

    return sink
