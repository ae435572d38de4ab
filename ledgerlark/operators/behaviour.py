"""Point-in-time features and rules over each user's transactions.

One window specification serves all features, so a user's rows are shuffled and sorted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import columns as C
from ledgerlark.operators.asof import SLICED_ROWS, SLICES, busy_keys, carried

# The features' names in the order that models take them.
FEATURES = [
    "amount", "log_amount", "hour", "weekday", "delta_prev_seconds", "rolling_mean_10", "rolling_count_10", "device_change",
]


def _history() -> Window:
    return Window.partitionBy("user_id").orderBy("timestamp", "event_id")


def behaviour_features(txns: DataFrame, mode: str = "training") -> DataFrame:
    """txns with FEATURES, each from the user's earlier rows alone.

    Rows without a timestamp are dropped; a null device is the empty one. A user's first row has
    device_change 1 in training mode, and in scoring mode only with a device; scoring mode
    also takes an empty new device as no change.
    """
    w = _history()
    last10 = w.rowsBetween(-C.ROLLING, -1)
    device = F.coalesce("device_id", F.lit(""))
    before = F.lag(device).over(w)
    changed = F.when(before.isNull() | (device != before), 1).otherwise(0)
    if mode == "scoring":
        changed = F.when(device == "", 0).otherwise(changed)
    micros = F.unix_micros("timestamp")
    return (
        txns.filter("timestamp IS NOT NULL")
        .withColumn("amount", F.col("amount").cast("double"))
        .withColumns(
            {
                "delta_prev_seconds": F.coalesce((micros - F.lag(micros).over(w)) / 1e6, F.lit(0.0)),
                "rolling_mean_10": F.coalesce(F.avg("amount").over(last10), F.lit(0.0)),
                "rolling_count_10": F.count("amount").over(last10),
                "device_change": changed,
            }
        )
        .withColumns(
            {"log_amount": C.log_amount(F.col("amount")), "hour": F.hour("timestamp"), "weekday": C.weekday(F.col("timestamp"))}
        )
    )


def extreme_amounts(txns: DataFrame) -> DataFrame:
    """txns with prior_count, prior_max, is_extreme and ratio: the amount against all earlier ones."""
    past = _history().rowsBetween(Window.unboundedPreceding, -1)
    rows = txns.filter("timestamp IS NOT NULL").withColumns(
        {"prior_count": F.count("amount").over(past), "prior_max": F.max("amount").over(past)}
    )
    return rows.withColumn("is_extreme", is_extreme(F.col("amount"), F.col("prior_count"), F.col("prior_max"))).withColumn(
        "ratio", F.when(F.col("is_extreme"), F.col("amount") / F.col("prior_max"))
    )


def is_extreme(amount: Column, count: Column, highest: Column) -> Column:
    hit = (count >= C.EXTREME_HISTORY) & (highest > 0) & (amount >= C.EXTREME_RATIO * highest)
    return F.coalesce(hit, F.lit(False))


def daily_counts(txns: DataFrame) -> DataFrame:
    """user_id, day, n."""
    return (
        txns.filter("timestamp IS NOT NULL")
        .groupBy("user_id", F.to_date("timestamp").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _spread(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(1.0)


def daily_threshold(counts: DataFrame) -> DataFrame:
    """Per user, the mean of the active days' counts plus two (population) deviations."""
    return counts.groupBy("user_id").agg(
        (F.avg("n") + 2 * _spread(F.stddev_pop("n"))).alias("threshold"), F.count(F.lit(1)).alias("active_days")
    )


def daily_anomalies(counts: DataFrame, as_of: str | None = None) -> DataFrame:
    """Days whose count stands out of the user's active days, the day itself included.

    Users need ten transactions. With as_of only that day is judged. Distances are compared in whole numbers: where one is
    two or three deviations exactly, rounded means would decide by the order of rows.
    """
    w = Window.partitionBy("user_id")
    n, whole = F.col("n"), "decimal(38,0)"
    sums = counts.withColumns({"days": F.count("n").over(w), "total": F.sum("n").over(w), "_squares": F.sum((n * n).cast(whole)).over(w)})
    over = n * F.col("days") - F.col("total")
    spread = (F.col("days") * F.col("_squares") - F.col("total").cast(whole) * F.col("total")).cast(whole)
    rows = sums.withColumns({"_over": over, "_spread": spread})

    def beyond(z: float) -> Column:
        return (F.col("_over") > 0) & ((F.col("_over").cast(whole) * F.col("_over")).cast(whole) >= F.lit(int(z * z)) * F.col("_spread"))

    root = F.sqrt(F.col("_spread").cast("double"))
    judged = (
        rows.filter((F.col("total") >= C.DAILY_HISTORY) & (F.col("_spread") > 0) & beyond(C.Z_ALERT))
        .withColumns({"mean": F.col("total") / F.col("days"), "sd": root / F.col("days"), "z": F.col("_over") / root})
        .withColumn("severity", F.when(beyond(C.Z_HIGH), "High").otherwise("Medium"))
        .drop("days", "_squares", "_over", "_spread")
    )
    return judged.filter(F.col("day") == F.lit(as_of).cast("date")) if as_of else judged


def new_daily_alerts(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Anomalies of found that existing (user_id, day) has no alert for."""
    return found.join(existing.select("user_id", "day"), ["user_id", "day"], "left_anti")


#: The spans before a transaction that are looked at, in seconds.
SPANS = {"1h": 3600, "24h": 86400, "7d": 604800}


def velocity(txns: DataFrame, most: int = SLICED_ROWS, slices: int = SLICES) -> DataFrame:
    """Counts, sums and distinct devices of the hour, day and week before each transaction.

    Users of up to `most` rows have a window each. A frame of a busier one could hold very many rows, so that theirs are told
    by running sums of what enters and leaves it, in slices.
    """
    rows = txns.filter("timestamp IS NOT NULL").withColumn("_s", F.col("timestamp").cast("long"))
    busy, out = busy_keys(rows, "user_id", most), {}
    for name, span in SPANS.items():
        w = Window.partitionBy("user_id").orderBy("_s").rangeBetween(-span, -1)
        out |= {
            f"count_{name}": F.count(F.lit(1)).over(w),
            f"sum_{name}": F.coalesce(F.sum("amount").over(w), F.lit(0.0)),
            f"devices_{name}": F.size(F.collect_set("device_id").over(w)),
        }
    if busy is None:
        return rows.withColumns(out).drop("_s")
    calm = rows.join(busy, "user_id", "left_anti").withColumns(out)
    return calm.unionByName(_busy_velocity(rows.join(busy, "user_id", "left_semi"), most, slices)).select(*txns.columns, *out)


def _busy_velocity(rows: DataFrame, most: int, slices: int) -> DataFrame:
    """velocity() of rows (_s, their second) by running sums.

    A row enters all frames after its second and leaves one a span later. Its device counts until the user's next row
    with it: that row takes it off, and puts it back in for when it would have left.
    """
    place = F.col("_s")
    device = F.when(F.col("device_id").isNotNull(), F.concat_ws("~", F.col("user_id").cast("string"), "device_id"))
    known = carried(rows.withColumn("_d", device).filter("_d IS NOT NULL"), "_d", ["_s", "event_id"], {"_before": place}, {}, place, most, slices, itself=False)
    rows = known.drop("_d").unionByName(rows.filter("device_id IS NULL").withColumn("_before", F.lit(None).cast("long")))
    amount, held = F.coalesce(F.col("amount").cast("double"), F.lit(0.0)), F.when(F.col("device_id").isNotNull(), 1).otherwise(0)
    again = {n: F.coalesce(place - F.col("_before") <= span, F.lit(False)) for n, span in SPANS.items()}
    names = [f"{what}_{n}" for n in SPANS for what in ("count", "sum", "devices")]

    def change(at: Column, kind: int, values: dict[str, Column]) -> Column:
        numbers = [values.get(n, F.lit(0)).cast("double" if n.startswith("sum") else "long").alias(f"_{n}") for n in names]
        return F.struct(at.cast("long").alias("_at"), F.lit(kind).alias("_kind"), *numbers)

    enters = {}
    for n in SPANS:
        enters |= {f"count_{n}": F.lit(1), f"sum_{n}": amount, f"devices_{n}": held - again[n].cast("int")}
    changes = [change(place, 0, {}), change(place, 1, enters)]
    for n, span in SPANS.items():
        changes.append(change(place + span, 1, {f"count_{n}": F.lit(-1), f"sum_{n}": -amount, f"devices_{n}": -held}))
        changes.append(F.when(again[n], change(F.col("_before") + span, 1, {f"devices_{n}": F.lit(1)})))
    own = [c for c in rows.columns if c != "_before"]
    events = rows.select("user_id", F.struct(*own).alias("_row"), F.explode(F.filter(F.array(*changes), lambda x: x.isNotNull())).alias("_e"))
    events = events.select("user_id", F.when(F.col("_e._kind") == 0, F.col("_row")).alias("_row"), F.col("_row.event_id").alias("_id"), "_e.*")
    found = carried(events, "user_id", ["_at", "_kind", "_id"], {}, {n: F.col(f"_{n}") for n in names}, F.col("_at"), most, slices).filter("_kind = 0")
    # of an empty frame rounding may leave a trace
    shown = [
        F.when(F.col(f"count_{c[4:]}") == 0, 0.0).otherwise(F.col(c)).alias(c) if c.startswith("sum") else F.col(c).cast("int" if c.startswith("devices") else "long").alias(c)
        for c in names
    ]
    return found.select("_row.*", *shown)


def shared_devices(txns: DataFrame) -> DataFrame:
    """Per user: devices used, and links, one for each other user of each of them.

    Users and devices are counted on the bipartite graph, whose pairs of users are never listed;
    widest_device tells a kiosk from a link.
    """
    edges = txns.filter("device_id IS NOT NULL").select("user_id", "device_id").distinct()
    degree = edges.groupBy("device_id").agg(F.count(F.lit(1)).alias("users"))
    linked = edges.join(degree, "device_id")
    return linked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("devices"),
        F.sum(F.col("users") - 1).alias("links"),
        F.max("users").alias("widest_device"),
    )


def reason_codes(features: DataFrame, names: list[str] = FEATURES, top: int = 3) -> DataFrame:
    """transaction_id and its `top` features by distance from the mean of the user's earlier rows, in deviations.

    A first row has no history and distances of 0. Ties go to the later name.
    """
    w = _history().rowsBetween(Window.unboundedPreceding, -1)
    z = [
        F.struct(
            F.coalesce(F.round(F.abs((F.col(c) - F.avg(c).over(w)) / _spread(F.stddev_pop(c).over(w))), 6), F.lit(0.0)).alias("z"),
            F.lit(c).alias("feature"),
        )
        for c in names
    ]
    ranked = features.withColumn("_z", F.sort_array(F.array(*z), asc=False))
    return ranked.select("event_id", "transaction_id", "user_id", F.slice("_z", 1, top).alias("reasons"))


#: Rows whose windows are looked at at once.
WINDOW_ROWS = 1 << 12


def _middle(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of the first n values along the last axis, whose values are in order; NaN where n is 0."""
    low, high = (np.take_along_axis(ordered, np.maximum(k, 0)[..., None], -1)[..., 0] for k in ((n - 1) // 2, n // 2))
    return np.where(n > 0, (low + high) / 2, np.nan)


def _medians(values: np.ndarray, there: np.ndarray, place: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row after the first `last` of values (rows by features): the medians of the min(place, last) rows before it,
    the median distances from them, and whether it has any. Values that are not there are no part of them."""
    windows = np.lib.stride_tricks.sliding_window_view
    inside = np.arange(last) >= last - np.minimum(place, last)[:, None]
    held = windows(there[:-1], last, 0) & inside[:, None, :]
    n = held.sum(-1)
    x = np.where(held, windows(values[:-1], last, 0), np.nan)  # NaN comes last in order, so that those that are not there do
    middle = _middle(np.sort(x, -1), n)
    return middle, _middle(np.sort(np.abs(x - middle[..., None]), -1), n), n > 0


def robust_reasons(features: DataFrame, names: list[str] = FEATURES, top: int = 3, last: int = 50) -> DataFrame:
    """event_id, transaction_id, user_id and the row's `top` features by robust z: the distance from the median of the user's
    `last` earlier rows, in median absolute deviations (of one where they are 0).

    The frame bounds what a row looks at, so that busy users cost no more a row than others. A first row has
    distances of 0. Ties go to the later name.
    """
    spec = "event_id long, transaction_id string, user_id long, own array<double>, middle array<double>, spread array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        values, there, user, seen = np.full((last, k), np.nan), np.zeros((last, k), bool), None, 0
        for whole in batches:
            for at in range(0, whole.num_rows, WINDOW_ROWS):
                batch = whole.slice(at, WINDOW_ROWS)
                users = np.array(batch.column(2).to_pylist(), object)
                new = np.r_[user is None or users[0] != user[0], users[1:] != users[:-1]]
                first = np.maximum.accumulate(np.where(new, np.arange(len(users)), 0))
                place = np.arange(len(users)) - first + np.where(np.cumsum(new) == 0, seen, 0)
                columns = [batch.column(3 + j) for j in range(k)]
                values = np.r_[values, np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)]
                there = np.r_[there, np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], 1)]
                middle, spread, some = _medians(values, there, place, last)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(users) + 1) * k, pa.int32()), pa.array(x.ravel(), pa.float64(), mask=~held.ravel()))
                    for x, held in ((values[last:], there[last:]), (middle, some), (spread, some))
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(3)), *lists], names=["event_id", "transaction_id", "user_id", "own", "middle", "spread"])
                values, there, user, seen = values[-last:], there[-last:], (users[-1],), int(place[-1]) + 1

    # a task walks over its users' rows in order and keeps the last ones, however many a user has
    rows = features.select("event_id", "transaction_id", "user_id", *[F.col(c).cast("double").alias(c) for c in names], F.col("timestamp").alias("_t"))
    found = rows.repartition("user_id").sortWithinPartitions("user_id", "_t", "event_id").drop("_t").mapInArrow(run, spec)

    def far(c: str) -> Column:
        own, middle, spread = (F.col(x)[names.index(c)] for x in ("own", "middle", "spread"))
        return F.coalesce(F.round(F.abs(own - middle) / _spread(spread), 6), F.lit(0.0))

    z = [F.struct(far(c).alias("z"), F.lit(c).alias("feature")) for c in names]
    ranked = found.withColumn("_z", F.sort_array(F.array(*z), asc=False))
    return ranked.select("event_id", "transaction_id", "user_id", F.slice("_z", 1, top).alias("reasons"))
