"""What was known at each row's place in an order: last values and running sums over a key's earlier rows.

A busy key's rows are cut into slices of about equal numbers, mostly of time; each slice is a window of its
own, and what the slices before have left is carried into it, a row for each slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key above which it is cut, and into how many slices.
SLICED_ROWS, SLICES = 1 << 16, 1024


def busy_keys(rows: DataFrame, key: str, most: int = SLICED_ROWS) -> DataFrame | None:
    """The keys of over `most` rows; None if there is none, which is looked up at once."""
    busy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(key)
    return None if busy.isEmpty() else busy


def slices_of(rows: DataFrame, key: str, place: Column, most: int = SLICED_ROWS, slices: int = SLICES) -> DataFrame:
    """rows with _slice: 0, or for a key of over `most` rows how many quantiles of its numbers `place` lie before the row's.

    Rows of one place are in one slice. Quantiles are approximate, which moves cuts and nothing else. Whether any key
    is busy is looked up at once, so that the others' plan stays plain.
    """
    busy = busy_keys(rows, key, most)
    if busy is None:
        return rows.withColumn("_slice", F.lit(0))
    placed = rows.withColumn("_place", place)
    shares = ", ".join(f"{k / slices}D" for k in range(1, slices))  # as text, for one call instead of one for each
    cuts = placed.join(busy, key, "left_semi").groupBy(key).agg(F.expr(f"percentile_approx(_place, array({shares}), {10 * slices})").alias("_cuts"))
    before = F.size(F.filter("_cuts", lambda c: c < F.col("_place")))
    return placed.join(cuts, key, "left").withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(before)).drop("_cuts", "_place")


def carried(
    rows: DataFrame, key: str, order: list[str], lasts: dict[str, Column], sums: dict[str, Column], place: Column | None = None,
    most: int = SLICED_ROWS, slices: int = SLICES, itself: bool = True,
) -> DataFrame:
    """rows with, for each of lasts, its last value that isn't null, and for each of sums its sum, over the key's rows up to this one.

    Without itself, over the rows before it. order decides among all rows of a key, and place is a number that rises with it: by
    default it begins with a time, and rows without a key or a time are dropped.
    """
    kept = rows if place is not None else rows.filter(F.col(key).isNotNull() & F.col(order[0]).isNotNull())
    cut = slices_of(kept, key, F.unix_micros(order[0]) if place is None else place, most, slices)
    cut = cut.withColumns({f"_v_{n}": c for n, c in {**lasts, **sums}.items()})
    inner = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    near = cut.withColumns(
        {f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inner) for n in lasts}
        | {f"_i_{n}": F.coalesce(F.sum(F.coalesce(f"_v_{n}", F.lit(0))).over(inner), F.lit(0)) for n in sums}
    )
    # what a slice leaves to later ones, a row for each slice
    at = F.struct(*order)
    left = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_c_{n}") for n in lasts]
    left += [F.sum(F.coalesce(f"_v_{n}", F.lit(0))).alias(f"_c_{n}") for n in sums]
    ends = cut.groupBy(key, "_slice").agg(*left)
    outer = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumns(
        {f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(outer) for n in lasts} | {f"_c_{n}": F.sum(f"_c_{n}").over(outer) for n in sums}
    ).filter("_slice > 0")
    both = near.join(carry, [key, "_slice"], "left")
    return both.select(
        *rows.columns, *[F.coalesce(f"_i_{n}", f"_c_{n}").alias(n) for n in lasts],
        *[(F.col(f"_i_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums],
    )


def admission_at(txns: DataFrame, toggles: DataFrame, alerts: DataFrame, limit: int, most: int = SLICED_ROWS, slices: int = SLICES) -> DataFrame:
    """txns (txn_id, user_id, timestamp) with the state at their time: is_frozen, pending, last_severity, decision and reason.

    toggles (user_id, at) flip the account, from then on; an alert (user_id, generated_at, resolved_at, severity) is pending
    after it was generated, and no longer from when it was resolved. Of the final tables only what had happened counts.
    """
    columns = "user_id", "at", "kind", "txn_id", "toggle", "open", "severity"
    none = F.lit(None)

    def part(df: DataFrame, at: str, kind: int, txn: Column = none, toggle: int = 0, opened: int = 0, severity: Column = none) -> DataFrame:
        rows = df.select("user_id", F.col(at).alias("at"), F.lit(kind), txn.cast("long"), F.lit(toggle), F.lit(opened), severity.cast("string"))
        return rows.toDF(*columns)

    was_open = alerts.filter("resolved_at IS NULL OR resolved_at > generated_at")
    events = (
        part(toggles, "at", 0, toggle=1).unionByName(part(was_open.filter("resolved_at IS NOT NULL"), "resolved_at", 0, opened=-1))
        .unionByName(part(txns, "timestamp", 1, F.col("txn_id"))).unionByName(part(was_open, "generated_at", 2, opened=1))
        .unionByName(part(alerts, "generated_at", 2, severity=F.col("severity")))
    )
    # severities of one time: the greatest name counts, so that order doesn't matter
    order = ["at", "kind", "severity", "txn_id", "toggle", "open"]
    state = carried(events, "user_id", order, {"last_severity": F.col("severity")}, {"toggles": F.col("toggle"), "pending": F.col("open")}, most=most, slices=slices)
    frozen = F.col("toggles") % 2 == 1
    reason = F.when(frozen, "frozen").when(F.col("pending") >= limit, "pending alerts")
    return state.filter("kind = 1").select(
        "txn_id", "user_id", F.col("at").alias("timestamp"), frozen.alias("is_frozen"), "pending", "last_severity",
        F.when(reason.isNull(), "admit").otherwise("block").alias("decision"), reason.alias("reason"),
    )
