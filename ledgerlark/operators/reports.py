"""Summary tables for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.columns import signed_amount
from ledgerlark.operators.ranks import quantiles


def latest(df: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """Each user's n latest rows; the larger key first among equal times."""
    w = Window.partitionBy("user_id").orderBy(F.desc(time), F.desc(key))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _of(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.lower("tx_type") == kind, F.col("amount"))), F.lit(0.0))


def totals(txns: DataFrame) -> DataFrame:
    """Deposits, withdrawals and their balance; other types count as neither."""
    return txns.groupBy("user_id").agg(
        _of("deposit").alias("deposits"),
        _of("withdraw").alias("withdrawals"),
        (_of("deposit") - _of("withdraw")).alias("balance"),
        F.count(F.lit(1)).alias("n"),
    )


def daily_amounts(txns: DataFrame) -> DataFrame:
    """user_id, day, deposit and withdraw amounts in any spelling, 0 on a day that has only the other."""
    kinds = ["deposit", "withdraw"]
    return (
        txns.withColumn("kind", F.lower("tx_type"))
        .filter(F.col("kind").isin(kinds))
        .groupBy("user_id", F.to_date("timestamp").alias("day"))
        .pivot("kind", kinds)
        .agg(F.sum("amount"))
        .na.fill(0.0)
    )


def alert_breakdown(alerts: DataFrame) -> DataFrame:
    """Counts per severity and status, zero-filled; other values, null too, are in no bucket."""

    def count(column: str, value: str) -> Column:
        return F.count(F.when(F.col(column) == value, 1)).alias(value.lower())

    return alerts.groupBy("user_id").agg(
        *[count("severity", v) for v in ("High", "Medium", "Low")], *[count("status", v) for v in ("Pending", "Resolved")]
    )


def case_filter(alerts: DataFrame, status: str = "all", severity: str = "all") -> DataFrame:
    """Alerts of a status and severity, either of them "all"; a null severity shows as Medium."""
    shown = alerts.withColumn("severity", F.coalesce("severity", F.lit("Medium")))
    if status != "all":
        shown = shown.filter(F.col("status") == status)
    return shown if severity == "all" else shown.filter(F.col("severity") == severity)


def displayed(txns: DataFrame) -> DataFrame:
    """Rows as shown: date text and signed amount."""
    return txns.select(
        "transaction_id", "user_id", "tx_type",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("shown_at"),
        signed_amount(F.col("amount"), F.col("tx_type")).alias("signed_amount"),
        F.coalesce("device_id", F.lit("")).alias("device"),
    )


def ordered_history(df: DataFrame, time: str, key: str, path: str) -> DataFrame:
    """Each user's rows from old to new with their position, written in this order."""
    w = Window.partitionBy("user_id").orderBy(time, key)
    df.withColumn("position", F.row_number().over(w)).sortWithinPartitions("user_id", "position").write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def latency_summary(scored: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    """Mean, median, least and greatest latency_ms and, given the elapsed time, rows a second."""
    middle = quantiles(scored, {"ms": F.col("latency_ms")}, [0.5]).select(F.col("quantiles")[0].alias("median"))
    return scored.agg(
        F.count("latency_ms").alias("n"), F.avg("latency_ms").alias("mean"),
        F.min("latency_ms").alias("least"), F.max("latency_ms").alias("greatest"),
        (F.count("latency_ms") / F.lit(elapsed_s)).alias("per_second"),
    ).crossJoin(F.broadcast(middle)).select("n", "mean", "median", "least", "greatest", "per_second")
