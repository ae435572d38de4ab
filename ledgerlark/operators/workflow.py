"""Alerts and what follows them: gates, feedback, disputes, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import columns as C


def _rename(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select("alert_id", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def raised_alerts(scored: DataFrame) -> DataFrame:
    """Alert rows of scored (transaction_id, user_id, tx_type, score, is_anomaly): anomalies that
    have a score of Medium or more. Ids are stable, so that a replay raises none twice."""
    return (
        scored.withColumn("severity", C.severity(F.col("score")))
        .filter("is_anomaly AND score IS NOT NULL AND severity IN ('Medium', 'High')")
        .select(
            C.stable_key(F.col("user_id"), F.col("transaction_id"), F.lit("score")).alias("alert_id"),
            "user_id", "transaction_id", "score", "severity", F.lit("Pending").alias("status"),
            C.alert_message(F.col("score"), F.lower("tx_type")).alias("message"),
        )
    )


def alerts_with_label(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    return alerts.join(_rename(labels, "label", "is_fraud", "labeled_at"), "alert_id", "left")


def alerts_with_dispute(alerts: DataFrame, disputes: DataFrame) -> DataFrame:
    return alerts.join(_rename(disputes, "dispute", "status"), "alert_id", "left")


def visible(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """The requested (requester, alert_id) alerts that belong to the requester."""
    return requests.join(alerts, (requests["alert_id"] == alerts["alert_id"]) & (F.col("requester") == F.col("user_id"))).select(
        "requester", alerts["*"]
    )


def admission(users: DataFrame, alerts: DataFrame) -> DataFrame:
    """user_id, pending, decision and reason: frozen accounts and too many pending alerts block."""
    pending = alerts.filter("status = 'Pending'").groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"))
    reason = F.when(F.col("is_frozen"), "frozen").when(F.col("pending") >= C.PENDING_LIMIT, "pending alerts")
    return (
        users.select(F.col("id").alias("user_id"), "is_frozen")
        .join(pending, "user_id", "left")
        .withColumn("pending", F.coalesce("pending", F.lit(0)))
        .withColumn("reason", reason)
        .withColumn("decision", F.when(F.col("reason").isNull(), "admit").otherwise("block"))
    )


def contamination(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Per user with labels: their number, fraud rate and the forest's contamination."""
    rate = F.avg(F.col("is_fraud").cast("double"))
    return (
        labels.join(alerts.select("alert_id", "user_id"), "alert_id")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_labels"), rate.alias("fraud_rate"))
        .withColumn(
            "contamination",
            F.when(F.col("n_labels") < C.CONTAMINATION_LABELS, C.CONTAMINATION).otherwise(
                C.clamp(F.col("fraud_rate"), C.CONTAMINATION_LOW, C.CONTAMINATION_HIGH)
            ),
        )
    )


def current_labels(events: DataFrame) -> DataFrame:
    """The latest label event of each alert; later columns break ties of time, larger first."""
    order = [F.desc("labeled_at"), F.desc("seq"), F.desc("labeled_by"), F.desc("is_fraud")]
    w = Window.partitionBy("alert_id").orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_status(alerts: DataFrame, resolutions: DataFrame, labels: DataFrame) -> DataFrame:
    """Alerts with the status that resolutions (alert_id) and labels imply: either resolves."""
    done = resolutions.select("alert_id").unionByName(labels.select("alert_id")).distinct().withColumn("_done", F.lit(True))
    return (
        alerts.join(done, "alert_id", "left")
        .withColumn("status", F.when(F.col("_done"), "Resolved").otherwise(F.col("status")))
        .drop("_done")
    )


def freeze_state(toggles: DataFrame) -> DataFrame:
    """user_id and is_frozen: an odd number of toggles."""
    return toggles.groupBy("user_id").agg((F.count(F.lit(1)) % 2 == 1).alias("is_frozen"))


def insert_absent(new: DataFrame, existing: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row, by order, of each key in new that existing hasn't: one dispute an alert, one user an email."""
    w = Window.partitionBy(key).orderBy(*order)
    return (
        new.join(existing.select(key), key, "left_anti")
        .withColumn("_n", F.row_number().over(w))
        .filter("_n = 1")
        .drop("_n")
    )


def backlog(txns: DataFrame, scored: DataFrame) -> DataFrame:
    return txns.join(scored.select("transaction_id"), "transaction_id", "left_anti")


def write_back(txns: DataFrame, scored: DataFrame) -> DataFrame:
    """txns with fraud_score, scored_at and whether they are scored."""
    got = scored.select("transaction_id", F.col("score").alias("fraud_score"), "scored_at")
    return txns.join(got, "transaction_id", "left").withColumn("scored", F.col("scored_at").isNotNull())


def outbox(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """One row per message: email for Medium and High alerts, SMS for High ones as well.

    Users that are unknown leave the address null. The key is stable, so a replay writes the
    same messages.
    """
    channels = F.when(F.col("severity") == "High", F.array(F.lit("email"), F.lit("sms"))).otherwise(F.array(F.lit("email")))
    return (
        alerts.filter("severity IN ('Medium', 'High')")
        .join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left")
        .withColumn("channel", F.explode(channels))
        .withColumn("message_id", C.stable_key(F.col("alert_id"), F.col("channel")))
        .withColumn("subject", F.concat(F.col("severity"), F.lit(" severity alert")))
    )


def train_triggers(txns: DataFrame, trained: DataFrame, least: int = C.TRAIN_ROWS) -> DataFrame:
    """Users with enough rows, and more than their model was trained on (user_id, n_rows)."""
    counts = txns.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(trained, "user_id", "left").filter(
        (F.col("n") >= least) & (F.col("n") > F.coalesce("n_rows", F.lit(0)))
    )
