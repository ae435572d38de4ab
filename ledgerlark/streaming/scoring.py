"""Models inside a stream: each micro-batch meets the last published version, retraining follows growth."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import columns as C
from ledgerlark.operators import behaviour, models, scoring, workflow
from ledgerlark.sources import files
from ledgerlark.sources.registry import ModelRegistry

def model_inputs(features: DataFrame) -> DataFrame:
    """Rows of stream_features() with the features that a row alone decides."""
    return features.withColumns(
        {"log_amount": C.log_amount(F.col("amount")), "hour": F.hour("timestamp"), "weekday": C.weekday(F.col("timestamp"))}
    )


def score_with(rows: DataFrame, registry: ModelRegistry, version: int) -> DataFrame:
    """rows (FEATURES, is_extreme) with the verdict of a version's models: batch and stream alike.

    A user without a forest has the population's score, and a version without any model leaves the
    extreme-amount rule alone. Only the forests of the users in rows are read.
    """
    forests, population = registry.forests(version, rows), registry.population(version)
    none = F.lit(None).cast("double")
    if forests is None:
        personal = rows.select("event_id", none.alias("personal"), none.cast("boolean").alias("personal_anomaly"))
    else:
        personal = models.score_forests(rows, forests)
    if population is None:
        general = rows.select("event_id", none.alias("population"))
    else:
        model, defaults = population
        names = [r["column"] for r in defaults.orderBy("pos").collect()]
        vectors = scoring.default_vector(rows.select("event_id", F.col("amount").alias("_amount")), defaults, amount="_amount")
        general = models.score_population(vectors, model, names)
    return scoring.decided(rows, personal, general).withColumn("version", F.lit(version))


def pinned(registry: ModelRegistry, folder: str, batch: int) -> int:
    """The version that a batch is scored by: the last one when it was first tried, and the same when it is tried again."""
    at = f"{folder}/pins/{batch}.json"
    if not files.exists(registry.spark, at):
        files.write_once(registry.spark, at, json.dumps(registry.latest()))
    return json.loads(files.read(registry.spark, at))


def model_sink(registry: ModelRegistry, folder: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for model_inputs(): features, then scored rows, then alerts, each in its batch's folder.

    Features are written before models read them, so that keyed state is asked once. A replayed batch
    overwrites its own folders with the same version's scores. then gets the scored rows at the end.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        spark, version = rows.sparkSession, pinned(registry, folder, batch)
        at = f"{folder}/features/batch={batch}"
        rows.write.mode("overwrite").parquet(at)
        kept = spark.read.schema(rows.schema).parquet(at)
        at = f"{folder}/scored/batch={batch}"
        scored = score_with(kept, registry, version)
        scored.write.mode("overwrite").parquet(at)
        scored = spark.read.schema(scored.schema).parquet(at)
        workflow.raised_alerts(scored).write.mode("overwrite").parquet(f"{folder}/alerts/batch={batch}")
        if then:
            then(scored, batch)

    return sink


def grown(scored: DataFrame, registry: ModelRegistry, least: int = C.TRAIN_ROWS) -> DataFrame:
    """user_id and n of a micro-batch's users who now have enough rows, and more than their forest was trained on.

    The stream's own count of earlier rows tells it, so that nobody's history is counted again.
    """
    counts = scored.groupBy("user_id").agg((F.max("prior_count") + 1).alias("n"))
    trained = registry.trained().select("user_id", "n_rows")
    return counts.join(trained, "user_id", "left").filter((F.col("n") >= least) & (F.col("n") > F.coalesce("n_rows", F.lit(0)))).select("user_id", "n")


def retrain(registry: ModelRegistry, txns: DataFrame, contamination: DataFrame | None = None, trees: int = models.TREES) -> int | None:
    """Publishes forests of the users that workflow.train_triggers() names, and of nobody else; None if it names nobody."""
    due = workflow.train_triggers(txns.filter("timestamp IS NOT NULL"), registry.trained().select("user_id", "n_rows")).select("user_id")
    if due.isEmpty():
        return None
    features = behaviour.behaviour_features(txns.join(due, "user_id", "left_semi"))
    return registry.publish(forests=models.train_forests(features, contamination, trees))


def retraining(
    registry: ModelRegistry, history: Callable[[], DataFrame], contamination: DataFrame | None = None, growth: float = 1.0, trees: int = models.TREES
) -> Callable[[DataFrame, int], None]:
    """A step for the end of model_sink(): after each micro-batch, forests of its users who have grown() are published.

    history gives all transactions; only those users' ones until the batch's last time are read. A user has to have `growth` times as many rows
    as the forest in use was trained on, so that it's up to the caller how often that is. A replayed batch finds its users trained.
    """

    def then(scored: DataFrame, batch: int) -> None:
        trained = registry.trained().select("user_id", "n_rows")
        due = grown(scored, registry).join(trained, "user_id", "left").filter(F.col("n") >= growth * F.coalesce("n_rows", F.lit(0))).select("user_id")
        if due.isEmpty():
            return
        last = scored.agg(F.max("timestamp")).first()[0]
        features = behaviour.behaviour_features(history().filter(F.col("timestamp") <= F.lit(last)).join(due, "user_id", "left_semi"))
        registry.publish(forests=models.train_forests(features, contamination, trees))

    return then
