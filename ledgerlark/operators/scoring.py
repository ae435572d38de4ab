"""How a personal score, a population score and the extreme-amount rule become one verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import columns as C


def ensemble(rows: DataFrame) -> DataFrame:
    """rows (personal, personal_anomaly, population, is_extreme) with score, is_anomaly and severity.

    Both scores are averaged and either stands alone; anomaly is what the personal model says,
    or without one a population score of Medium. An extreme amount is always an anomaly and
    lifts the score to at least EXTREME_SCORE.
    """
    p, g = F.col("personal"), F.col("population")
    base = F.when(p.isNotNull() & g.isNotNull(), 0.5 * p + 0.5 * g).otherwise(F.coalesce(p, g))
    anomaly = F.when(p.isNotNull(), F.coalesce("personal_anomaly", F.lit(False))).otherwise(
        F.coalesce(g >= C.MEDIUM, F.lit(False))
    )
    score = F.when(F.col("is_extreme"), F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(C.EXTREME_SCORE))).otherwise(base)
    return rows.withColumns({"score": score, "is_anomaly": anomaly | F.col("is_extreme")}).withColumn(
        "severity", C.severity(F.col("score"))
    )


def decided(txns: DataFrame, personal: DataFrame, population: DataFrame) -> DataFrame:
    """txns (event_id, is_extreme) with the verdict of the personal model where the user has one, else of the population's.

    personal has event_id, personal and personal_anomaly, population event_id and population; a row
    that neither knows is judged by the extreme-amount rule alone.
    """
    rows = txns.join(personal.select("event_id", "personal", "personal_anomaly"), "event_id", "left")
    return ensemble(rows.join(population.select("event_id", "population"), "event_id", "left"))


def fused(views: dict[str, float]) -> Column:
    """The weighted mean of the view columns that are present; null without any."""
    top = [F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in views.items()]
    low = [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in views.items()]
    weight = reduce(Column.__add__, low)
    return F.when(weight > 0, reduce(Column.__add__, top) / weight)


def disagreement(*views: str) -> Column:
    """The range of the view columns that are present."""
    cols = [F.col(v) for v in views]
    return F.greatest(*cols) - F.least(*cols)


def default_vector(rows: DataFrame, defaults: DataFrame, amount: str = "amt") -> DataFrame:
    """rows with a column for each of defaults (pos, column, default), the amount overwritten.

    defaults has a row for each model feature, so it is small; it becomes literals.
    """
    found = defaults.orderBy("pos").collect()
    have = set(rows.columns)
    return rows.select(
        *rows.columns,
        *[
            (F.col(amount) if r["column"] == "TransactionAmt" else F.lit(r["default"] if r["default"] is not None else 0.0)).alias(r["column"])
            for r in found
            if r["column"] not in have
        ],
    )
