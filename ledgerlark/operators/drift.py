"""Drift of many features over many periods in one scan, and isotonic recalibration from mergeable counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.ranks import quantiles

GRID, BINS, FLOOR = 100, 10, 1e-4


def drift_table(rows: DataFrame, features: list[str], period: Column, reference: Column, grid: int = GRID, bins: int = BINS) -> DataFrame:
    """feature, period, n, psi and ks of each feature in each period against the reference rows.

    The reference's quantiles at each 1 / grid cut a feature's values; one scan counts all features' cells by
    period. psi takes `bins` cells of equal share of the reference, ks the greatest distance of the distributions at the
    cuts, which is at most 1 / grid below the one over all values where the reference has no ties. Nulls don't count.
    """
    if grid % bins:
        raise ValueError("bins have to divide the grid")
    shares = [k / grid for k in range(1, grid)]
    found = quantiles(rows.filter(reference), {f: F.col(f) for f in features}, shares)
    cuts = found.agg(F.map_from_entries(F.collect_list(F.struct("column", "quantiles"))).alias("_cuts"))  # one row, as many entries as features

    def cell(f: str) -> Column:
        x = F.col(f).cast("double")
        return F.when(x.isNotNull(), F.size(F.filter(F.col("_cuts")[f], lambda c: c < x)))

    cells = [F.struct(F.lit(f).alias("feature"), cell(f).alias("cell")) for f in features]
    counted = (
        rows.crossJoin(F.broadcast(cuts)).select(period.alias("period"), reference.alias("_r"), F.explode(F.array(*cells)).alias("_c"))
        .select("period", F.coalesce("_r", F.lit(False)).alias("_r"), "_c.*").filter("cell IS NOT NULL")
        .groupBy("period", "feature", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("_r").alias("e"))
    )
    # from here on there is at most a row for each cell of a feature and period
    expected = counted.groupBy("feature", "cell").agg(F.sum("e").alias("e"))
    periods = counted.select("period", "feature").distinct()
    every = periods.join(expected, "feature").join(counted.drop("e"), ["period", "feature", "cell"], "left").na.fill(0, ["n"])
    one = Window.partitionBy("period", "feature")
    upto = one.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    shared = every.withColumns({
        "_n": F.sum("n").over(one), "_far": F.abs(F.sum("n").over(upto) / F.sum("n").over(one) - F.try_divide(F.sum("e").over(upto), F.sum("e").over(one))),
    })
    coarse = shared.groupBy("period", "feature", F.floor(F.col("cell") * bins / grid).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("e").alias("e"), F.max("_far").alias("far"), F.first("_n").alias("total")
    )
    a, e = (F.greatest(F.try_divide(F.col(c), F.sum(c).over(one)), F.lit(FLOOR)) for c in ("n", "e"))
    parts = coarse.withColumn("part", (a - e) * F.ln(a / e))
    return parts.groupBy("feature", "period").agg(F.first("total").alias("n"), F.sum("part").alias("psi"), F.max("far").alias("ks"))


RESOLUTION = 1000


def score_cell(score: Column, resolution: int = RESOLUTION) -> Column:
    """A score from 0 to 1 as a whole number of resolution-ths; null for a null one."""
    return F.when(score.isNotNull(), F.least(F.greatest(F.floor(score * resolution), F.lit(0)), F.lit(resolution - 1)).cast("int"))


def isotonic_blocks(rows: DataFrame, label: str = "label", score: str = "score", resolution: int = RESOLUTION) -> DataFrame:
    """low, high, n and rate of the blocks of cells with the non-decreasing rates nearest to the labels in squares.

    Labels are counted by score cell, which is what tasks send; at most `resolution` cells then meet, and neighbours that
    are out of order are pooled. Rows without a score or label don't count.
    """
    counts = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score_cell(F.col(score), resolution).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")
    )

    def pool(cells: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[int]] = []
        for cell, n, p in cells.sort_values("cell")[["cell", "n", "p"]].itertuples(index=False):
            blocks.append([int(cell), int(cell), int(n), int(p)])
            # whole numbers decide, so that equal rates are equal
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                low, _, n1, p1 = blocks[-2]
                _, high, n2, p2 = blocks.pop()
                blocks[-1] = [low, high, n1 + n2, p1 + p2]
        return pd.DataFrame([(a, b, n, p / n) for a, b, n, p in blocks], columns=["low", "high", "n", "rate"])

    return counts.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(pool, "low int, high int, n long, rate double")


def recalibrated(rows: DataFrame, blocks: DataFrame, score: str = "score", resolution: int = RESOLUTION) -> DataFrame:
    """rows with calibrated: the rate of the score's block; a score between two blocks has the lower one's, one below all has the first's."""
    until = F.coalesce(F.lead("low").over(Window.orderBy("low")), F.lit(resolution)) - 1  # at most `resolution` rows
    ranges = blocks.withColumn("_until", until).withColumn("_from", F.when(F.row_number().over(Window.orderBy("low")) == 1, 0).otherwise(F.col("low")))
    cells = ranges.select(F.explode(F.sequence("_from", "_until")).alias("_cell"), F.col("rate").alias("calibrated"))
    return rows.withColumn("_cell", score_cell(F.col(score), resolution)).join(F.broadcast(cells), "_cell", "left").drop("_cell")
