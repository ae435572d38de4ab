"""Walk-forward folds that no label crosses, and the assertion that nothing leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.ranks import quantiles


def walk_forward(rows: DataFrame, time: str, known: str, folds: int = 4, embargo_days: int = 7) -> DataFrame:
    """rows once for each fold that they take part in, with fold (from 1) and role.

    Quantiles of time cut folds + 1 periods; fold k tests on period k + 1 and trains on rows before it whose label was known
    embargo_days before it begins. The rest is purged. Rows without a time or whose label isn't known train nothing.
    """
    micros = F.unix_micros(time)
    cuts = quantiles(rows, {"t": micros}, [k / (folds + 1) for k in range(1, folds + 1)]).first().quantiles
    if cuts[0] is None:
        return rows.limit(0).withColumns({"fold": F.lit(1), "role": F.lit("test")})
    parts = []
    for k, cut in enumerate(cuts, 1):
        after = F.lit(cut)
        before_next = F.lit(True) if k == folds else micros < F.lit(cuts[k])
        trains = (micros < after) & (F.unix_micros(known) + embargo_days * 86_400_000_000 < after)
        role = F.when((micros >= after) & before_next, "test").when(trains, "train")
        parts.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    return rows.select("*", F.inline(F.array(*parts))).filter("role IS NOT NULL")


def leaks(assigned: DataFrame, entity: str, time: str, known: str) -> DataFrame:
    """The train rows of each fold whose label became known only after a test row of the same entity began.

    assigned has fold and role. A fold and entity's first test row is all that train rows have to meet, so that no
    pairs are made; a label that never became known counts as known after everything.
    """
    first = assigned.filter("role = 'test'").groupBy("fold", entity).agg(F.min(time).alias("_first"))
    trains = assigned.filter("role = 'train'").join(first, ["fold", entity])
    return trains.filter(F.col(known).isNull() | (F.col(known) >= F.col("_first"))).drop("_first")
