"""Training data: profiles, imputation, encoding, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.operators.ranks import quantiles


def numeric_columns(df: DataFrame, *but: str) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in but]


def text_columns(df: DataFrame, *but: str) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in but]


def _long(df: DataFrame, aggregates: dict[str, dict[str, Column]]) -> DataFrame:
    """One pass over df for every column's aggregates, as rows (column, ...)."""
    row = df.agg(
        *[F.struct(*[a.alias(n) for n, a in named.items()]).alias(c) for c, named in aggregates.items()]
    )
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}.{n}").alias(n) for n in named]) for c, named in aggregates.items()]))
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """column, missing and share."""
    n = F.count(F.lit(1))
    return _long(df, {c: {"missing": F.count_if(F.col(c).isNull()), "share": F.try_divide(F.count_if(F.col(c).isNull()), n)} for c in df.columns})


def table_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("names"))


def impute(df: DataFrame, fit_on: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Numbers by the median of fit_on, or of df, and texts by "unknown"."""
    numbers = numeric_columns(df, *skip)
    fitted = quantiles(fit_on if fit_on is not None else df, {c: F.col(c) for c in numbers}, [0.5]).collect() if numbers else []
    medians = {c: q[0] for c, q in fitted if q[0] is not None}  # a row for each column
    return df.na.fill(medians).na.fill("unknown", text_columns(df, *skip)) if medians else df.na.fill("unknown", text_columns(df, *skip))


def one_hot(df: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """0/1 columns named column_value in order of values; a null has none.

    A column may have `most` values; the distinct ones are looked up, no more than that.
    """
    out: list[Column] = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        values = [r[0] for r in df.filter(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} values")
        out += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in values]
    return df.select(*out)


def feature_defaults(df: DataFrame, columns: list[str]) -> DataFrame:
    """pos, column, binary and default: a 0/1 column's most frequent value, the lower on a tie, else the median."""
    binary = {c: F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)) == 0 for c in columns}
    ones = {c: F.count_if(F.col(c) == 1) - F.count_if(F.col(c) == 0) for c in columns}
    kinds = _long(df, {c: {"pos": F.lit(k), "binary": binary[c], "more": ones[c]} for k, c in enumerate(columns)})
    middle = F.col("quantiles")[0]  # null where all are
    mode = F.when(middle.isNotNull(), (F.col("more") > 0).cast("double"))
    return kinds.join(quantiles(df, {c: F.col(c) for c in columns}, [0.5]), "column").select(
        "column", "pos", "binary", F.when(F.col("binary"), mode).otherwise(middle).alias("default")
    )


def class_profile(df: DataFrame, label: str) -> DataFrame:
    """One row: rows, positives, negatives, their percentage and the positives' weight."""
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).cast("long").alias("positives"),
        F.sum(1 - y).cast("long").alias("negatives"),
        (F.avg(y) * 100).alias("percent"),
        (F.sum(1 - y) / F.nullif(F.sum(y), F.lit(0))).alias("weight"),
    )


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: the share of each class whose keys hash lowest.

    Ranking a class in one window would put a class in one task, so rows are ranked inside
    slices of their hash and slices are offset by the counts before them.
    """
    slices = 256
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    rows = df.withColumn("_h", h).withColumn("_s", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    counts = rows.groupBy(label, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(label).alias("_l"), F.col("_s").alias("_s2"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(label)).alias("_total"),
    )
    inside = Window.partitionBy(label, "_s").orderBy("_h", key)
    return (
        rows.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(offsets), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_s2")))  # slices x classes rows
        .withColumn("is_test", F.col("_offset") + F.col("_r") <= F.floor(F.lit(share) * F.col("_total")))
        .select(*df.columns, "is_test")
    )


def time_split(df: DataFrame, time: str, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """df with split: train before the first cut of time, valid before the second, then test."""
    cuts = quantiles(df, {time: F.unix_micros(time)}, [train, train + valid]).select(F.col("quantiles").alias("_c"))
    t = F.unix_micros(time)
    return (
        df.crossJoin(F.broadcast(cuts))  # one row
        .withColumn("split", F.when(t < F.col("_c")[0], "train").when(t < F.col("_c")[1], "valid").otherwise("test"))
        .drop("_c")
    )


def labels_known(labels: DataFrame, as_of: Column) -> DataFrame:
    """Labels that had been given by as_of."""
    return labels.filter(F.col("labeled_at") <= as_of)


def with_identity(txns: DataFrame, identity: DataFrame, key: str) -> DataFrame:
    """txns with the identity row of their key, if any, and has_identity."""
    found = identity.withColumn("has_identity", F.lit(True))
    return txns.join(found, key, "left").withColumn("has_identity", F.coalesce("has_identity", F.lit(False)))


def entity_key(*columns: str) -> Column:
    """A customer id rebuilt from card, address and account-start columns; nulls count as empty."""
    return F.sha2(F.concat_ws("~", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
