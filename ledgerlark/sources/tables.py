"""Schemas, sources and sinks, and the views that map the star schema to fraud tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.columns import HIGH, MEDIUM, blank, parse_time, stable_key, text_or

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _schema(ddl: str) -> T.StructType:
    """A schema of "name type, .." without the session that Spark's own parser needs."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(","))])


TRANSACTIONS = _schema(
    "event_id long, transaction_id string, user_id long, amount double, tx_type string, timestamp timestamp, device_id string"
)
ALERTS = _schema(
    "alert_id string, user_id long, transaction_id string, score double, severity string, status string, message string, generated_at timestamp"
)
TRAINING = _schema(
    "TransactionAmt double, ProductCD string, card1 double, card2 double, card3 double, card4 string, card5 double, card6 string, "
    "addr1 double, addr2 double, P_emaildomain string, C1 double, C2 double, C13 double, isFraud int"
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def land_in_order(df: DataFrame, path: str, *keys: str) -> None:
    """Writes df to a new folder so that read_stream() takes its files, and so its rows, in order of keys.

    Streams take files by modification time: it is set to follow the order, and read back, as not
    every store keeps it.
    """
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def files() -> list:
        return sorted((x for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")), key=_place)

    found = files()
    if not found:
        return
    last = max(x.getModificationTime() for x in found)
    for k, x in enumerate(found):
        fs.setTimes(x.getPath(), last - 1000 * (len(found) - k), -1)
    times = [x.getModificationTime() for x in files()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise RuntimeError(f"{path}: the store keeps no modification times, so a stream can't take its files in order")


def _place(status) -> tuple[int, str]:
    """A part file's partition, and its name for the files of one partition."""
    name = status.getPath().getName()
    return int(name.split("-")[1]), name.rsplit("-", 1)[1]


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path: str) -> None:
    """A fitted model, or a table of trees, to a folder."""
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str, trees: bool = False):
    """What save_model() wrote: a table of trees, or the population model."""
    from pyspark.ml import PipelineModel

    return spark.read.parquet(path) if trees else PipelineModel.load(path)


def save_metadata(defaults: DataFrame, path: str) -> None:
    """The order of a model's columns and their defaults, a row each."""
    defaults.coalesce(1).write.mode("overwrite").parquet(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("pos")


def training_columns(df: DataFrame) -> DataFrame:
    """The fifteen columns that the baseline model is trained on, in their order; missing ones are null."""
    return conform(df, TRAINING)


def peek(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*order).limit(n)


def copy_table(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a table in a new one, as it reads back."""
    df.select(*columns).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.select(*columns).schema).parquet(path)


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] = {}) -> DataFrame:
    """df with the columns of schema: missing ones added, nulls replaced by defaults, types cast.

    Applying it again changes nothing; columns that schema doesn't name are dropped.
    """

    def one(f: T.StructField) -> Column:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        return (F.coalesce(c, F.lit(defaults[f.name])) if f.name in defaults else c).cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in schema])


_BODY = _schema("amount string, tx_type string, timestamp string, device_id string")


def parse_bodies(raw: DataFrame) -> DataFrame:
    """JSON request bodies (body, received_at) as the text payloads that validate_payloads() takes.

    A body that is null or no JSON counts as an empty one. A missing type is a withdrawal, a
    missing or empty time is when the body came.
    """
    b = F.from_json("body", _BODY, {"mode": "PERMISSIVE"})
    came = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss")
    rows = raw.select("*", b.alias("_b"))
    return rows.select(
        *[c for c in raw.columns if c != "body"],
        F.col("_b.amount").alias("amount"),
        F.coalesce("_b.tx_type", F.lit("withdraw")).alias("tx_type"),
        F.coalesce(F.nullif("_b.timestamp", F.lit("")), came).alias("timestamp"),
        F.col("_b.device_id").alias("device_id"),
    )


def validate_payloads(raw: DataFrame) -> DataFrame:
    """Raw text payloads (payload_id, amount, tx_type, timestamp, device_id) with what was parsed.

    A missing amount is 0 and a missing device empty; reject_reason names the first fault, and is
    null for a valid payload. NaN is no amount; negative ones pass.
    """
    amount = F.col("amount").try_cast("double")
    return (
        raw.withColumn("parsed_amount", F.when(F.col("amount").isNull(), 0.0).otherwise(amount))
        .withColumn("parsed_time", parse_time(F.col("timestamp")))
        .withColumn("device", text_or(F.col("device_id"), ""))
        .withColumn(
            "reject_reason",
            F.when(blank(F.col("tx_type")), "missing type")
            .when(F.col("parsed_amount").isNull() | F.isnan("parsed_amount"), "invalid amount")
            .when(F.col("parsed_time").isNull(), "invalid time"),
        )
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason IS NULL")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason IS NOT NULL")


def utc_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """Naive timestamps declared to be UTC, under a UTC session zone."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def naive_rows(df: DataFrame, *columns: str) -> DataFrame:
    """column and changed: how many values utc_timestamps() gives a zone."""
    naive = [c for c in columns if isinstance(df.schema[c].dataType, T.TimestampNTZType)]
    counts = df.agg(*[F.count(c if c in naive else F.lit(None)).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in columns])))


def api_records(df: DataFrame, *times: str) -> DataFrame:
    """Rows as JSON, with ISO timestamps; null fields are left out."""
    shown = df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in times})
    return shown.select(F.to_json(F.struct(*shown.columns)).alias("record"))


def with_latency(scored: DataFrame) -> DataFrame:
    """scored with latency_ms between ingested_at and scored_at."""
    return scored.withColumn(
        "latency_ms", (F.unix_micros("scored_at") - F.unix_micros("ingested_at")) / F.lit(1000.0)
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_id").cast("string").alias("transaction_id"),
        "user_id",
        F.col("value").alias("amount"),
        F.when(F.col("event_type").isin("purchase", "signup"), "Deposit")
        .when(F.col("event_type") == "error", "transfer")
        .otherwise("withdraw")
        .alias("tx_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(k % 11 != 0, F.concat(F.lit("device_"), (k % 5 + 1).cast("string"))).alias("device_id"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lower(F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@example.com"))).alias("email"),
        (F.col("c_acctbal") < 0).alias("is_frozen"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("o_totalprice") / 500000.0
    unknown = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("alert_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(~unknown, F.col("o_orderkey")).alias("transaction_id"),
        score.alias("score"),
        F.when(unknown, None).when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low").alias("severity"),
        F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Resolved").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("generated_at"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_linestatus = 'F'")
        .groupBy(F.col("l_orderkey").alias("alert_id"))
        .agg(
            F.max((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).alias("is_fraud"),
            F.max(F.col("l_shipdate").cast("timestamp")).alias("labeled_at"),
        )
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label events: analysts may judge an alert more than once."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("alert_id"),
        (F.col("l_returnflag") == "R").alias("is_fraud"),
        F.col("l_suppkey").alias("labeled_by"),
        F.col("l_shipdate").cast("timestamp").alias("labeled_at"),
        F.col("l_partkey").alias("seq"),
    )


def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_linenumber = 7 AND l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("alert_id"))
        .agg(F.min(F.when(F.col("l_linestatus") == "O", "Open").otherwise("Resolved")).alias("status"))
    )


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("txn_id"),
            F.col("o_orderdate").cast("timestamp").alias("txn_dt"),
            F.col("o_totalprice").alias("amt"),
            F.substring("o_orderpriority", 1, 1).alias("product_cd"),
            F.when(F.col("c_mktsegment") != "FURNITURE", F.lower("c_mktsegment")).alias("card4"),
            F.when(nation % 7 != 0, nation.cast("double")).alias("addr1"),
            (F.col("o_custkey") % 10).cast("double").alias("c1"),
            ((F.col("o_totalprice") > 450000) & (F.col("o_orderstatus") == "F")).cast("int").alias("is_fraud"),
        )
    )


#: The same views for DuckDB, as common table expressions.
VIEWS = {
    "v_transactions": """SELECT event_id, event_id::VARCHAR AS transaction_id, user_id, value AS amount,
  CASE WHEN event_type IN ('purchase','signup') THEN 'Deposit' WHEN event_type = 'error' THEN 'transfer' ELSE 'withdraw' END AS tx_type,
  ts AS timestamp, CASE WHEN json_extract_string(props, '$.k')::INT % 11 = 0 THEN NULL
    ELSE concat('device_', (json_extract_string(props, '$.k')::INT % 5 + 1)::VARCHAR) END AS device_id FROM events""",
    "v_users": """SELECT c_custkey AS id, c_name AS name, lower(concat(replace(c_name, '#', '.'), '@example.com')) AS email,
  c_acctbal < 0 AS is_frozen FROM customer""",
    "v_alerts": """SELECT o_orderkey AS alert_id, o_custkey AS user_id,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderkey END AS transaction_id, o_totalprice / 500000.0 AS score,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_totalprice / 500000.0 >= 0.8 THEN 'High'
    WHEN o_totalprice / 500000.0 >= 0.5 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Resolved' END AS status, o_orderdate AS generated_at FROM orders""",
    "v_labels": """SELECT l_orderkey AS alert_id, max(CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 1 ELSE 0 END) = 1 AS is_fraud,
  max(l_shipdate) AS labeled_at FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey""",
    "v_feedback": """SELECT l_orderkey AS alert_id, l_returnflag = 'R' AS is_fraud, l_suppkey AS labeled_by, l_shipdate AS labeled_at,
  l_partkey AS seq FROM lineitem""",
    "v_disputes": """SELECT l_orderkey AS alert_id, min(CASE WHEN l_linestatus = 'O' THEN 'Open' ELSE 'Resolved' END) AS status
  FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R' GROUP BY l_orderkey""",
    "v_training": """SELECT o_orderkey AS txn_id, o_orderdate AS txn_dt, o_totalprice AS amt, substr(o_orderpriority, 1, 1) AS product_cd,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE lower(c_mktsegment) END AS card4,
  CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE c_nationkey::DOUBLE END AS addr1, (o_custkey % 10)::DOUBLE AS c1,
  CASE WHEN o_totalprice > 450000 AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_fraud
  FROM orders JOIN customer ON o_custkey = c_custkey""",
}
