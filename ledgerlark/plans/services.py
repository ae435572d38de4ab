"""Queries of the request, alert, model and stream services over the star schema, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions import columns as C
from ledgerlark.operators import asof, behaviour, evaluation, models, preparation, reports, scoring, workflow
from ledgerlark.plans.queries import (
    _CONFUSION, _DAILY, _SCORED, _W, _scored, _shared, day, keyed_state, query, r6, text,
)
from ledgerlark.sources import tables as S
from ledgerlark.sources.registry import ModelRegistry
from ledgerlark.sources.upserts import UpsertTable
from ledgerlark.streaming import jobs
from ledgerlark.streaming import scoring as live

#: Request bodies, some of them faulty: no type, no time, no number, no JSON.
_BODIES = """SELECT event_id, user_id, ts AS received_at, CASE
  WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'no json' WHEN event_type = 'error' AND event_id % 3 = 1 THEN NULL
  WHEN event_type = 'error' THEN '{"amount": "much", "tx_type": "deposit"}'
  WHEN event_type = 'click' THEN '{"amount": ' || CAST(event_id % 500 AS VARCHAR) || ', "device_id": " device_1 "}'
  WHEN event_type = 'view' THEN '{"tx_type": "deposit", "timestamp": "yesterday"}'
  ELSE '{"amount": ' || CAST(event_id % 700 AS VARCHAR) || ', "tx_type": "deposit", "timestamp": "' || {time} || '"}' END AS body FROM events"""
_BODIES_DUCK = _BODIES.replace("{time}", "strftime(ts, '%Y-%m-%dT%H:%M:%S')")


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    events = S.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("received_at"))
    kind, number = F.col("event_type"), F.col("event_id")
    time = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss")
    body = (
        F.when((kind == "error") & (number % 3 == 0), "no json").when((kind == "error") & (number % 3 == 1), None)
        .when(kind == "error", '{"amount": "much", "tx_type": "deposit"}')
        .when(kind == "click", F.concat(F.lit('{"amount": '), (number % 500).cast("string"), F.lit(', "device_id": " device_1 "}')))
        .when(kind == "view", '{"tx_type": "deposit", "timestamp": "yesterday"}')
        .otherwise(F.concat(F.lit('{"amount": '), (number % 700).cast("string"), F.lit(', "tx_type": "deposit", "timestamp": "'), time, F.lit('"}')))
    )
    return events.select("event_id", "user_id", "received_at", body.alias("body"))


_PARSED = f"""b AS ({_BODIES_DUCK}), j AS (SELECT *, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS o FROM b),
q AS (SELECT event_id, user_id, json_extract_string(o, '$.amount') AS amount, coalesce(json_extract_string(o, '$.tx_type'), 'withdraw') AS tx_type,
  coalesce(json_extract_string(o, '$.timestamp'), strftime(received_at, '%Y-%m-%dT%H:%M:%S')) AS t, coalesce(trim(json_extract_string(o, '$.device_id')), '') AS device FROM j),
v AS (SELECT *, CASE WHEN amount IS NULL THEN 0 ELSE try_cast(amount AS DOUBLE) END AS parsed_amount, try_strptime(t, '%Y-%m-%dT%H:%M:%S') AS parsed_time FROM q)"""


@query(f"""WITH {_PARSED} SELECT event_id, user_id, tx_type, device, round(parsed_amount, 6) AS parsed_amount, strftime(parsed_time, '%Y-%m-%d %H:%M:%S') AS parsed_time,
  CASE WHEN parsed_amount IS NULL THEN 'invalid amount' WHEN parsed_time IS NULL THEN 'invalid time' END AS reject_reason FROM v""")
def json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.validate_payloads(S.parse_bodies(_bodies(spark, sf)))
    return rows.select("event_id", "user_id", "tx_type", "device", r6("parsed_amount"), text("parsed_time"), "reject_reason")


_RAISED = "SELECT o_custkey AS user_id, o_orderkey AS transaction_id, lower(o_orderstatus) AS kind, round(o_totalprice / 500000.0, 2) AS score, o_totalprice > 300000 AS is_anomaly FROM orders"


@query(f"""WITH s AS ({_RAISED})
SELECT sha256(concat_ws('~', user_id::VARCHAR, transaction_id::VARCHAR, 'score')) AS alert_id, user_id, transaction_id, CASE WHEN score >= 0.8 THEN 'High' ELSE 'Medium' END AS severity,
  'Pending' AS status, 'Suspicious ' || kind || ' scored ' || printf('%.2f', score) AS message FROM s WHERE is_anomaly AND score >= 0.5""")
def raised_alerts(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("transaction_id"), F.col("o_orderstatus").alias("tx_type"),
        F.round(F.col("o_totalprice") / 500000.0, 2).alias("score"), (F.col("o_totalprice") > 300000).alias("is_anomaly"),
    )
    return workflow.raised_alerts(scored).select("alert_id", "user_id", "transaction_id", "severity", "status", "message")


_ANOMALIES = f"""d AS ({_DAILY}),
s AS (SELECT user_id, avg(n) AS m, CASE WHEN stddev_pop(n) > 0 THEN stddev_pop(n) ELSE 1 END AS sd, sum(n) AS total FROM d GROUP BY user_id),
a AS (SELECT user_id, day, n, (n - m) / sd AS z FROM d JOIN s USING (user_id) WHERE total >= 10 AND (n - m) / sd >= 2)"""
_NEW = f"WITH {_ANOMALIES} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, CASE WHEN z >= 3 THEN 'High' ELSE 'Medium' END AS severity FROM a WHERE day(day) % 3 <> 0"


def _had(spark: SparkSession, sf: str) -> DataFrame:
    """Days that have an alert already: every third of the month."""
    days = behaviour.daily_counts(S.transactions(spark, sf)).filter(F.dayofmonth("day") % 3 == 0)
    return days.select("user_id", "day")


@query(_NEW)
def daily_alerts_new(spark: SparkSession, sf: str) -> DataFrame:
    found = behaviour.daily_anomalies(behaviour.daily_counts(S.transactions(spark, sf)))
    return behaviour.new_daily_alerts(found, _had(spark, sf)).select("user_id", day(), "n", "severity")


@query("""WITH m AS (SELECT median(addr1) AS a, median(c1) AS c FROM v_training) SELECT event_id, round(amount, 6) AS "TransactionAmt", round(a, 6) AS addr1, round(c, 6) AS c1 FROM v_transactions, m""")
def default_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The population model's vector of a transaction, from metadata that was saved and loaded."""
    at = f"{_shared(spark)}/metadata"
    training = S.training(spark, sf).withColumnRenamed("amt", "TransactionAmt")
    S.save_metadata(preparation.feature_defaults(training, ["TransactionAmt", "addr1", "c1"]), at)
    rows = scoring.default_vector(S.transactions(spark, sf), S.load_metadata(spark, at), amount="amount")
    return rows.select("event_id", r6("TransactionAmt"), r6("addr1"), r6("c1"))


@query(f"""SELECT event_id, user_id, round(ln(1 + greatest(amount, 0)), 6) AS log_amount, hour(timestamp)::INT AS hour, round(coalesce(avg(amount) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 6) AS rolling_mean_10,
  (CASE WHEN coalesce(device_id, '') = '' THEN 0 WHEN lag(event_id) {_W}) IS NULL OR coalesce(device_id, '') <> lag(coalesce(device_id, '')) {_W}) THEN 1 ELSE 0 END)::INT AS device_change FROM v_transactions""")
def scoring_vector(spark: SparkSession, sf: str) -> DataFrame:
    rows = behaviour.behaviour_features(S.transactions(spark, sf), mode="scoring")
    return rows.select("event_id", "user_id", r6("log_amount"), "hour", r6("rolling_mean_10"), "device_change")


@query("""WITH t AS (SELECT user_id, count(*) AS n_rows FROM v_transactions WHERE user_id % 2 = 0 OR tx_type = 'Deposit' GROUP BY user_id),
n AS (SELECT user_id, count(*) AS n FROM v_transactions GROUP BY user_id) SELECT user_id, n, n_rows FROM n LEFT JOIN t USING (user_id) WHERE n >= 30 AND n > coalesce(n_rows, 0)""")
def retrain_triggers(spark: SparkSession, sf: str) -> DataFrame:
    txns = S.transactions(spark, sf)
    trained = txns.filter("user_id % 2 = 0 OR tx_type = 'Deposit'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return workflow.train_triggers(txns, trained).select("user_id", "n", "n_rows")


@query("SELECT count(*) AS n_rows, 8::INT AS n_columns, 'txn_id,txn_dt,amt,product_cd,card4,addr1,c1,is_fraud' AS names FROM v_training")
def training_profile(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.table_profile(S.training(spark, sf))


@query("""WITH l AS (SELECT 1.5 * json_extract_string(props, '$.k')::INT AS ms FROM events)
SELECT count(ms) AS n, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, min(ms) AS least, max(ms) AS greatest, round(count(ms) / 60.0, 6) AS per_second FROM l""")
def latency_report(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = S.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ingested_at"), (1500 * k).cast("long").alias("us"))
    scored = events.withColumn("scored_at", F.timestamp_micros(F.unix_micros("ingested_at") + F.col("us")))
    rows = reports.latency_summary(S.with_latency(scored), 60.0)
    return rows.select("n", r6("mean"), r6("median"), r6("least"), r6("greatest"), r6("per_second"))


@query("""SELECT '{"transaction_id":"' || transaction_id || '","user_id":' || user_id::VARCHAR || ',"tx_type":"' || tx_type || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '"'
  || CASE WHEN device_id IS NULL THEN '' ELSE ',"device_id":"' || device_id || '"' END || '}' AS record FROM v_transactions""")
def api_records(spark: SparkSession, sf: str) -> DataFrame:
    return S.api_records(S.transactions(spark, sf).select("transaction_id", "user_id", "tx_type", "timestamp", "device_id"), "timestamp")


@query("""SELECT event_id, transaction_id, user_id, round(amount, 6) AS amount, 'withdraw' AS tx_type, NULL::VARCHAR AS timestamp, coalesce(device_id, '') AS device_id FROM v_transactions""")
def conformed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that lack columns, have others and hold numbers as text, in the schema of transactions."""
    loose = S.transactions(spark, sf).select(
        "event_id", "transaction_id", "user_id", F.col("amount").cast("string").alias("amount"), "device_id", F.lit(1).alias("extra")
    )
    rows = S.conform(loose, S.TRANSACTIONS, {"tx_type": "withdraw", "device_id": ""})
    return rows.select("event_id", "transaction_id", "user_id", r6("amount"), "tx_type", text("timestamp"), "device_id")


@query("""SELECT o_totalprice AS "TransactionAmt", substr(o_orderpriority, 1, 1) AS "ProductCD", o_custkey::DOUBLE AS card1, NULL::DOUBLE AS card2, o_orderstatus AS card4, (o_totalprice > 450000)::INT AS "isFraud" FROM orders""")
def training_select(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.training_columns(
        S.table(spark, sf, "orders").select(
            F.col("o_totalprice").alias("TransactionAmt"), F.substring("o_orderpriority", 1, 1).alias("ProductCD"), F.col("o_custkey").alias("card1"),
            F.col("o_orderstatus").alias("card4"), (F.col("o_totalprice") > 450000).alias("isFraud"), "o_orderdate",
        )
    )
    return rows.select("TransactionAmt", "ProductCD", "card1", "card2", "card4", "isFraud")


@query("""SELECT transaction_id, user_id, CASE WHEN event_id % 3 <> 0 THEN round(amount / 400, 6) END AS fraud_score,
  CASE WHEN event_id % 3 <> 0 THEN strftime(timestamp + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') END AS scored_at, event_id % 3 <> 0 AS scored FROM v_transactions""")
def written_back(spark: SparkSession, sf: str) -> DataFrame:
    txns = S.transactions(spark, sf)
    scored = txns.filter("event_id % 3 <> 0").select(
        "transaction_id", (F.col("amount") / 400).alias("score"), (F.col("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("scored_at")
    )
    return workflow.write_back(txns, scored).select("transaction_id", "user_id", r6("fraud_score"), text("scored_at"), "scored")


@query("SELECT transaction_id, device_id, coalesce(device_id, '') <> '' AS hidden, device_id AS plain FROM v_transactions")
def device_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Device ids through the codec and back; a text that isn't its own comes back unchanged."""
    key = "0123456789abcdef"
    rows = S.transactions(spark, sf).withColumn("cipher", C.encrypt_device(F.col("device_id"), key))
    return rows.select(
        "transaction_id", C.decrypt_device(F.col("cipher"), key).alias("device_id"),
        F.coalesce(F.col("cipher") != F.col("device_id"), F.lit(False)).alias("hidden"), C.decrypt_device(F.col("device_id"), key).alias("plain"),
    )


@query("""WITH t AS (SELECT 'ts' AS "column", count(ts) AS changed FROM events UNION ALL SELECT 'event_id', 0) SELECT * FROM t""")
def naive_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return S.naive_rows(S.table(spark, sf, "events"), "ts", "event_id")


@query(f"""{_SCORED}, k AS (SELECT {_CONFUSION.format(s='score')} FROM t),
c AS (SELECT 0 AS class, tn AS h, fn AS w, fp AS m FROM k UNION ALL SELECT 1, tp, fp, fn FROM k)
SELECT class, round(coalesce(h / nullif(h + w, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(h / nullif(h + m, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * h / nullif(2 * h + w + m, 0)::DOUBLE, 0), 6) AS f1, h + m AS support FROM c""")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.class_report(_scored(spark, sf)).select("class", r6("precision"), r6("recall"), r6("f1"), "support")


@query("SELECT event_id, user_id, tx_type FROM v_transactions ORDER BY event_id LIMIT 5")
def peek(spark: SparkSession, sf: str) -> DataFrame:
    return S.peek(S.transactions(spark, sf), "event_id").select("event_id", "user_id", "tx_type")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id)::INT AS position FROM v_transactions")
def ordered_history(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{_shared(spark)}/history"
    return reports.ordered_history(S.transactions(spark, sf), "timestamp", "event_id", at).select("event_id", "user_id", "position")


@query("SELECT alert_id, user_id, severity, status FROM v_alerts")
def alerts_copy(spark: SparkSession, sf: str) -> DataFrame:
    return S.copy_table(S.alerts(spark, sf), f"{_shared(spark)}/copy", ["alert_id", "user_id", "severity", "status"])


@query("SELECT event_id, user_id, round(amount, 6) AS amount, tx_type, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, device_id FROM v_transactions")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{_shared(spark)}/csv"
    S.export_csv(S.conform(S.transactions(spark, sf), S.TRANSACTIONS), at)
    return S.read_csv(spark, at, S.TRANSACTIONS).select("event_id", "user_id", r6("amount"), "tx_type", text("timestamp"), "device_id")


_HISTORY = f"""p AS (SELECT *, count(amount) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_count,
  max(amount) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max FROM {{0}}),
e AS (SELECT *, coalesce(prior_count >= 3 AND prior_max > 0 AND amount >= 5 * prior_max, false) AS is_extreme FROM p)"""


@query(f"""WITH {_HISTORY.format('v_transactions')},
s AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN least(amount / 200, 1) END AS personal, CASE WHEN event_id % 5 <> 0 THEN least(amount / 100, 1) END AS population FROM e),
d AS (SELECT *, CASE WHEN personal IS NOT NULL AND population IS NOT NULL THEN 0.5 * personal + 0.5 * population ELSE coalesce(personal, population) END AS base,
  CASE WHEN personal IS NOT NULL THEN personal > 0.7 ELSE coalesce(population >= 0.5, false) END AS a FROM s),
f AS (SELECT *, CASE WHEN is_extreme THEN greatest(coalesce(base, 0), 0.95) ELSE base END AS score FROM d)
SELECT event_id, user_id, round(score, 6) AS score, a OR is_extreme AS is_anomaly, CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.5 THEN 'Medium' WHEN score IS NOT NULL THEN 'Low' END AS severity FROM f""")
def model_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with the personal score where the user has one, else the population's, here of plain formulas."""
    txns = behaviour.extreme_amounts(S.transactions(spark, sf))
    share = lambda top: F.least(F.col("amount") / top, F.lit(1.0))
    personal = txns.filter("user_id % 3 = 0").select("event_id", share(200).alias("personal"), (share(200) > 0.7).alias("personal_anomaly"))
    population = txns.filter("event_id % 5 <> 0").select("event_id", share(100).alias("population"))
    return scoring.decided(txns, personal, population).select("event_id", "user_id", r6("score"), "is_anomaly", "severity")


_STREAMED = f"""{_PARSED}, g AS (SELECT event_id, user_id, parsed_amount AS amount, parsed_time AS timestamp, tx_type FROM v WHERE parsed_amount IS NOT NULL AND parsed_time IS NOT NULL),
{_HISTORY.format('g')}, s AS (SELECT *, round(least(amount / 600, 1), 4) AS population FROM e),
f AS (SELECT *, CASE WHEN is_extreme THEN greatest(population, 0.95) ELSE population END AS score FROM s),
a AS (SELECT sha256(concat_ws('~', user_id::VARCHAR, event_id::VARCHAR, 'score')) AS alert_id, user_id, event_id::VARCHAR AS transaction_id,
  CASE WHEN score >= 0.8 THEN 'High' ELSE 'Medium' END AS severity FROM f WHERE (population >= 0.5 OR is_extreme) AND score >= 0.5)"""


@query(f"""WITH {_STREAMED} SELECT alert_id, user_id, transaction_id, severity, email, unnest(CASE WHEN severity = 'High' THEN ['email', 'sms'] ELSE ['email'] END) AS channel
FROM a LEFT JOIN v_users ON user_id = id""")
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies as a stream to scored rows, alerts and messages; every body is sent twice and counts once."""
    at = _shared(spark)
    bodies = _bodies(spark, sf)
    S.land_in_order(bodies.unionByName(bodies), f"{at}/landed", "received_at", "event_id")
    stream = S.read_stream(spark, f"{at}/landed", bodies.schema)
    none = F.lit(None)

    def score(rows: DataFrame) -> DataFrame:
        return scoring.ensemble(
            rows.withColumns({
                "personal": none.cast("double"), "personal_anomaly": none.cast("boolean"),
                "population": F.round(F.least(F.col("amount") / 600, F.lit(1.0)), 4),
            })
        )

    with keyed_state(spark):
        sink = jobs.alert_sink(at, lambda rows: rows, workflow.raised_alerts)
        jobs.run_batches(jobs.stream_scored(stream, score), sink, f"{at}/checkpoint", mode="append")
    alerts = spark.read.schema("alert_id string, user_id long, transaction_id string, severity string").parquet(f"{at}/alerts")
    return workflow.outbox(alerts, S.users(spark, sf)).select("alert_id", "user_id", "transaction_id", "severity", "email", "channel")


@query(_NEW)
def stream_daily_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The daily check over counts that a stream keeps: days that stand out and have no alert yet."""
    at = _shared(spark)
    S.land_in_order(S.transactions(spark, sf), f"{at}/landed", "timestamp", "event_id")

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/counts/batch={batch}")

    jobs.run_batches(jobs.stream_daily_counts(S.read_stream(spark, f"{at}/landed", S.TRANSACTIONS)), sink, f"{at}/checkpoint")
    counts = spark.read.parquet(f"{at}/counts").groupBy("user_id", "day").agg(F.max_by("n", "batch").alias("n"))
    return behaviour.new_daily_alerts(behaviour.daily_anomalies(counts), _had(spark, sf)).select("user_id", day(), "n", "severity")


_CUTS = "c AS (SELECT min(ts) + INTERVAL 15 DAY AS a, min(ts) + INTERVAL 20 DAY AS b FROM events)"


@query(f"""WITH {_CUTS}, n AS (SELECT user_id, count(*) FILTER (WHERE ts < a) AS n1, count(*) FILTER (WHERE ts < b) AS n2 FROM events, c GROUP BY user_id)
SELECT event_id, user_id, CASE WHEN ts < b THEN 1 ELSE 2 END::INT AS version, CASE WHEN ts < b THEN n1 ELSE n2 END >= 30 AS has_personal, true AS has_population, true AS as_in_batch
FROM events JOIN n USING (user_id), c""")
def stream_model_scores(spark: SparkSession, sf: str, trees: int = 50, rounds: int = 10) -> DataFrame:
    """The replay scored by the registry's models: version 1 until version 2, with more users' forests, is published on the way.

    as_in_batch tells whether the batch job at the same version gives the same verdict. Fewer trees and
    rounds than the defaults keep it quick; the way through the stream is the same.
    """
    at = _shared(spark)
    txns = S.transactions(spark, sf)
    start = txns.agg(F.min("timestamp")).first()[0]
    first, second = (F.lit(start) + F.expr(f"INTERVAL {d} DAYS") for d in (15, 20))
    registry, names = ModelRegistry(spark, f"{at}/models"), ["TransactionAmt", "addr1", "c1"]
    training = preparation.impute(S.training(spark, sf).withColumnRenamed("amt", "TransactionAmt"), skip=("txn_id",))
    registry.publish(
        models.train_forests(behaviour.behaviour_features(txns.filter(F.col("timestamp") < first)), trees=trees),
        models.train_population(training, names, "is_fraud", rounds=rounds), preparation.feature_defaults(training, names),
    )
    parts = [txns.filter(F.col("timestamp") < second), txns.filter(F.col("timestamp") >= second)]
    with keyed_state(spark):
        for k, part in enumerate(parts):
            S.land_in_order(part, f"{at}/landed/{k}", "timestamp", "event_id")
            stream = jobs.stream_features(jobs.unique(S.read_stream(spark, f"{at}/landed/*", S.TRANSACTIONS)), mode="scoring")
            jobs.run_batches(live.model_inputs(stream), live.model_sink(registry, at), f"{at}/checkpoint", mode="append")
            if not k:
                live.retrain(registry, part, trees=trees)
    verdict = ["personal", "personal_anomaly", "population", "score", "is_anomaly", "severity"]
    rows = behaviour.extreme_amounts(behaviour.behaviour_features(txns, mode="scoring"))
    batch = live.score_with(rows.filter(F.col("timestamp") < second), registry, 1).unionByName(live.score_with(rows.filter(F.col("timestamp") >= second), registry, 2))
    both = spark.read.parquet(f"{at}/scored").drop("batch").alias("s").join(batch.select("event_id", *[F.col(c).alias(f"b_{c}") for c in [*verdict, "version"]]), "event_id")
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) if c in ("personal_anomaly", "is_anomaly", "severity") else F.round(c, 9).eqNullSafe(F.round(f"b_{c}", 9)) for c in verdict]
    equal = F.col("version") == F.col("b_version")
    for x in same:
        equal &= x
    return both.select(
        "event_id", "user_id", "version", F.col("personal").isNotNull().alias("has_personal"), F.col("population").isNotNull().alias("has_population"), equal.alias("as_in_batch")
    )


@query(f"""WITH {_CUTS}, n AS (SELECT user_id, count(*) FILTER (WHERE ts < a) AS n1, count(*) FILTER (WHERE ts < b) AS n2, count(*) AS n3 FROM events, c GROUP BY user_id)
SELECT user_id, n3 AS n_rows, CASE WHEN n3 > n2 THEN 3 WHEN n2 > n1 THEN 2 ELSE 1 END::INT AS version,
  (CASE WHEN n1 >= 30 THEN 1 ELSE 0 END + CASE WHEN n2 >= 30 AND (n2 > n1 OR n1 < 30) THEN 1 ELSE 0 END + CASE WHEN n3 > n2 OR n2 < 30 THEN 1 ELSE 0 END)::INT AS times_trained FROM n WHERE n3 >= 30""")
def retrain_increments(spark: SparkSession, sf: str, trees: int = 10) -> DataFrame:
    """Three rounds of retraining over growing tables: each trains the users who have grown, and nobody else."""
    txns = S.transactions(spark, sf)
    start = txns.agg(F.min("timestamp")).first()[0]
    registry = ModelRegistry(spark, f"{_shared(spark)}/models")
    for days in (15, 20, None):
        live.retrain(registry, txns if days is None else txns.filter(F.col("timestamp") < F.lit(start) + F.expr(f"INTERVAL {days} DAYS")), trees=trees)
    times = None
    for v in registry.versions():
        part = spark.read.parquet(f"{registry.folder}/trained/{v}").select("user_id")
        times = part if times is None else times.unionByName(part)
    counted = times.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("times_trained"))
    return registry.trained().join(counted, "user_id").select("user_id", "n_rows", "version", "times_trained")


_RUNNING = f"""d AS ({_DAILY}), r AS (SELECT user_id, day, n, count(*) OVER w AS days, sum(n) OVER w AS total, sum(n * n) OVER w AS squares FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
a AS (SELECT user_id, day, n, days * n - total AS over, days * squares - total * total AS spread, total FROM r WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) FROM events))"""


@query(f"""WITH {_RUNNING} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, round(over / sqrt(spread), 6) AS z, CASE WHEN over * over >= 9 * spread THEN 'High' ELSE 'Medium' END AS severity
FROM a WHERE total >= 10 AND spread > 0 AND over > 0 AND over * over >= 4 * spread AND day(day) % 3 <> 0""")
def stream_daily_check(spark: SparkSession, sf: str) -> DataFrame:
    """Days that stand out as they close in the stream, which is stopped and restarted in mid-day and has rows up to twelve hours late."""
    at = _shared(spark)
    arrival = F.unix_micros("timestamp") + F.pmod(F.xxhash64("event_id"), F.lit(43_200_000_000))
    txns = S.transactions(spark, sf).withColumn("arrival", arrival)
    stop = txns.agg(F.min("arrival")).first()[0] + 10_500_000 * 86_400
    with keyed_state(spark):
        for k, part in enumerate((txns.filter(F.col("arrival") < stop), txns.filter(F.col("arrival") >= stop))):
            S.land_in_order(part, f"{at}/landed/{k}", "arrival", "event_id")
            found = jobs.daily_check(S.read_stream(spark, f"{at}/landed/*", S.TRANSACTIONS, files=2))
            jobs.run_batches(found, jobs.daily_sink(f"{at}/alerts", _had(spark, sf)), f"{at}/checkpoint", mode="append")
    return spark.read.parquet(f"{at}/alerts").select("user_id", day(), "n", r6("z"), "severity")


def _label_table(spark: SparkSession, sf: str) -> UpsertTable:
    """Analysts' labels as a table under upserts: a stream of judgements in several batches, compacted on the way."""
    at, rows = _shared(spark), S.feedback(spark, sf)
    table = UpsertTable(spark, f"{at}/table", rows.schema, "alert_id", ["labeled_at", "seq", "labeled_by", "is_fraud"], buckets=16)
    halves = [F.pmod(F.xxhash64("seq", "alert_id"), F.lit(2)) == k for k in (0, 1)]
    for k, half in enumerate(halves):
        # out of order of time: batches hold changes that are earlier than those before
        S.land_in_order(rows.filter(half).withColumn("arrival", F.xxhash64("seq", "labeled_at", "alert_id")), f"{at}/landed/{k}", "arrival")
        jobs.run_batches(S.read_stream(spark, f"{at}/landed/*", rows.schema, files=4), table.apply, f"{at}/checkpoint", mode="append")
        if not k:
            table.compact(dt.datetime(1996, 6, 1))
    return table


_LABELS = """SELECT alert_id, is_fraud, labeled_by, strftime(labeled_at, '%Y-%m-%d %H:%M:%S') AS labeled_at, count(*) OVER (PARTITION BY alert_id) AS n FROM v_feedback WHERE {0}
QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY labeled_at DESC, seq DESC, labeled_by DESC, is_fraud DESC) = 1"""


@query(_LABELS.format("true"))
def label_table(spark: SparkSession, sf: str) -> DataFrame:
    table = _label_table(spark, sf)
    table.compact(dt.datetime(1998, 1, 1))
    return table.read().select("alert_id", "is_fraud", "labeled_by", text("labeled_at"), "n")


@query(_LABELS.format("labeled_at <= TIMESTAMP '1998-03-01'"))
def label_table_as_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = _label_table(spark, sf).read(dt.datetime(1998, 3, 1))
    return rows.select("alert_id", "is_fraud", "labeled_by", text("labeled_at"), "n")


@query("""WITH t AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15') AS m FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, n % 2 = 1 AS is_frozen, coalesce(m % 2 = 1, false) AS was_frozen FROM t""")
def freeze_table(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts that toggles have frozen, now and in the middle of the month, from a table of toggles."""
    at = _shared(spark)
    rows = S.table(spark, sf, "events").filter("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id")
    table = UpsertTable(spark, f"{at}/table", rows.schema, "user_id", ["at", "event_id"], buckets=16)
    for batch in range(3):
        table.apply(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch), batch)
        table.apply(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch), batch)
    table.compact(dt.datetime(2024, 1, 10))
    then = table.read(dt.datetime(2024, 1, 15)).select("user_id", (F.col("n") % 2 == 1).alias("was_frozen"))
    rows = table.read().select("user_id", (F.col("n") % 2 == 1).alias("is_frozen")).join(then, "user_id", "left")
    return rows.withColumn("was_frozen", F.coalesce("was_frozen", F.lit(False)))


@query("""WITH a AS (SELECT l.alert_id AS id, v.user_id, generated_at, labeled_at AS resolved_at, severity FROM v_alerts v LEFT JOIN v_labels l ON v.alert_id = l.alert_id),
t AS (SELECT o_custkey AS user_id, l_shipdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 40),
x AS (SELECT o_orderkey AS txn_id, o_custkey AS user_id, o_orderdate AS ts FROM orders),
f AS (SELECT txn_id, count(*) AS n FROM x JOIN t ON x.user_id = t.user_id AND t.at <= x.ts GROUP BY txn_id),
p AS (SELECT txn_id, count(*) FILTER (WHERE (resolved_at IS NULL OR resolved_at > generated_at) AND (resolved_at IS NULL OR resolved_at > x.ts)) AS pending,
  max_by(severity, (generated_at, severity)) FILTER (WHERE severity IS NOT NULL) AS last_severity
  FROM x JOIN a ON x.user_id = a.user_id AND a.generated_at < x.ts GROUP BY txn_id),
s AS (SELECT txn_id, user_id, coalesce(f.n, 0) % 2 = 1 AS is_frozen, coalesce(pending, 0) AS pending, last_severity FROM x LEFT JOIN f USING (txn_id) LEFT JOIN p USING (txn_id))
SELECT *, CASE WHEN is_frozen THEN 'frozen' WHEN pending >= 2 THEN 'pending alerts' END AS reason, CASE WHEN is_frozen OR pending >= 2 THEN 'block' ELSE 'admit' END AS decision FROM s""")
def admission_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a transaction, admitted by what was known at its time; customers of over 16 rows are cut into slices."""
    orders = S.table(spark, sf, "orders")
    txns = orders.select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    flagged = S.table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 40")
    toggles = flagged.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_shipdate").cast("timestamp").alias("at"))
    labels = S.labels(spark, sf).select("alert_id", F.col("labeled_at").alias("resolved_at"))
    alerts = S.alerts(spark, sf).join(labels, "alert_id", "left").select("user_id", "generated_at", "resolved_at", "severity")
    rows = asof.admission_at(txns, toggles, alerts, C.PENDING_LIMIT, most=16, slices=8)
    return rows.select("txn_id", "user_id", "is_frozen", "pending", "last_severity", "decision", "reason")


@query("SELECT event_id, user_id, strftime(timestamp, '%Y-%m-%d') AS day, round(amount, 6) AS amount FROM v_transactions")
def appended(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions appended day by day in three runs, as the table reads back."""
    at = f"{_shared(spark)}/appended"
    rows = S.transactions(spark, sf).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    for k in range(3):
        S.append(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), at, "day")
    return spark.read.schema(rows.schema).parquet(at).select("event_id", "user_id", "day", r6("amount"))


@query("""SELECT event_id, row_number() OVER (ORDER BY timestamp, event_id)::BIGINT AS place, true AS in_order FROM v_transactions""")
def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Each transaction's place in a replay, and whether its micro-batch came after all that are earlier."""
    at = _shared(spark)
    S.land_in_order(S.transactions(spark, sf), f"{at}/landed", "timestamp", "event_id")

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    jobs.run_batches(S.read_stream(spark, f"{at}/landed", S.TRANSACTIONS, files=2), sink, f"{at}/checkpoint", mode="append")
    rows = spark.read.parquet(f"{at}/out")
    spans = rows.groupBy("batch").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n"))
    # a row for each micro-batch
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.select("batch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.coalesce(F.max("last").over(before) <= F.col("first"), F.lit(True)).alias("in_order"))
    inside = F.row_number().over(Window.partitionBy("batch").orderBy("timestamp", "event_id"))
    return rows.withColumn("i", inside).join(F.broadcast(ends), "batch").select("event_id", (F.col("offset") + F.col("i")).alias("place"), "in_order")


@query("""WITH c AS (SELECT user_id, CASE WHEN count(*) < 5 THEN 0.01 ELSE least(greatest(avg(is_fraud::INT), 0.005), 0.15) END AS share FROM v_labels l JOIN v_alerts a ON l.alert_id = a.alert_id GROUP BY user_id)
SELECT user_id, count(*) AS n, true AS scores_in_range, true AS share_kept FROM v_transactions LEFT JOIN c USING (user_id) GROUP BY user_id HAVING count(*) >= 30""")
def forest_shares(spark: SparkSession, sf: str, trees: int = 50) -> DataFrame:
    """Per user with a forest, that was saved and loaded: whether scores lie in the logistic function's range, and anomalies are the share they were fitted to."""
    at = f"{_shared(spark)}/forests"
    features, shares = behaviour.behaviour_features(S.transactions(spark, sf)), workflow.contamination(S.alerts(spark, sf), S.labels(spark, sf))
    S.save_model(models.train_forests(features, shares, trees), at)
    scored = models.score_forests(features, S.load_model(spark, at, trees=True)).join(shares.select("user_id", "contamination"), "user_id", "left")
    share = F.coalesce(F.first("contamination"), F.lit(C.CONTAMINATION))
    counts = scored.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min("personal") > 0.268).alias("_low"), (F.max("personal") < 0.732).alias("_high"), F.count_if("personal_anomaly").alias("_a"), share.alias("_share")
    )
    # the offset is the share's quantile: as many rows lie below it as its place in order, or fewer where scores tie
    kept = F.col("_a") <= F.ceil(F.col("_share") * (F.col("n") - 1))
    return counts.select("user_id", "n", (F.col("_low") & F.col("_high")).alias("scores_in_range"), kept.alias("share_kept"))


@query("""SELECT txn_id, true AS in_range, true AS as_saved FROM v_training""")
def population_model(spark: SparkSession, sf: str, rounds: int = 10) -> DataFrame:
    """Scores of the boosted trees, and whether the model gives the same ones after it was saved and loaded; ten rounds keep it quick."""
    at, names = f"{_shared(spark)}/population", ["amt", "addr1", "c1"]
    rows = preparation.impute(S.training(spark, sf), skip=("txn_id",))
    model = models.train_population(rows, names, "is_fraud", rounds=rounds)
    S.save_model(model, at)
    both = [models.score_population(rows, m, names).select("txn_id", F.col("population").alias(c)) for m, c in ((model, "x"), (S.load_model(spark, at), "y"))]
    return both[0].join(both[1], "txn_id").select("txn_id", F.col("x").between(0, 1).alias("in_range"), (F.col("x") == F.col("y")).alias("as_saved"))


@query("""SELECT 'fraud' AS side, count(*) AS n, true AS told_apart FROM v_training WHERE is_fraud = 1 UNION ALL SELECT 'rest', count(*), true FROM v_training WHERE is_fraud = 0""")
def population_ranking(spark: SparkSession, sf: str, rounds: int = 10) -> DataFrame:
    """Whether boosted trees score frauds high and the rest low on average, on a label that they can learn."""
    names = ["amt", "addr1", "c1"]
    rows = preparation.impute(S.training(spark, sf), skip=("txn_id",))
    scored = models.score_population(rows, models.train_population(rows, names, "is_fraud", rounds=rounds), names)
    fraud = F.col("is_fraud") == 1
    mean = scored.groupBy(F.when(fraud, "fraud").otherwise("rest").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.avg("population").alias("m"))
    return mean.select("side", "n", F.when(F.col("side") == "fraud", F.col("m") > 0.6).otherwise(F.col("m") < 0.4).alias("told_apart"))


@query("""SELECT user_id, count(*) AS n_rows, true AS known_when_next_met FROM v_transactions GROUP BY user_id HAVING count(*) >= 30""")
def stream_retraining(spark: SparkSession, sf: str, trees: int = 5) -> DataFrame:
    """Forests that the stream itself trains as users grow: on how many rows at last, and whether rows after a training were scored by it."""
    at, txns = _shared(spark), S.transactions(spark, sf)
    registry = ModelRegistry(spark, f"{at}/models")
    start = txns.agg(F.min("timestamp")).first()[0]
    cut = F.lit(start) + F.expr("INTERVAL 25 DAYS")
    with keyed_state(spark):
        for k, part in enumerate((txns.filter(F.col("timestamp") < cut), txns.filter(F.col("timestamp") >= cut))):
            S.land_in_order(part, f"{at}/landed/{k}", "timestamp", "event_id")
            stream = jobs.stream_features(S.read_stream(spark, f"{at}/landed/*", S.TRANSACTIONS), mode="scoring")
            sink = live.model_sink(registry, at, live.retraining(registry, lambda: txns, trees=trees))
            jobs.run_batches(live.model_inputs(stream), sink, f"{at}/checkpoint", mode="append")
    scored = spark.read.parquet(f"{at}/scored")
    versions = None
    for v in registry.versions():
        part = spark.read.parquet(f"{registry.folder}/trained/{v}").select("user_id", F.lit(v).alias("from_version"))
        versions = part if versions is None else versions.unionByName(part)
    first = versions.groupBy("user_id").agg(F.min("from_version").alias("from_version"))
    met = scored.join(first, "user_id").filter(F.col("version") >= F.col("from_version")).groupBy("user_id").agg(F.min(F.col("personal").isNotNull()).alias("met"))
    return registry.trained().join(met, "user_id", "left").select("user_id", "n_rows", F.coalesce("met", F.lit(True)).alias("known_when_next_met"))
