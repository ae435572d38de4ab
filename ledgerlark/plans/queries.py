"""Every operator as a query over the star schema, with its SQL for DuckDB.

Doubles are rounded to six places on both sides, times are given as text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import columns as C
from ledgerlark.operators import behaviour, evaluation, models, preparation, reports, scoring, workflow
from ledgerlark.sources import tables as S
from ledgerlark.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL; the views it names are put before it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            need: list[str] = []
            for name, view in S.VIEWS.items():
                if name in text:
                    need.append(f"{name} AS ({view})")
            body = text.strip()
            own, body = (body[5:], "") if body.upper().startswith("WITH ") else ("", body)
            SQL[f.__name__] = ("WITH " + ", ".join(need + ([own] if own else [])) + " " + body) if need or own else body
        return f

    return add


def r6(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def r9(name: str) -> Column:
    """For shares of a cent amount, whose seventh digit is often a tie."""
    return F.round(F.col(name).cast("double"), 9).alias(name)


def text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def day(name: str = "day") -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def _shared(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


_W = "OVER (PARTITION BY user_id ORDER BY timestamp, event_id"
_FEATURES_SQL = f"""
SELECT event_id, user_id, round(amount, 6) AS amount, round(ln(1 + greatest(amount, 0)), 6) AS log_amount,
  hour(timestamp)::INT AS hour, (isodow(timestamp) - 1)::INT AS weekday,
  round(coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) {_W}))) / 1e6, 0), 6) AS delta_prev_seconds,
  round(coalesce(avg(amount) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), 6) AS rolling_mean_10,
  count(amount) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rolling_count_10,
  (CASE WHEN lag(event_id) {_W}) IS NULL OR coalesce(device_id, '') <> lag(coalesce(device_id, '')) {_W}) THEN 1 ELSE 0 END)::INT AS device_change
FROM v_transactions WHERE timestamp IS NOT NULL"""


@query(_FEATURES_SQL)
def txn_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = behaviour.behaviour_features(S.transactions(spark, sf))
    return rows.select(
        "event_id", "user_id", r6("amount"), r6("log_amount"), "hour", "weekday", r6("delta_prev_seconds"),
        r6("rolling_mean_10"), "rolling_count_10", "device_change",
    )


_EXTREME = f"""
WITH p AS (SELECT *, count(amount) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_count,
  max(amount) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max FROM v_transactions),
e AS (SELECT *, coalesce(prior_count >= 3 AND prior_max > 0 AND amount >= 5 * prior_max, false) AS is_extreme FROM p)
SELECT event_id, user_id, round(amount, 6) AS amount, prior_count, round(prior_max, 6) AS prior_max, is_extreme,
  round(CASE WHEN is_extreme THEN amount / prior_max END, 6) AS ratio, CASE WHEN is_extreme THEN 'High' END AS severity FROM e"""


@query(_EXTREME)
def extreme_amount(spark: SparkSession, sf: str) -> DataFrame:
    rows = behaviour.extreme_amounts(S.transactions(spark, sf))
    score = F.when(F.col("is_extreme"), C.EXTREME_SCORE)
    return rows.select(
        "event_id", "user_id", r6("amount"), "prior_count", r6("prior_max"), "is_extreme", r6("ratio"), C.severity(score).alias("severity")
    )


_DAILY = "SELECT user_id, timestamp::DATE AS day, count(*) AS n FROM v_transactions GROUP BY ALL"


@query("SELECT user_id, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM v_transactions GROUP BY ALL")
def user_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return behaviour.daily_counts(S.transactions(spark, sf)).select("user_id", day(), "n")


@query(f"""WITH d AS ({_DAILY})
SELECT user_id, round(avg(n) + 2 * CASE WHEN stddev_pop(n) > 0 THEN stddev_pop(n) ELSE 1 END, 6) AS threshold, count(*) AS active_days
FROM d GROUP BY user_id""")
def daily_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return behaviour.daily_threshold(behaviour.daily_counts(S.transactions(spark, sf))).select("user_id", r6("threshold"), "active_days")


@query(f"""WITH d AS ({_DAILY}),
s AS (SELECT user_id, avg(n) AS m, CASE WHEN stddev_pop(n) > 0 THEN stddev_pop(n) ELSE 1 END AS sd, sum(n) AS total FROM d GROUP BY user_id)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, round((n - m) / sd, 6) AS z, CASE WHEN (n - m) / sd >= 3 THEN 'High' ELSE 'Medium' END AS severity
FROM d JOIN s USING (user_id) WHERE total >= 10 AND (n - m) / sd >= 2""")
def daily_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    found = behaviour.daily_anomalies(behaviour.daily_counts(S.transactions(spark, sf)))
    return found.select("user_id", day(), "n", r6("z"), "severity")


def _totals_sql(source: str) -> str:
    return f"""SELECT user_id, round(coalesce(sum(CASE WHEN lower(tx_type) = 'deposit' THEN amount END), 0), 6) AS deposits,
  round(coalesce(sum(CASE WHEN lower(tx_type) = 'withdraw' THEN amount END), 0), 6) AS withdrawals,
  round(coalesce(sum(CASE WHEN lower(tx_type) = 'deposit' THEN amount END), 0) - coalesce(sum(CASE WHEN lower(tx_type) = 'withdraw' THEN amount END), 0), 6) AS balance,
  count(*) AS n FROM {source} GROUP BY user_id"""


def _totals(rows: DataFrame) -> DataFrame:
    return reports.totals(rows).select("user_id", r6("deposits"), r6("withdrawals"), r6("balance"), "n")


@query(_totals_sql("v_transactions"))
def user_totals_all(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(S.transactions(spark, sf))


@query("WITH t AS (SELECT * FROM v_transactions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, event_id DESC) <= 200) " + _totals_sql("t"))
def user_totals_recent200(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(reports.latest(S.transactions(spark, sf), "timestamp", "event_id", 200))


@query("""SELECT user_id, strftime(timestamp, '%Y-%m-%d') AS day, round(coalesce(sum(CASE WHEN lower(tx_type) = 'deposit' THEN amount END), 0), 6) AS deposit,
  round(coalesce(sum(CASE WHEN lower(tx_type) = 'withdraw' THEN amount END), 0), 6) AS withdraw
FROM v_transactions WHERE lower(tx_type) IN ('deposit', 'withdraw') GROUP BY ALL""")
def daily_amounts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_amounts(S.transactions(spark, sf)).select("user_id", day(), r6("deposit"), r6("withdraw"))


@query("""SELECT DISTINCT user_id, strftime(timestamp, '%Y-%m-%d') AS day FROM v_transactions WHERE tx_type = 'Deposit'
UNION SELECT user_id, strftime(timestamp, '%Y-%m-%d') FROM v_transactions WHERE tx_type = 'withdraw'""")
def active_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.transactions(spark, sf).select("user_id", F.to_date("timestamp").alias("day"), F.lower("tx_type").alias("t"))
    one, two = (rows.filter(F.col("t") == t).select("user_id", day()) for t in ("deposit", "withdraw"))
    return one.union(two).distinct()


_BREAKDOWN = "SELECT user_id, " + ", ".join(
    f"count(CASE WHEN {c} = '{v}' THEN 1 END) AS {v.lower()}" for c, v in
    [("severity", "High"), ("severity", "Medium"), ("severity", "Low"), ("status", "Pending"), ("status", "Resolved")]
)
_LATEST50 = "(SELECT * FROM v_alerts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY generated_at DESC, alert_id DESC) <= 50)"


@query(f"{_BREAKDOWN} FROM v_alerts GROUP BY user_id")
def alert_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return reports.alert_breakdown(S.alerts(spark, sf))


@query(f"{_BREAKDOWN} FROM {_LATEST50} GROUP BY user_id")
def alert_breakdown_recent50(spark: SparkSession, sf: str) -> DataFrame:
    return reports.alert_breakdown(reports.latest(S.alerts(spark, sf), "generated_at", "alert_id", 50))


@query("""SELECT alert_id, user_id, severity, status, round(score, 9) AS score, row_number() OVER (PARTITION BY user_id ORDER BY generated_at DESC, alert_id DESC)::INT AS rank
FROM v_alerts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY generated_at DESC, alert_id DESC) <= 50""")
def recent_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latest(S.alerts(spark, sf), "generated_at", "alert_id", 50).select("alert_id", "user_id", "severity", "status", r9("score"), "rank")


@query("SELECT alert_id, user_id, coalesce(severity, 'Medium') AS severity, status FROM v_alerts WHERE status = 'Pending' AND coalesce(severity, 'Medium') = 'Medium'")
def alert_case_filter(spark: SparkSession, sf: str) -> DataFrame:
    return reports.case_filter(S.alerts(spark, sf), "Pending", "Medium").select("alert_id", "user_id", "severity", "status")


@query("""SELECT transaction_id, user_id, tx_type, strftime(timestamp, '%Y-%m-%d %H:%M') AS shown_at,
  round(CASE WHEN lower(tx_type) = 'deposit' THEN amount ELSE -amount END, 6) AS signed_amount, coalesce(device_id, '') AS device FROM v_transactions""")
def displayed_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.displayed(S.transactions(spark, sf)).withColumn("signed_amount", F.round("signed_amount", 6))


@query("""SELECT a.alert_id, user_id, status, is_fraud AS label_is_fraud, strftime(labeled_at, '%Y-%m-%d %H:%M:%S') AS label_labeled_at
FROM v_alerts a LEFT JOIN v_labels l ON a.alert_id = l.alert_id""")
def alert_with_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = workflow.alerts_with_label(S.alerts(spark, sf), S.labels(spark, sf))
    return rows.select("alert_id", "user_id", "status", "label_is_fraud", text("label_labeled_at"))


@query("SELECT a.alert_id, user_id, a.status, d.status AS dispute_status FROM v_alerts a LEFT JOIN v_disputes d ON a.alert_id = d.alert_id")
def alert_with_dispute(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.alerts_with_dispute(S.alerts(spark, sf), S.disputes(spark, sf)).select("alert_id", "user_id", "status", "dispute_status")


@query("""WITH q AS (SELECT l_suppkey AS requester, l_orderkey AS alert_id FROM lineitem)
SELECT requester, a.alert_id, severity FROM q JOIN v_alerts a ON q.alert_id = a.alert_id AND requester = user_id""")
def visible_alerts(spark: SparkSession, sf: str) -> DataFrame:
    asked = S.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("requester"), F.col("l_orderkey").alias("alert_id"))
    return workflow.visible(asked, S.alerts(spark, sf)).select("requester", "alert_id", "severity")


@query("""WITH p AS (SELECT user_id, count(*) AS pending FROM v_alerts WHERE status = 'Pending' GROUP BY user_id)
SELECT id AS user_id, coalesce(pending, 0) AS pending, CASE WHEN is_frozen THEN 'frozen' WHEN pending >= 2 THEN 'pending alerts' END AS reason,
  CASE WHEN is_frozen OR pending >= 2 THEN 'block' ELSE 'admit' END AS decision FROM v_users LEFT JOIN p ON id = user_id""")
def admission_gate(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.admission(S.users(spark, sf), S.alerts(spark, sf)).select("user_id", "pending", "reason", "decision")


@query("""SELECT user_id, count(*) AS n_labels, round(avg(is_fraud::INT), 6) AS fraud_rate,
  round(CASE WHEN count(*) < 5 THEN 0.01 ELSE least(greatest(avg(is_fraud::INT), 0.005), 0.15) END, 6) AS contamination
FROM v_labels l JOIN v_alerts a ON l.alert_id = a.alert_id GROUP BY user_id""")
def adaptive_contamination(spark: SparkSession, sf: str) -> DataFrame:
    rows = workflow.contamination(S.alerts(spark, sf), S.labels(spark, sf))
    return rows.select("user_id", "n_labels", r6("fraud_rate"), r6("contamination"))


@query("""SELECT alert_id, is_fraud, labeled_by, strftime(labeled_at, '%Y-%m-%d %H:%M:%S') AS labeled_at FROM v_feedback
QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY labeled_at DESC, seq DESC, labeled_by DESC, is_fraud DESC) = 1""")
def label_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.current_labels(S.feedback(spark, sf)).select("alert_id", "is_fraud", "labeled_by", text("labeled_at"))


@query("""SELECT alert_id, user_id, CASE WHEN alert_id IN (SELECT alert_id FROM v_labels) THEN 'Resolved' ELSE status END AS status FROM v_alerts""")
def alert_status(spark: SparkSession, sf: str) -> DataFrame:
    labels = S.labels(spark, sf)
    return workflow.with_status(S.alerts(spark, sf), labels, labels).select("alert_id", "user_id", "status")


@query("""WITH t AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, n % 2 = 1 AS is_frozen FROM t""")
def freeze_toggles(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.freeze_state(S.table(spark, sf, "events").filter("event_type = 'error'"))


@query("""WITH new AS (SELECT l_orderkey AS alert_id, l_shipdate AS created_at, l_partkey AS reason, l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT alert_id, reason, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM new WHERE alert_id NOT IN (SELECT alert_id FROM v_disputes)
QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY created_at, reason, k) = 1""")
def dispute_insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    new = S.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("alert_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.col("l_partkey").alias("reason"), F.col("l_suppkey").alias("k"),
    )
    rows = workflow.insert_absent(new, S.disputes(spark, sf), "alert_id", "created_at", "reason", "k")
    return rows.select("alert_id", "reason", text("created_at"))


_LAST_RUN = "(SELECT max(timestamp) - INTERVAL 1 DAY FROM v_transactions)"


@query(f"SELECT transaction_id, user_id FROM v_transactions WHERE timestamp > {_LAST_RUN}")
def unscored_backlog(spark: SparkSession, sf: str) -> DataFrame:
    txns = S.transactions(spark, sf)
    last = txns.agg((F.max("timestamp") - F.expr("INTERVAL 1 DAY")).alias("last_run"))
    scored = txns.crossJoin(F.broadcast(last)).filter("timestamp <= last_run")  # one row
    return workflow.backlog(txns, scored).select("transaction_id", "user_id")


@query("""SELECT alert_id, user_id, severity, email, unnest(CASE WHEN severity = 'High' THEN ['email', 'sms'] ELSE ['email'] END) AS channel
FROM v_alerts LEFT JOIN v_users ON user_id = id WHERE severity IN ('Medium', 'High')""")
def notification_outbox(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.outbox(S.alerts(spark, sf), S.users(spark, sf)).select("alert_id", "user_id", "severity", "email", "channel")


@query("""WITH raw AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'not-a-number' WHEN event_type = 'click' THEN NULL ELSE value::VARCHAR END AS amount,
  CASE WHEN event_type = 'view' THEN '  ' ELSE event_type END AS tx_type, CASE WHEN event_type = 'signup' THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M') END AS t FROM events)
SELECT event_id, CASE WHEN trim(tx_type) = '' THEN 'missing type' WHEN amount IS NOT NULL AND (try_cast(amount AS DOUBLE) IS NULL OR isnan(try_cast(amount AS DOUBLE))) THEN 'invalid amount'
  WHEN try_strptime(t, '%Y-%m-%dT%H:%M') IS NULL THEN 'invalid time' END AS reject_reason,
  round(CASE WHEN amount IS NULL THEN 0 ELSE try_cast(amount AS DOUBLE) END, 6) AS parsed_amount, strftime(try_strptime(t, '%Y-%m-%dT%H:%M'), '%Y-%m-%d %H:%M:%S') AS parsed_time FROM raw""")
def payload_validation(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    raw = S.table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "error", "not-a-number").when(kind == "click", None).otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(kind == "view", "  ").otherwise(kind).alias("tx_type"),
        F.when(kind == "signup", "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("timestamp"),
        F.lit(None).cast("string").alias("device_id"),
    )
    return S.validate_payloads(raw).select("event_id", "reject_reason", r6("parsed_amount"), text("parsed_time"))


_TRAIN = ["txn_id", "txn_dt", "amt", "product_cd", "card4", "addr1", "c1", "is_fraud"]
_NUMBERS = ["amt", "addr1", "c1"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS share FROM v_training" for c in _TRAIN))
def missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.missing_profile(S.training(spark, sf)).select("column", "missing", r6("share"))


@query("""WITH m AS (SELECT median(addr1) AS a FROM v_training)
SELECT txn_id, coalesce(card4, 'unknown') AS card4, round(coalesce(addr1, a), 6) AS addr1 FROM v_training, m""")
def impute_fill(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.impute(S.training(spark, sf), skip=("txn_id",)).select("txn_id", "card4", r6("addr1"))


@query("SELECT txn_id, " + ", ".join(f"coalesce((card4 = '{v}')::INT, 0) AS card4_{v}" for v in ("automobile", "building", "household", "machinery")) + " FROM v_training")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.one_hot(S.training(spark, sf).select("txn_id", "card4"), ["card4"])


def _defaults_sql(c: str) -> str:
    mode = f"(SELECT {c} FROM v_training WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} NOT IN (0, 1)) = 0 AS "binary",
  round(CASE WHEN count(*) FILTER (WHERE {c} NOT IN (0, 1)) = 0 THEN {mode} ELSE median({c}) END::DOUBLE, 6) AS "default" FROM v_training"""


@query(" UNION ALL ".join(_defaults_sql(c) for c in [*_NUMBERS, "is_fraud"]))
def feature_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.feature_defaults(S.training(spark, sf), [*_NUMBERS, "is_fraud"]).select("column", "binary", r6("default"))


@query("""SELECT count(*) AS n, sum(is_fraud)::BIGINT AS positives, sum(1 - is_fraud)::BIGINT AS negatives, round(avg(is_fraud) * 100, 6) AS percent,
  round(sum(1 - is_fraud) / sum(is_fraud)::DOUBLE, 6) AS weight FROM v_training""")
def class_weight(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.class_profile(S.training(spark, sf), "is_fraud").select("n", "positives", "negatives", r6("percent"), r6("weight"))


@query("""SELECT txn_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(txn_id::VARCHAR || ':42'), txn_id)
  <= floor(0.2 * count(*) OVER (PARTITION BY is_fraud)) AS is_test FROM v_training""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.stratified_split(S.training(spark, sf), "txn_id", "is_fraud").select("txn_id", "is_fraud", "is_test")


@query("""WITH c AS (SELECT quantile_cont(epoch_us(txn_dt)::DOUBLE, 0.6) AS a, quantile_cont(epoch_us(txn_dt)::DOUBLE, 0.8) AS b FROM v_training)
SELECT txn_id, CASE WHEN epoch_us(txn_dt) < a THEN 'train' WHEN epoch_us(txn_dt) < b THEN 'valid' ELSE 'test' END AS split FROM v_training, c""")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.time_split(S.training(spark, sf), "txn_dt").select("txn_id", "split")


#: A score that needs no model, for the metrics: the amount's share of a fixed ceiling, and another.
_SCORED = "WITH t AS (SELECT txn_id, txn_dt, is_fraud AS label, least(amt / 500000.0, 1.0) AS score, least((amt + 20000.0 * c1) / 600000.0, 1.0) AS score2 FROM v_training)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    amt = F.col("amt")
    return S.training(spark, sf).select(
        "txn_id", "txn_dt", F.col("is_fraud").alias("label"), F.least(amt / 500000.0, F.lit(1.0)).alias("score"),
        F.least((amt + 20000.0 * F.col("c1")) / 600000.0, F.lit(1.0)).alias("score2"),
    )


_CONFUSION = """count(*) FILTER (WHERE label = 1 AND {s} >= 0.5) AS tp, count(*) FILTER (WHERE label <> 1 AND {s} >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND {s} < 0.5) AS fn, count(*) FILTER (WHERE label <> 1 AND {s} < 0.5) AS tn"""


@query(f"""{_SCORED}, k AS (SELECT {_CONFUSION.format(s='score')} FROM t)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM k""")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.binary_metrics(_scored(spark, sf))
    return rows.select("tp", "fp", "fn", "tn", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query(f"""{_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM t)
SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label <> 1) AS negatives,
  round((sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 6) AS auc FROM r""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.roc_auc(_scored(spark, sf)).select("positives", "negatives", r6("auc"))


@query(f"""{_SCORED}, b AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(score) AS m, avg(label) AS r FROM t GROUP BY 1)
SELECT bin, n, round(m, 6) AS mean_score, round(r, 6) AS rate, round(n / (SELECT sum(n) FROM b)::DOUBLE * abs(m - r), 6) AS gap FROM b""")
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.calibration_bins(_scored(spark, sf)).select("bin", "n", r6("mean_score"), r6("rate"), r6("gap"))


_CUT = "c AS (SELECT quantile_cont(epoch_us(txn_dt)::DOUBLE, 0.5) AS cut FROM t)"


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.time_split(_scored(spark, sf), "txn_dt", 0.5, 0.5).withColumn("first_half", F.col("split") == "train")


@query(f"""{_SCORED}, {_CUT}, k AS (SELECT CASE WHEN label = 1 THEN 1 - score ELSE score END AS w FROM t, c WHERE epoch_us(txn_dt) < cut),
q AS (SELECT w AS threshold FROM (SELECT w, row_number() OVER (ORDER BY w) AS r, count(*) OVER () AS n FROM k) WHERE r = least(n, ceil((n + 1) * 0.9)) )
SELECT round(threshold, 6) AS threshold, round(avg((CASE WHEN label = 1 THEN 1 - score ELSE score END <= threshold)::INT), 6) AS coverage,
  round(avg((score <= threshold)::INT + (1 - score <= threshold)::INT), 6) AS mean_set_size FROM t, c, q WHERE epoch_us(txn_dt) >= cut GROUP BY threshold""")
def conformal_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = _split(spark, sf)
    return evaluation.conformal(rows.filter("first_half"), rows.filter("NOT first_half")).select(r6("threshold"), r6("coverage"), r6("mean_set_size"))


@query(f"""{_SCORED}, k AS (SELECT strftime(txn_dt, '%Y-%m') AS period, {_CONFUSION.format(s='score')} FROM t GROUP BY 1),
k2 AS (SELECT strftime(txn_dt, '%Y-%m') AS period, {_CONFUSION.format(s='score2')} FROM t GROUP BY 1),
f AS (SELECT k.period, coalesce(2 * k.tp / nullif(2 * k.tp + k.fp + k.fn, 0)::DOUBLE, 0) AS a, coalesce(2 * k2.tp / nullif(2 * k2.tp + k2.fp + k2.fn, 0)::DOUBLE, 0) AS b FROM k JOIN k2 ON k.period = k2.period)
SELECT period, round(a, 6) AS score, round(b, 6) AS score2, round(b - a, 6) AS gain FROM f""")
def champion_challenger(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.champion_challenger(_scored(spark, sf), F.date_format("txn_dt", "yyyy-MM"), "score", "score2")
    return rows.select("period", r6("score"), r6("score2"), r6("gain"))


@query(f"""{_SCORED}, k AS (SELECT count(*) FILTER (WHERE (score >= 0.5) = (label = 1) AND (score2 >= 0.5) <> (label = 1)) AS first_only,
  count(*) FILTER (WHERE (score >= 0.5) <> (label = 1) AND (score2 >= 0.5) = (label = 1)) AS second_only FROM t)
SELECT first_only, second_only, round(CASE WHEN first_only + second_only > 0 THEN pow(greatest(abs(first_only - second_only) - 1, 0), 2) / (first_only + second_only) ELSE 0 END, 6) AS statistic FROM k""")
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.mcnemar(_scored(spark, sf), "score", "score2").select("first_only", "second_only", r6("statistic"))


_WEIGHT = " + ".join(f"(u >= {c})::INT" for c in evaluation.POISSON)


@query(f"""{_SCORED}, d AS (SELECT k, label, ('0x' || substr(md5(txn_id::VARCHAR || ':' || (k // 8)::VARCHAR), (4 * (k % 8) + 1)::INT, 4))::INT AS u FROM t, range(100) AS r(k)),
m AS (SELECT k, sum(({_WEIGHT}) * label) / sum({_WEIGHT})::DOUBLE AS m FROM d GROUP BY k)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bootstrap_rate(_scored(spark, sf), F.col("label")).select(r6("mean"), r6("low"), r6("high"))


_EDGES = ", ".join(f"quantile_cont(score, {i / 10}) AS q{i}" for i in range(1, 10))
_BIN = " + ".join(f"(q{i} < score)::INT" for i in range(1, 10))


@query(f"""{_SCORED}, {_CUT}, e AS (SELECT {_EDGES} FROM t, c WHERE epoch_us(txn_dt) < cut),
b AS (SELECT {_BIN} AS bin, count(*) FILTER (WHERE epoch_us(txn_dt) < cut) AS x, count(*) FILTER (WHERE epoch_us(txn_dt) >= cut) AS y FROM t, c, e GROUP BY 1),
s AS (SELECT greatest(x / sum(x) OVER ()::DOUBLE, 0.0001) AS x, greatest(y / sum(y) OVER ()::DOUBLE, 0.0001) AS y FROM b)
SELECT round(sum((y - x) * ln(y / x)), 6) AS psi, count(*) AS bins FROM s""")
def psi(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.psi(_split(spark, sf), F.col("first_half"), "score").select(r6("psi"), "bins")


@query(f"""{_SCORED}, {_CUT}, v AS (SELECT score, count(*) FILTER (WHERE epoch_us(txn_dt) < cut) AS x, count(*) FILTER (WHERE epoch_us(txn_dt) >= cut) AS y FROM t, c GROUP BY score),
s AS (SELECT sum(x) OVER (ORDER BY score) / sum(x) OVER ()::DOUBLE AS x, sum(y) OVER (ORDER BY score) / sum(y) OVER ()::DOUBLE AS y FROM v)
SELECT round(max(abs(x - y)), 6) AS ks FROM s""")
def ks_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.ks(_split(spark, sf), F.col("first_half"), "score").select(r6("ks"))


_RANGE = "OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {0} PRECEDING AND 1 PRECEDING)"
_VELOCITY = ", ".join(
    f"count(*) {_RANGE.format(n)} AS count_{k}, round(coalesce(sum(amount) {_RANGE.format(n)}, 0), 6) AS sum_{k}, count(DISTINCT device_id) {_RANGE.format(n)} AS devices_{k}"
    for k, n in (("1h", 3600), ("24h", 86400), ("7d", 604800))
)


@query(f"WITH t AS (SELECT *, floor(epoch(timestamp))::BIGINT AS s FROM v_transactions) SELECT event_id, {_VELOCITY} FROM t")
def velocity_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = behaviour.velocity(S.transactions(spark, sf))
    out = [c for k in ("1h", "24h", "7d") for c in (F.col(f"count_{k}"), r6(f"sum_{k}"), F.col(f"devices_{k}").cast("long"))]
    return rows.select("event_id", *out)


@query("""WITH e AS (SELECT DISTINCT user_id, device_id FROM v_transactions WHERE device_id IS NOT NULL),
d AS (SELECT device_id, count(*) AS u FROM e GROUP BY device_id)
SELECT user_id, count(*) AS devices, sum(u - 1)::BIGINT AS links, max(u) AS widest_device FROM e JOIN d USING (device_id) GROUP BY user_id""")
def shared_devices(spark: SparkSession, sf: str) -> DataFrame:
    return behaviour.shared_devices(S.transactions(spark, sf))


@query("""SELECT alert_id, strftime(generated_at, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY generated_at::DATE ORDER BY score DESC, alert_id)::INT AS rank,
  CASE WHEN row_number() OVER (PARTITION BY generated_at::DATE ORDER BY score DESC, alert_id) <= 3 THEN 'review' ELSE 'auto' END AS route FROM v_alerts""")
def review_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.review_budget(S.alerts(spark, sf), F.date_format("generated_at", "yyyy-MM-dd"), "score", "alert_id", 3)
    return rows.select("alert_id", "day", "rank", "route")


@query("""SELECT alert_id, strftime(generated_at, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY generated_at::DATE ORDER BY abs(score - 0.5), alert_id)::INT AS rank
FROM v_alerts WHERE alert_id NOT IN (SELECT alert_id FROM v_labels) QUALIFY row_number() OVER (PARTITION BY generated_at::DATE ORDER BY abs(score - 0.5), alert_id) <= 3""")
def uncertainty_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.uncertainty_queue(S.alerts(spark, sf), S.labels(spark, sf), F.date_format("generated_at", "yyyy-MM-dd"), "score", "alert_id", 3)
    return rows.select("alert_id", "day", "rank")


@query("""SELECT a.alert_id, is_fraud FROM v_alerts a JOIN v_labels l ON a.alert_id = l.alert_id AND labeled_at <= generated_at + INTERVAL 30 DAY""")
def label_availability(spark: SparkSession, sf: str) -> DataFrame:
    joined = S.labels(spark, sf).join(S.alerts(spark, sf).select("alert_id", "generated_at"), "alert_id")
    return preparation.labels_known(joined, F.col("generated_at") + F.expr("INTERVAL 30 DAYS")).select("alert_id", "is_fraud")


_VIEWS3 = """WITH t AS (SELECT o_orderkey AS txn, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice / 500000.0 END AS population,
  CASE WHEN o_orderstatus <> 'F' THEN 0.3 + o_totalprice / 1500000.0 END AS personal, o_totalprice > 400000 AS personal_anomaly, o_totalprice > 480000 AS is_extreme FROM orders)"""


def _views(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("txn"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", price / 500000.0).alias("population"),
        F.when(F.col("o_orderstatus") != "F", 0.3 + price / 1500000.0).alias("personal"), (price > 400000).alias("personal_anomaly"),
        (price > 480000).alias("is_extreme"),
    )


@query(_VIEWS3 + """, b AS (SELECT *, CASE WHEN population IS NOT NULL AND personal IS NOT NULL THEN 0.5 * personal + 0.5 * population ELSE coalesce(personal, population) END AS base,
  CASE WHEN personal IS NOT NULL THEN personal_anomaly ELSE coalesce(population >= 0.5, false) END AS a FROM t),
s AS (SELECT txn, CASE WHEN is_extreme THEN greatest(coalesce(base, 0), 0.95) ELSE base END AS score, a OR is_extreme AS is_anomaly FROM b)
SELECT txn, round(score, 9) AS score, is_anomaly, CASE WHEN score IS NULL THEN NULL WHEN score >= 0.8 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS severity FROM s""")
def ensemble_decision(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.ensemble(_views(spark, sf)).select("txn", r9("score"), "is_anomaly", "severity")


@query(_VIEWS3 + """ SELECT txn, round(CASE WHEN population IS NULL AND personal IS NULL THEN NULL
  ELSE (coalesce(population * 2, 0) + coalesce(personal, 0)) / ((population IS NOT NULL)::INT * 2.0 + (personal IS NOT NULL)::INT) END, 9) AS fused,
  round(greatest(population, personal) - least(population, personal), 9) AS disagreement FROM t""")
def view_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = _views(spark, sf).withColumns({"fused": scoring.fused({"population": 2.0, "personal": 1.0}), "disagreement": scoring.disagreement("population", "personal")})
    return rows.select("txn", r9("fused"), r9("disagreement"))


@query("""SELECT o_orderkey AS txn, c_mktsegment AS segment, c_custkey IS NOT NULL AS has_identity,
  sha256(concat_ws('~', coalesce(o_custkey::VARCHAR, ''), coalesce(o_orderpriority, ''))) AS uid FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""")
def identity_merge(spark: SparkSession, sf: str) -> DataFrame:
    identity = S.table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    rows = preparation.with_identity(S.table(spark, sf, "orders"), identity, "o_custkey")
    return rows.select(F.col("o_orderkey").alias("txn"), "segment", "has_identity", preparation.entity_key("o_custkey", "o_orderpriority").alias("uid"))


_PAST = f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_Z = ", ".join(
    f"{{'z': coalesce(round(abs(({c} - avg({c}) {_PAST}) / CASE WHEN stddev_pop({c}) {_PAST} > 0 THEN stddev_pop({c}) {_PAST} ELSE 1 END), 6), 0), 'feature': '{c}'}}"
    for c in behaviour.FEATURES
)


@query(f"""WITH f AS (SELECT event_id, user_id, timestamp, amount, ln(1 + greatest(amount, 0)) AS log_amount, hour(timestamp) AS hour, isodow(timestamp) - 1 AS weekday,
  coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) {_W}))) / 1e6, 0) AS delta_prev_seconds,
  coalesce(avg(amount) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS rolling_mean_10,
  count(amount) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rolling_count_10,
  CASE WHEN lag(event_id) {_W}) IS NULL OR coalesce(device_id, '') <> lag(coalesce(device_id, '')) {_W}) THEN 1 ELSE 0 END AS device_change
  FROM v_transactions WHERE timestamp IS NOT NULL),
r AS (SELECT event_id, user_id, list_reverse_sort([{_Z}])[1] AS top FROM f)
SELECT event_id, user_id, top.feature AS first, round(top.z, 6) AS z FROM r""")
def reason_codes(spark: SparkSession, sf: str) -> DataFrame:
    found = behaviour.reason_codes(behaviour.behaviour_features(S.transactions(spark, sf)))
    return found.select("event_id", "user_id", F.col("reasons")[0]["feature"].alias("first"), F.round(F.col("reasons")[0]["z"], 6).alias("z"))


@query()
def user_forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    features = behaviour.behaviour_features(S.transactions(spark, sf))
    return models.own_forest_scores(features, workflow.contamination(S.alerts(spark, sf), S.labels(spark, sf)))


@query()
def gbt_scores(spark: SparkSession, sf: str, rounds: int = 200) -> DataFrame:
    rows = preparation.time_split(preparation.impute(S.training(spark, sf), skip=("txn_id",)), "txn_dt")
    model = models.train_population(rows.filter("split = 'train'"), _NUMBERS, "is_fraud", rounds=rounds)
    return models.score_population(rows.filter("split <> 'train'"), model, _NUMBERS).select("txn_id", "is_fraud", r6("population"))


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed processors need, for as long as a stream is started and run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The transactions as a stream of files, landed in the shared folder in order of time first."""
    landed = f"{_shared(spark)}/landed"
    S.land_in_order(S.transactions(spark, sf), landed, "timestamp", "event_id")
    return S.read_stream(spark, landed, S.TRANSACTIONS)


@query(_FEATURES_SQL.replace("round(ln(1 + greatest(amount, 0)), 6) AS log_amount,", "").replace("hour(timestamp)::INT AS hour, (isodow(timestamp) - 1)::INT AS weekday,", ""))
def stream_features(spark: SparkSession, sf: str) -> DataFrame:
    at = _shared(spark)
    with keyed_state(spark):
        jobs.run_available(jobs.stream_features(_stream(spark, sf)), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select(
        "event_id", "user_id", r6("amount"), r6("delta_prev_seconds"), r6("rolling_mean_10"), "rolling_count_10", "device_change"
    )


@query("SELECT user_id, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM v_transactions GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    at = _shared(spark)

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    jobs.run_batches(jobs.stream_daily_counts(_stream(spark, sf)), sink, f"{at}/checkpoint")
    counts = spark.read.parquet(f"{at}/out")
    return counts.groupBy("user_id", day()).agg(F.max_by("n", "batch").alias("n"))
