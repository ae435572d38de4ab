"""Small hand-made frames for the edges of the operators."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import columns as C
from ledgerlark.operators import behaviour, evaluation, models, preparation, ranks, reports, scoring, workflow
from ledgerlark.sources import tables as S
from ledgerlark.streaming import jobs

DAY = dt.datetime(2026, 7, 1)


def txns(spark, rows):
    """rows of (event_id, user_id, amount, minutes after DAY or None, device)."""
    data = [
        (e, str(e), u, a, "Deposit", None if m is None else DAY + dt.timedelta(minutes=m), d) for e, u, a, m, d in rows
    ]
    return spark.createDataFrame(data, S.TRANSACTIONS)


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0] if values else None


@pytest.mark.parametrize("score,band", [(0.1, "Low"), (0.49, "Low"), (0.5, "Medium"), (0.79, "Medium"), (0.8, "High"), (1.0, "High")])
def test_severity(spark, score, band):
    assert one(spark, C.severity(F.col("s")), s=score) == band


def test_null_score_has_no_severity(spark):
    assert spark.range(1).select(C.severity(F.lit(None).cast("double"))).first()[0] is None


def test_features_of_first_rows_nulls_and_devices(spark):
    rows = txns(spark, [(1, 1, 10.0, 0, None), (2, 1, -5.0, 1, ""), (3, 1, 20.0, 3, "a"), (4, 1, 1.0, None, "a"), (5, 2, 1.0, 0, "x")])
    got = {r.event_id: r for r in behaviour.behaviour_features(rows).collect()}
    assert 4 not in got
    assert (got[1].device_change, got[2].device_change, got[3].device_change) == (1, 0, 1)
    assert (got[1].delta_prev_seconds, got[3].delta_prev_seconds) == (0.0, 120.0)
    assert (got[3].rolling_mean_10, got[3].rolling_count_10, got[1].rolling_mean_10) == (2.5, 2, 0.0)
    assert got[2].log_amount == 0.0 and got[1].weekday == DAY.weekday()
    scoring_mode = {r.event_id: r.device_change for r in behaviour.behaviour_features(rows, "scoring").collect()}
    assert (scoring_mode[1], scoring_mode[5]) == (0, 1)


def test_rolling_window_holds_ten(spark):
    rows = txns(spark, [(k, 1, float(k), k, "a") for k in range(1, 13)])
    got = {r.event_id: r for r in behaviour.behaviour_features(rows).collect()}
    assert [got[k].rolling_count_10 for k in (10, 11, 12)] == [9, 10, 10]
    assert got[12].rolling_mean_10 == sum(range(2, 12)) / 10


def test_extreme_amount_edges(spark):
    def last(*amounts):
        rows = txns(spark, [(k, 1, a, k, "a") for k, a in enumerate(amounts)])
        return behaviour.extreme_amounts(rows).orderBy(F.desc("event_id")).first()

    assert last(1.0, 2.0, 1.0, 10.0).is_extreme and last(1.0, 2.0, 1.0, 10.0).ratio == 5.0
    assert not last(1.0, 2.0, 1.0, 9.99).is_extreme
    assert not last(1.0, 2.0, 100.0).is_extreme
    assert not last(0.0, -2.0, 0.0, 100.0).is_extreme


def test_later_rows_change_no_earlier_feature(spark):
    rows = [(k, 1, float(k), k, "a") for k in range(6)]
    before = behaviour.behaviour_features(txns(spark, rows)).filter("event_id < 5").orderBy("event_id").collect()
    after = behaviour.behaviour_features(txns(spark, [*rows[:5], (5, 1, 1e9, 5, "z")])).filter("event_id < 5").orderBy("event_id").collect()
    assert before == after


def test_order_and_partitions_change_nothing(spark):
    rows = txns(spark, [(k, k % 3, float(k % 7), k // 2, f"d{k % 2}") for k in range(60)])
    a = behaviour.behaviour_features(rows).orderBy("event_id").collect()
    b = behaviour.behaviour_features(rows.orderBy(F.rand(1)).repartition(7)).orderBy("event_id").collect()
    assert a == b


def test_daily_anomalies(spark):
    def counts(ns):
        return spark.createDataFrame([(1, (DAY + dt.timedelta(days=k)).date(), n) for k, n in enumerate(ns)], "user_id long, day date, n long")

    assert behaviour.daily_anomalies(counts([2] * 8)).count() == 0
    hit = behaviour.daily_anomalies(counts([1, 1, 1, 1, 6])).collect()
    assert len(hit) == 1 and hit[0].z == pytest.approx(2.0) and hit[0].severity == "Medium"
    assert behaviour.daily_anomalies(counts([1] * 9 + [11])).first().severity == "High"
    assert behaviour.daily_anomalies(counts([1, 1, 1, 1, 5])).count() == 0  # nine transactions in all
    assert behaviour.daily_threshold(counts([3, 3])).first().threshold == 5.0
    found = behaviour.daily_anomalies(counts([1, 1, 1, 1, 6]))
    assert behaviour.new_daily_alerts(found, found).count() == 0


def test_days_of_two_or_three_deviations_exactly(spark):
    """Whatever the order of days: of k days, one of n and the others equal, that one is sqrt(k - 1) deviations away."""
    cases = {(days, a, b, at): 2 + (days == 10) for days in (5, 10) for a in (1, 2, 3, 7) for b in (6, 11, 13, 29) for at in range(days) if a < b}
    users = list(cases)
    rows = [(u, (DAY + dt.timedelta(days=k)).date(), b if k == at else a) for u, (days, a, b, at) in enumerate(users) for k in range(days)]
    wanted = {u: "Medium" if days == 5 else "High" for u, (days, a, b, at) in enumerate(users) if a * (days - 1) + b >= 10}
    found = behaviour.daily_anomalies(spark.createDataFrame(rows, "user_id long, day date, n long").repartition(3)).collect()
    assert {r.user_id: r.severity for r in found} == wanted and len(found) == len(wanted)
    assert all(r.z == pytest.approx(cases[users[r.user_id]]) for r in found)


def test_ensemble_table(spark):
    rows = spark.createDataFrame(
        [(None, None, None, False), (None, 0.4, None, False), (None, 0.5, None, False), (0.6, None, True, False),
         (0.6, 0.2, False, False), (0.6, 0.9, True, False), (None, None, None, True), (0.7, 0.99, False, True)],
        "personal double, population double, personal_anomaly boolean, is_extreme boolean",
    )
    got = [(r.score, r.is_anomaly, r.severity) for r in scoring.ensemble(rows).collect()]
    assert got == [
        (None, False, None), (0.4, False, "Low"), (0.5, True, "Medium"), (0.6, True, "Medium"),
        (0.4, False, "Low"), (0.75, True, "Medium"), (0.95, True, "High"), (0.95, True, "High"),
    ]


def test_case_filter_shows_null_severity_as_medium(spark):
    rows = spark.createDataFrame([(1, None, "Pending"), (2, "High", "Pending"), (3, "Medium", "Resolved")], "alert_id int, severity string, status string")
    assert [r.alert_id for r in reports.case_filter(rows, "Pending", "Medium").collect()] == [1]
    assert reports.case_filter(rows).count() == 3


def test_admission_gate(spark):
    users = spark.createDataFrame([(1, False), (2, False), (3, True)], "id long, is_frozen boolean")
    alerts = spark.createDataFrame([(1, "Pending"), (1, "Pending"), (2, "Pending"), (2, "Resolved")], "user_id long, status string")
    got = {r.user_id: (r.decision, r.reason) for r in workflow.admission(users, alerts).collect()}
    assert got == {1: ("block", "pending alerts"), 2: ("admit", None), 3: ("block", "frozen")}


def test_contamination_edges(spark):
    def rate(flags):
        labels = spark.createDataFrame([(k, f) for k, f in enumerate(flags)], "alert_id int, is_fraud boolean")
        alerts = spark.createDataFrame([(k, 1) for k in range(len(flags))], "alert_id int, user_id int")
        return workflow.contamination(alerts, labels).first().contamination

    assert rate([True] * 4) == 0.01
    assert rate([True] * 5) == 0.15
    assert rate([False] * 5) == 0.005
    assert rate([True] + [False] * 9) == pytest.approx(0.1)


def test_feedback_resolves_and_latest_label_wins(spark):
    events = spark.createDataFrame(
        [("a", True, 1, DAY, 1), ("a", False, 2, DAY + dt.timedelta(1), 1)], "alert_id string, is_fraud boolean, labeled_by int, labeled_at timestamp, seq int"
    )
    now = workflow.current_labels(events)
    assert [(r.alert_id, r.is_fraud) for r in now.collect()] == [("a", False)]
    alerts = spark.createDataFrame([("a", "Pending"), ("b", "Pending")], "alert_id string, status string")
    got = {r.alert_id: r.status for r in workflow.with_status(alerts, now.limit(0), now).collect()}
    assert got == {"a": "Resolved", "b": "Pending"}


def test_raised_alerts_and_outbox(spark):
    scored = spark.createDataFrame(
        [("t1", 1, "Deposit", 0.9, True), ("t2", 1, "x", 0.6, True), ("t3", 1, "x", 0.4, True), ("t4", 1, "x", 0.9, False), ("t5", 1, "x", None, True)],
        "transaction_id string, user_id long, tx_type string, score double, is_anomaly boolean",
    )
    alerts = workflow.raised_alerts(scored)
    assert {r.transaction_id: r.severity for r in alerts.collect()} == {"t1": "High", "t2": "Medium"}
    users = spark.createDataFrame([(2, "x@example.com")], "id long, email string")
    sent = workflow.outbox(alerts, users).collect()
    assert sorted((r.transaction_id, r.channel, r.email) for r in sent) == [("t1", "email", None), ("t1", "sms", None), ("t2", "email", None)]
    assert sorted(r.message_id for r in sent) == sorted(r.message_id for r in workflow.outbox(alerts, users).collect())


def test_insert_if_absent_and_ownership(spark):
    new = spark.createDataFrame([("a@x", 2), ("a@x", 1), ("b@x", 3)], "email string, n int")
    got = workflow.insert_absent(new, spark.createDataFrame([("b@x",)], "email string"), "email", "n").collect()
    assert [(r.email, r.n) for r in got] == [("a@x", 1)]
    alerts = spark.createDataFrame([(1, 7)], "alert_id int, user_id int")
    asked = spark.createDataFrame([(7, 1), (8, 1)], "requester int, alert_id int")
    assert [r.requester for r in workflow.visible(asked, alerts).collect()] == [7]


def test_payloads(spark):
    rows = spark.createDataFrame(
        [("5000", "deposit", "2026-07-11T10:00", "d"), ("not-a-number", "deposit", "2026-07-11T10:00", None), ("NaN", "deposit", "2026-07-11T10:00", None),
         (None, "deposit", "2026-07-11T10:00:05", None), ("-3", " ", "2026-07-11T10:00", None), ("1", "deposit", "soon", None)],
        "amount string, tx_type string, timestamp string, device_id string",
    )
    got = S.validate_payloads(rows).collect()
    assert [r.reject_reason for r in got] == [None, "invalid amount", "invalid amount", None, "missing type", "invalid time"]
    assert got[3].parsed_amount == 0.0 and got[3].parsed_time == dt.datetime(2026, 7, 11, 10, 0, 5)
    checked = S.validate_payloads(rows)
    assert S.accepted(checked).count() + S.quarantined(checked).count() == 6


def test_device_encryption_round_trip(spark):
    key = "0123456789abcdef"
    rows = spark.createDataFrame([("phone",), ("",), (None,)], "d string").withColumn("c", C.encrypt_device(F.col("d"), key))
    got = rows.withColumn("back", C.decrypt_device(F.col("c"), key)).collect()
    assert [r.back for r in got] == ["phone", "", None] and got[0].c != "phone"
    plain = spark.createDataFrame([("never encrypted",)], "c string")
    assert plain.select(C.decrypt_device(F.col("c"), key)).first()[0] == "never encrypted"


def test_conform_is_idempotent(spark):
    old = spark.createDataFrame([(1, None)], "event_id long, amount double")
    new = S.conform(old, S.TRANSACTIONS, {"amount": 0.0, "tx_type": "deposit"})
    assert new.schema.names == S.TRANSACTIONS.names and new.first().tx_type == "deposit"
    assert S.conform(new, S.TRANSACTIONS, {"amount": 0.0, "tx_type": "deposit"}).collect() == new.collect()


def test_csv_models_and_records(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, "W", 0)], "TransactionAmt double, ProductCD string, isFraud int")
    S.export_csv(rows, str(tmp_path / "csv"))
    assert S.read_csv(spark, str(tmp_path / "csv"), rows.schema).collect() == rows.collect()
    S.append(rows, str(tmp_path / "t"))
    S.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    record = S.api_records(spark.createDataFrame([(DAY, None)], "at timestamp, x string"), "at").first().record
    assert record == '{"at":"2026-07-01T00:00:00"}'


def test_write_back_backlog_triggers_and_latency(spark):
    rows = txns(spark, [(k, 1, 1.0, k, "a") for k in range(30)])
    scored = spark.createDataFrame([("0", 0.5, DAY)], "transaction_id string, score double, scored_at timestamp")
    assert workflow.write_back(rows, scored).filter("scored").count() == 1
    assert workflow.backlog(rows, scored).count() == 29
    trained = spark.createDataFrame([], "user_id long, n_rows long")
    assert workflow.train_triggers(rows, trained).count() == 1
    assert workflow.train_triggers(rows.filter("event_id < 29"), trained).count() == 0
    logged = S.with_latency(spark.createDataFrame([(DAY, DAY + dt.timedelta(milliseconds=5))], "ingested_at timestamp, scored_at timestamp"))
    assert reports.latency_summary(logged, 2.0).first().asDict() == {"n": 1, "mean": 5.0, "median": 5.0, "least": 5.0, "greatest": 5.0, "per_second": 0.5}


def test_preparation_edges(spark):
    rows = spark.createDataFrame([(1.0, "a", 0), (None, None, 1), (3.0, "b", 1)], "x double, t string, y int")
    assert preparation.impute(rows).filter("x = 2.0 AND t = 'unknown'").count() == 1
    assert preparation.one_hot(rows, ["t"]).columns == ["x", "y", "t_a", "t_b"]
    with pytest.raises(ValueError):
        preparation.one_hot(rows, ["t"], most=1)
    defaults = {r["column"]: r["default"] for r in preparation.feature_defaults(rows, ["x", "y"]).collect()}
    assert defaults == {"x": 2.0, "y": 1.0}
    table = spark.createDataFrame([(0, "TransactionAmt", 1.0), (1, "other", 4.0)], "pos int, column string, default double")
    vector = scoring.default_vector(rows.select(F.col("x").alias("amt")), table).first()
    assert (vector.TransactionAmt, vector.other) == (1.0, 4.0)
    assert preparation.table_profile(rows).first().asDict() == {"n_rows": 3, "n_columns": 3, "names": "x,t,y"}


def test_metrics_on_empty_and_one_class(spark):
    empty = spark.createDataFrame([], "label int, score double")
    assert evaluation.binary_metrics(empty).first().tp == 0
    assert evaluation.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first().auc is None
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert evaluation.roc_auc(tied).first().auc == 0.5


def test_stream_flags_late_rows_and_survives_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    txns(spark, [(1, 1, 1.0, 0, "a"), (2, 1, 2.0, 10, "a"), (2, 1, 2.0, 10, "a")]).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: jobs.run_available(jobs.stream_features(jobs.unique(S.read_stream(spark, folder, S.TRANSACTIONS))), out, at)
    run()
    txns(spark, [(3, 1, 3.0, 5, "b"), (4, 1, 4.0, 20, "a")]).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = {r.event_id: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[3].late and not got[4].late
    assert (got[4].rolling_count_10, got[4].prior_max, got[4].device_change) == (3, 3.0, 0)


def test_alert_sink_replays_a_batch_once(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1, "x", 0.9, True)], "transaction_id string, user_id long, tx_type string, score double, is_anomaly boolean")
    sink = jobs.alert_sink(str(tmp_path), lambda r: r, workflow.raised_alerts)
    sink(rows, 0)
    sink(rows, 0)
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 1


def test_a_device_of_many_users_links_them_all(spark):
    rows = spark.range(1500).select(F.col("id").alias("user_id"), F.lit("kiosk").alias("device_id"))
    found = behaviour.shared_devices(rows).agg(F.min("links"), F.max("links"), F.max("widest_device")).first()
    assert tuple(found) == (1499, 1499, 1500)


def test_forests_score_a_users_rows_in_parts(spark, monkeypatch):
    """A row's score is its own: neither other rows nor how they are dealt change it."""
    rows = txns(spark, [(k, 1 + (k % 5 == 0), float(k * 37 % 101), k, "a") for k in range(300)])
    features = behaviour.behaviour_features(rows).cache()
    forests = models.train_forests(features, trees=20).cache()
    whole = {r.event_id: r.margin for r in models.score_forests(features, forests).collect()}
    assert len(whole) == 300

    def less_first(margins):
        return [round(margins[k] - margins[min(margins)], 9) for k in sorted(margins)]

    some = {r.event_id: r.margin for r in models.score_forests(features.filter("event_id IN (1, 2, 3, 4)"), forests).collect()}
    assert less_first(some) == less_first({k: whole[k] for k in some})
    monkeypatch.setattr(models, "SCORED_ROWS", 7)
    assert {r.event_id: r.margin for r in models.score_forests(features, forests).collect()} == pytest.approx(whole)
    plan = models.score_forests(features, forests)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_amounts_by_day_in_any_spelling(spark):
    from ledgerlark.operators import reports

    rows = [(1, 10.0, t, "2024-01-01 10:00:00") for t in ("Deposit", "deposit", "withdraw", "Withdraw", "transfer")]
    frame = spark.createDataFrame(rows, "user_id long, amount double, tx_type string, timestamp string")
    got = reports.daily_amounts(frame).collect()
    assert [(r.deposit, r.withdraw) for r in got] == [(20.0, 20.0)]


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 1e12, 2.0, None, 2.0], [float(i * i % 997) for i in range(3000)] + [5.0] * 2000 + [1e300, -1e300]])
def test_quantiles_equal_brute_force(spark, values):
    df = spark.createDataFrame([(v, 1) for v in values], "v double, w int").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["column"]: r.quantiles for r in ranks.quantiles(df, {"v": F.col("v"), "w": F.col("w")}, shares).collect()}
    held = [v for v in values if v is not None]
    assert got["v"] == (pytest.approx(list(np.quantile(held, shares))) if held else [None] * 5)
    assert got["w"] == ([1.0] * 5 if values else [None] * 5)
    for place in (1, 2, len(held)):
        expected = sorted(held)[place - 1] if 0 < place <= len(held) else None
        assert ranks.smallest(df, F.col("v"), place).first().x == expected


def test_ranks_with_an_outlier(spark):
    """One far value leaves the others in slices of their own; sums below equal plain ones."""
    values = [float(i) for i in range(5000)] + [1e18]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "x double, n long")
    below = {r.x: r.c_n for r in ranks.cumulated(df, "x", ["n"]).collect()}
    assert below == {v: sum(i % 3 for i in range(k)) for k, v in enumerate(values)}


def test_auc_ks_and_psi_equal_brute_force(spark):
    """Over thousands of values, of which a third are one value and one lies far out."""
    rng = np.random.default_rng(11)
    x = np.where(rng.random(6000) < 1 / 3, 0.25, rng.normal(size=6000))
    x[7] = 1e18
    y, first = rng.integers(0, 2, 6000), rng.random(6000) < 0.4
    data = [*zip(x.tolist(), y.tolist(), first.tolist(), strict=True), (None, 1, True), (0.5, None, None)]
    rows = spark.createDataFrame(data, "x double, y int, first boolean").repartition(3)
    auc = evaluation.roc_auc(rows, "y", "x").first()
    ups, downs = x[y == 1], np.sort(x[y == 0])
    won = (np.searchsorted(downs, ups, "left") + np.searchsorted(downs, ups, "right")).sum() / 2
    assert (auc.positives, auc.negatives, auc.auc) == (len(ups), len(downs), pytest.approx(won / len(ups) / len(downs)))
    one, two = np.sort(x[first]), np.sort(np.r_[x[~first], 0.5])
    at = np.union1d(one, two)
    far = np.abs(np.searchsorted(one, at, "right") / len(one) - np.searchsorted(two, at, "right") / len(two)).max()
    assert evaluation.ks(rows, F.col("first"), "x").first().ks == pytest.approx(far)
    cuts = np.quantile(one, np.arange(1, 10) / 10)
    shares = [np.maximum(np.bincount(np.searchsorted(cuts, v, "left"), minlength=10) / len(v), 1e-4) for v in (one, two)]
    here = np.flatnonzero(sum(np.bincount(np.searchsorted(cuts, v, "left"), minlength=10) for v in (one, two)))
    found = evaluation.psi(rows, F.col("first"), "x").first()
    e, a = (s[here] for s in shares)
    assert (found.bins, found.psi) == (len(here), pytest.approx(((a - e) * np.log(a / e)).sum()))
    none = rows.filter("x > 1e20")
    assert evaluation.ks(none, F.col("first"), "x").first().ks is None
    assert evaluation.roc_auc(none, "y", "x").first().auc is None


@pytest.mark.parametrize("gathered", [1, 20])
def test_quantiles_narrow_until_few_values_are_left(spark, monkeypatch, gathered):
    rng = np.random.default_rng(3)
    values = {"even": rng.normal(size=3000), "twos": rng.integers(0, 2, 3000), "heavy": rng.zipf(1.3, 3000).clip(max=10**9)}
    df = spark.createDataFrame(list(zip(*[v.astype(float).tolist() for v in values.values()], strict=True)), list(values))
    shares = [0.0, 0.333, 0.5, 1.0]
    monkeypatch.setattr(ranks, "GATHERED", gathered)
    got = {r["column"]: r.quantiles for r in ranks.quantiles(df, {c: F.col(c) for c in values}, shares).collect()}
    assert got == {c: pytest.approx(list(np.quantile(v.astype(float), shares))) for c, v in values.items()}
    assert ranks.smallest(df, F.col("even"), 1234).first().x == np.sort(values["even"])[1233]


# forests

def test_trees_of_values_that_are_neighbours_as_doubles():
    """Where rounding puts a cut on the greater of two ends, neither child may be empty."""
    x = np.zeros((40, 2))
    x[:, 1] = np.where(np.arange(40) < 20, 1.0, np.nextafter(1.0, 2))
    nodes = models._grow(x, np.stack([np.arange(40)] * 100), np.random.default_rng(1))
    assert [len(t) for t in models._packed(nodes)["features"]] == [3] * 100
    assert len(set(models._isolation(x, nodes, 40))) == 1


def test_trees_as_bytes_and_rows_by_themselves():
    rng = np.random.default_rng(2)
    x = np.floor(rng.random((70, 3)) * 9)
    nodes = models._grow(x, np.stack([rng.choice(70, 64, replace=False) for _ in range(20)]), rng)
    packed = models._packed(nodes)
    assert all((a == b).all() for a, b in zip(models._unpacked(packed[::-1]), nodes, strict=True))

    def walked(row):
        depth = 0.0
        for t in packed.itertuples():
            f, cut, n = np.frombuffer(t.features, np.int8), np.frombuffer(t.cuts), 0
            while f[n] >= 0:
                n = 2 * int((f[:n] >= 0).sum()) + 1 + int(row[f[n]] > cut[n])
            depth += cut[n]
        return depth / len(packed)

    together = models._path_lengths(x, nodes)
    assert together.tolist() == [walked(r) for r in x] == [models._path_lengths(x[k : k + 1], nodes)[0] for k in range(len(x))]


def test_scores_by_own_forests_with_and_without_busy_users(spark):
    rows = [(k, str(k), 1 + k % 3 + (k > 130), float(k * 37 % 101), "Deposit", DAY + dt.timedelta(minutes=7 * k), "ab"[k % 7 == 0]) for k in range(200)]
    features = behaviour.behaviour_features(spark.createDataFrame(rows, S.TRANSACTIONS))
    shares = spark.createDataFrame([(1, 0.1)], "user_id long, contamination double")
    wanted = sorted(map(tuple, models.score_forests(features, models.train_forests(features, shares, trees=5)).collect()))
    for most in (1 << 16, 65, 1):
        assert sorted(map(tuple, models.own_forest_scores(features, shares, trees=5, most=most).collect())) == wanted
    assert {r[1] for r in wanted} == {1, 2, 3} and sum(r[4] for r in wanted) > 3


def test_forests_of_many_users_come_from_few_calls(spark):
    """A call of Python for each user costs far more than the user's rows; together trees are what they are alone."""
    rng = np.random.default_rng(3)
    x, sizes = np.floor(rng.random((150, 3)) * 9), [1, 40, 30, 79]
    samples = [a + np.stack([rng.choice(n, min(n, 32), replace=False) for _ in range(4)]) for a, n in zip(np.cumsum([0, *sizes]), sizes)]
    together = models._packed(models._grow_all(x, samples, [np.random.default_rng(k) for k in range(4)]))
    alone = [models._packed(models._grow(x, s, np.random.default_rng(k))) for k, s in enumerate(samples)]
    assert together[["features", "cuts"]].values.tolist() == [r for a in alone for r in a[["features", "cuts"]].values.tolist()]
    features = behaviour.behaviour_features(txns(spark, [(k, 1 + k % 3, float(k), k, "a") for k in range(100)]))
    forests = models.train_forests(features, trees=2)
    for found in (forests, models.score_forests(features, forests), models.own_forest_scores(features, trees=2)):
        assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_forests_cut_batches_at_users():
    batches = [pa.RecordBatch.from_pydict({"user_id": pa.array(u, pa.int64())}) for u in ([1, 1, 2], [], [2, 2], [2], [3], [3, 4, 4, 5], [6])]
    assert [b.column(0).to_pylist() for b in models._whole(iter(batches))] == [[1, 1], [2, 2, 2, 2], [3, 3, 4, 4], [5], [6]]


def test_the_population_model_walks_over_bins_and_cuts_between_all_few_values(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 97 != 0, (F.col("id") % 1999).cast("double")).alias("x"),
        F.when(F.col("id") % 1000 == 0, 7.0).otherwise((F.col("id") % 3).cast("double")).alias("few"),
        ((F.col("id") % 1999 >= 1900) | (F.col("id") % 1000 == 0)).cast("int").alias("y"),
    )
    model = models.train_population(rows, ["x", "few"], "y", rounds=3)
    x, few = model.stages[0].getSplitsArray()
    assert few == [float("-inf"), 0.5, 1.5, 4.5, float("inf")] and len(x) <= models.BINS + 1
    # half of the weight is the frauds', so half of the cuts lie among them
    assert sum(c >= 1900 for c in x[1:-1]) >= models.BINS // 3
    scored = models.score_population(rows, model, ["x", "few"])
    assert scored.columns == ["x", "few", "y", "population"]
    means = dict(scored.groupBy("y").agg(F.avg("population")).collect())
    assert means[0] < 0.4 < 0.6 < means[1] and scored.filter("population IS NULL").isEmpty()
