"""Graph view, drift, recalibration, folds and robust reasons: small cases against brute force."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import behaviour, drift, folds, graph
from ledgerlark.sources import tables as S

DAY = dt.datetime(2026, 7, 1)


def random_edges(seed, accounts=40, devices=35, n=60):
    rng = random.Random(seed)
    return [(rng.randrange(accounts), f"d{rng.randrange(devices)}") for _ in range(n)] + [(99, None), (None, "d1")]


def rings_of(edges):
    parent = {a: a for a, _ in edges if a is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    by_device = {}
    for a, d in edges:
        if a is not None and d is not None:
            x, y = sorted((find(a), find(by_device.setdefault(d, a))))
            parent[y] = x
    return {a: find(a) for a in parent}


@pytest.mark.parametrize("seed", range(3))
def test_rings_and_accounts_met(spark, tmp_path, seed):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, "account long, device string").repartition(3)
    want = rings_of(edges)
    got = {r.account: (r.ring, r.ring_size) for r in graph.rings(df, str(tmp_path)).collect()}
    assert got == {a: (c, list(want.values()).count(c)) for a, c in want.items()}
    on = {}
    for a, d in edges:
        if a is not None and d is not None:
            on.setdefault(d, set()).add(a)
    met = {r.account: r.met for r in graph.accounts_met(df).collect()}
    assert met == {a: len(set().union(*[on[d] for x, d in edges if x == a and d])) - 1 for a in {a for a, d in edges if a is not None and d}}


def test_a_long_chain_is_one_ring(spark, tmp_path):
    chain = spark.range(400).select(F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("account"), F.col("id").cast("string").alias("device"))
    got = graph.rings(chain, str(tmp_path)).select("ring", "ring_size").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 401)]


def test_no_links_at_all(spark, tmp_path):
    none = spark.createDataFrame([], "account long, device string")
    assert graph.rings(none, f"{tmp_path}/a").count() == 0
    one = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "account long, device string")
    assert sorted(map(tuple, graph.rings(one, f"{tmp_path}/b").collect())) == [(1, 1, 1), (2, 2, 1)]


def test_sketches_of_a_crowded_device_are_near(spark):
    """At 30,000 accounts the stated standard error is 0.8 %; three of them are allowed."""
    crowd = spark.range(30_000).select(F.col("id").alias("account"), F.lit("kiosk").alias("device"))
    met = graph.accounts_met(crowd).agg(F.min("met"), F.max("met")).first()
    assert all(abs(x - 29_999) < 0.024 * 30_000 for x in met)


def test_risk_travels_over_devices(spark, tmp_path):
    edges = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "account long, device string")
    seeds = spark.createDataFrame([(1, 1), (5, 1), (77, 1)], "account long, fraud int")
    got = {r.account: r.risk for r in graph.propagated(edges, seeds, str(tmp_path), rounds=2).collect()}
    # after one round: 1 has 0.75, 2 has 0.125, 3 and 4 none
    assert got == pytest.approx({1: 0.5 + 0.5 * (0.75 + 0.125) / 2, 2: 0.5 * ((0.75 + 0.125) / 2 + 0.0625) / 2, 3: 0.5 * 0.0625, 4: 0.0, 5: 1.0})


def test_customers_of_known_ids(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for k in range(200):
        c = k % 23
        rows.append((k, f"card{c}" if rng.random() < 0.8 else None, f"mail{c}" if rng.random() < 0.8 else None, DAY.date() - dt.timedelta(days=c), c))
    df = spark.createDataFrame(rows, "txn_id long, card string, email string, start date, truth int")
    found = graph.customers(df, {"card": ["card", "start"], "mail": ["email", "start"]}, "txn_id", str(tmp_path))
    got = df.join(found, "txn_id", "left").select("txn_id", "truth", "card", "email", F.coalesce("customer_id", "txn_id").alias("c")).collect()
    by_truth = {}
    for r in got:
        if r.card or r.email:
            by_truth.setdefault(r.truth, set()).add(r.c)
    assert len(set().union(*by_truth.values())) == sum(map(len, by_truth.values()))
    both = {r.truth for r in got if r.card and r.email}
    assert all(len(by_truth[t]) == 1 for t in both)
    shown = spark.createDataFrame([(DAY.date(), 3)], "d date, n int").select(graph.account_start("d", "n"))
    assert shown.first()[0] == DAY.date() - dt.timedelta(days=3)


# drift

def test_drift_of_features_by_period(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), None if k % 9 == 0 else float(x * x), "a" if k < 600 else "b", k < 600) for k, x in enumerate(np.r_[rng.normal(0, 1, 600), rng.normal(0.7, 1, 400)])]
    df = spark.createDataFrame(rows, "x double, y double, p string, r boolean").repartition(3)
    got = {(r.feature, r.period): r for r in drift.drift_table(df, ["x", "y"], F.col("p"), F.col("r")).collect()}
    for i, f in enumerate(("x", "y")):
        ref = np.array([r[i] for r in rows if r[3] and r[i] is not None])
        edges = np.quantile(ref, np.arange(1, 100) / 100)
        for p in "ab":
            mine = np.array([r[i] for r in rows if r[2] == p and r[i] is not None])
            far = max(abs((mine <= e).mean() - (ref <= e).mean()) for e in edges)
            a, e = (np.maximum(np.bincount(np.searchsorted(edges, v) // 10, minlength=10) / len(v), 1e-4) for v in (mine, ref))
            r = got[f, p]
            assert (r.n, r.ks, r.psi) == (len(mine), pytest.approx(far), pytest.approx(float(((a - e) * np.log(a / e)).sum())))
            exact = max(abs((mine <= v).mean() - (ref <= v).mean()) for v in np.r_[mine, ref])
            assert far <= exact + 1e-12 and exact - far <= 0.0101


def pav(cells):
    values = sorted(cells)
    out = {}
    for i, c in enumerate(values):
        out[c] = max(min(sum(cells[v][1] for v in values[j : k + 1]) / sum(cells[v][0] for v in values[j : k + 1]) for k in range(i, len(values))) for j in range(i + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_blocks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.random(), None if rng.random() < 0.02 else int(rng.random() < 0.3 + 0.4 * (k % 2))) for k in range(400)] + [(None, 1), (1.0, 1), (0.0, 0)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(3)
    cells = {}
    for s, y in rows:
        if s is not None and y is not None:
            c = min(int(s * 50), 49)
            n, p = cells.get(c, (0, 0))
            cells[c] = (n + 1, p + y)
    want = pav(cells)
    blocks = drift.isotonic_blocks(df, resolution=50)
    got = blocks.orderBy("low").collect()
    assert {c: r.rate for r in got for c in cells if r.low <= c <= r.high} == pytest.approx(want)
    assert all(a.rate < b.rate for a, b in zip(got, got[1:], strict=False)) and sum(r.n for r in got) == sum(n for n, _ in cells.values())
    applied = drift.recalibrated(df.withColumn("cell", drift.score_cell(F.col("score"), 50)), blocks, resolution=50).collect()
    assert len(applied) == len(rows)
    assert all(r.calibrated is None if r.score is None else r.calibrated == pytest.approx(want[r.cell]) for r in applied if r.cell in want or r.score is None)


def test_no_labels_give_no_blocks(spark):
    df = spark.createDataFrame([(0.5, None)], "score double, label int")
    assert drift.isotonic_blocks(df).count() == 0
    assert drift.recalibrated(df, drift.isotonic_blocks(df)).first().calibrated is None


# folds

def test_folds_leave_a_gap_and_leak_nothing(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(10), DAY + dt.timedelta(hours=5 * k), None if k % 11 == 0 else DAY + dt.timedelta(hours=5 * k + rng.randint(1, 400))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, entity long, t timestamp, known timestamp")
    found = folds.walk_forward(df, "t", "known", folds=3, embargo_days=5)
    got = found.collect()
    for k in (1, 2, 3):
        tests, trains = ([r for r in got if r.fold == k and r.role == role] for role in ("test", "train"))
        first = min(r.t for r in tests)
        assert trains and all(r.known + dt.timedelta(days=5) < first for r in trains)
        cut = DAY + dt.timedelta(hours=5 * 299 * k / 4)
        assert len(trains) == sum(1 for r in rows if r[3] and r[2] < cut and r[3] + dt.timedelta(days=5) < cut)
    assert sorted(r.id for r in got if r.role == "test") == [r[0] for r in rows if r[2] >= min(x.t for x in got if x.role == "test")]
    assert folds.leaks(found, "entity", "t", "known").count() == 0
    split = df.withColumns({"fold": F.lit(1), "role": F.when(F.col("id") % 3 == 0, "test").otherwise("train")})
    leaking = {r.id for r in folds.leaks(split, "entity", "t", "known").collect()}
    begins = {e: min(r[2] for r in rows if r[0] % 3 == 0 and r[1] == e) for e in range(10)}
    assert leaking == {r[0] for r in rows if r[0] % 3 and (r[3] is None or r[3] >= begins[r[1]])}
    assert folds.walk_forward(df.limit(0), "t", "known").count() == 0


# robust reasons

def test_robust_distances_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, str(k), k % 2, rng.choice([5.0, 7.0, None, rng.random() * 100]), "Deposit", DAY + dt.timedelta(minutes=k), "a") for k in range(160)]
    features = behaviour.behaviour_features(spark.createDataFrame(rows, S.TRANSACTIONS))
    got = {r.event_id: r.reasons for r in behaviour.robust_reasons(features, ["amount"], last=20).collect()}
    for k, _, u, amount, *_ in rows:
        past = [r[3] for r in rows if r[2] == u and r[0] < k][-20:]
        past = [x for x in past if x is not None]
        if amount is None or not past:
            assert got[k][0].z == 0
            continue
        middle = statistics.median(past)
        spread = statistics.median(abs(x - middle) for x in past) or 1.0
        assert got[k][0].z == pytest.approx(abs(amount - middle) / spread, abs=2e-6)


def test_robust_distances_of_users_whose_rows_lie_over_several_batches(spark):
    rng, rows = np.random.default_rng(3), []
    start = dt.datetime(2024, 1, 1)
    for e in range(400):
        user = [None, 1, 2, 2**60 + 1][int(rng.integers(4))]
        rows.append((e, str(e), user, start + dt.timedelta(minutes=int(rng.integers(300))), None if rng.random() < 0.2 else float(rng.integers(50)), float(rng.random())))
    features = spark.createDataFrame(rows, "event_id long, transaction_id string, user_id long, timestamp timestamp, amount double, ratio double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = behaviour.robust_reasons(features, ["amount", "ratio"], top=2, last=20)
        # medians are array work over rows in order, where each row and feature had collected its window
        assert "collect_list" not in found._jdf.queryExecution().toString()
        got = {r.event_id: {x.feature: x.z for x in r.reasons} for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for user in (None, 1, 2, 2**60 + 1):
        own = sorted((r for r in rows if r[2] == user), key=lambda r: (r[3], r[0]))
        for k, r in enumerate(own):
            for name, at in (("amount", 4), ("ratio", 5)):
                past = [x[at] for x in own[max(0, k - 20) : k] if x[at] is not None]
                wanted = 0.0
                if past and r[at] is not None:
                    middle = np.median(past)
                    wanted = abs(r[at] - middle) / (np.median(np.abs(np.array(past) - middle)) or 1.0)
                assert got[r[0]][name] == pytest.approx(wanted, abs=2e-6)
