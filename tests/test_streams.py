"""Registry, models in the stream, keyed processors, upserts and as-of joins: small cases against brute force."""

import collections
import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import asof, behaviour, evaluation, models
from ledgerlark.plans.queries import keyed_state
from ledgerlark.sources import files
from ledgerlark.sources import tables as S
from ledgerlark.sources.registry import ModelRegistry
from ledgerlark.sources.upserts import UpsertTable
from ledgerlark.streaming import jobs
from ledgerlark.streaming import scoring as live

DAY = dt.datetime(2026, 7, 1)


class State:
    """A state variable of one key."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return State()

    def getMapState(self, name, key, value):
        return Map()

    def registerTimer(self, at):
        self.timers.add(at)


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


# profiles

def walked(rows, mode):
    """Features row by row, as the history has them; rows come as batches."""
    n, highest, micros, last_id, device, last, out = 0, None, None, None, None, [], {}
    for batch in rows:
        for e, amount, at, d in sorted(batch, key=lambda r: (r[2], r[0])):
            late = micros is not None and (at, e) < (micros, last_id)
            mine = d or ""
            changed = device is None or mine != device
            out[e] = (
                0.0 if micros is None else (at - micros) / 1e6, round(sum(last) / len(last), 9) if last else 0.0, len(last),
                int(changed and not (mode == "scoring" and not mine)), n, highest, late,
            )
            if amount is not None:
                n, highest, last = n + 1, amount if highest is None else max(highest, amount), [*last, amount][-10:]
            if not late:
                micros, last_id, device = at, e, mine
    return out


@pytest.mark.parametrize("mode", ["training", "scoring"])
@pytest.mark.parametrize("seed", range(6))
def test_profiles_equal_a_walk_over_rows(mode, seed):
    rng = random.Random(seed)
    start = int(DAY.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    ids = itertools.count()
    batches = [
        [(next(ids), rng.choice([None, -3.0, 2.5, 40.0, rng.random()]), start + rng.randint(0, 50) * 1_000_000, rng.choice([None, "", "a", "b"])) for _ in range(rng.randint(1, 25))]
        for _ in range(5)
    ]
    p = jobs.Profile(mode)
    p.init(Handle())
    got = {}
    for batch in batches:
        frame = pd.DataFrame([(e, str(e), 7, a, "Deposit", pd.Timestamp(t, unit="us"), d) for e, a, t, d in batch], columns=["event_id", "transaction_id", "user_id", "amount", "tx_type", "timestamp", "device_id"])
        frame = frame.astype({"amount": float})
        cut = rng.randint(0, len(frame))
        for out in p.handleInputRows((7,), iter([frame[:cut], frame[cut:]]), None):
            for r in out.itertuples():
                got[r.event_id] = (r.delta_prev_seconds, round(r.rolling_mean_10, 9), r.rolling_count_10, r.device_change, r.prior_count, None if np.isnan(r.prior_max) else r.prior_max, r.late)
    assert got == walked(batches, mode)


@pytest.mark.parametrize("mode", ["training", "scoring"])
@pytest.mark.parametrize("seed", range(4))
def test_profiles_of_a_group_equal_a_walk_over_each_users_rows(mode, seed):
    rng = random.Random(seed)
    start = int(DAY.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    ids = itertools.count()
    batches = [
        [(rng.choice([7, -2, 2**60 + 1, 9]), next(ids), rng.choice([None, -3.0, 2.5, 40.0, rng.random()]), start + rng.randint(0, 50) * 1_000_000, rng.choice([None, "", "a", "b"])) for _ in range(rng.randint(1, 40))]
        for _ in range(6)
    ]
    p = jobs.Profile(mode)
    p.init(Handle())
    got = {}
    for batch in batches:
        frame = pd.DataFrame([(e, str(e), u, a, "Deposit", pd.Timestamp(t, unit="us"), d) for u, e, a, t, d in batch], columns=["event_id", "transaction_id", "user_id", "amount", "tx_type", "timestamp", "device_id"])
        for out in p.handleInputRows((3,), iter([frame.astype({"amount": float})]), None):
            for r in out.itertuples():
                got[r.event_id] = (r.delta_prev_seconds, round(r.rolling_mean_10, 9), r.rolling_count_10, r.device_change, r.prior_count, None if np.isnan(r.prior_max) else r.prior_max, r.late)
    wanted = {}
    for user in (7, -2, 2**60 + 1, 9):
        wanted |= walked([[r[1:] for r in batch if r[0] == user] for batch in batches], mode)
    assert got == wanted


# daily check

def judged(counts):
    found, days, total, squares = [], 0, 0, 0
    for day, n in sorted(counts.items()):
        days, total, squares = days + 1, total + n, squares + n * n
        values = [counts[d] for d in sorted(counts) if d <= day]
        mean, sd = np.mean(values), np.std(values) or 1.0
        z = (n - mean) / sd
        if total >= 10 and z >= 2 - 1e-12:
            found.append((day, n, round(z, 6), "High" if z >= 3 - 1e-12 else "Medium"))
    return found


def check_of(batches, delay_days=1):
    """Runs a DailyCheck over batches of day numbers with parts; the watermark follows the latest day."""
    c = jobs.DailyCheck(idle_days=30)
    c.init(Handle())
    found, latest = [], 0
    for batch in batches:
        frame = pd.DataFrame({"timestamp": pd.to_datetime([DAY + dt.timedelta(days=d) for d in batch])})
        list(c.handleInputRows((7,), iter([frame]), Mark(0)))
        latest = max([latest, *batch])
        base = int(DAY.replace(tzinfo=dt.UTC).timestamp()) * 1000
        mark = base + int((latest - delay_days) * 86_400_000)
        for at in sorted(t for t in c.handle.timers if t <= mark):
            c.handle.timers.discard(at)
            for out in c.handleExpiredTimer((7,), Mark(mark), None):
                found += [((r.day - DAY.date()).days, r.n, round(r.z, 6), r.severity) for r in out.itertuples()]
    return found, c


@pytest.mark.parametrize("seed", range(5))
def test_daily_check_in_any_grouping_and_with_late_rows(seed):
    rng = random.Random(seed)
    rows = [d + rng.random() for d in range(30) for _ in range(rng.choice([0, 1, 1, 2, 3, 9]))]
    wanted = judged({d: n for d, n in collections.Counter(int(x) for x in rows).items()})
    arrived = sorted(rows, key=lambda x: x + rng.random() * 0.9)
    for size in (1, 7, 50, len(arrived)):
        batches = [arrived[i : i + size] for i in range(0, len(arrived), size)]
        found, _ = check_of([*batches, [40.0]])
        assert found == wanted


def test_daily_check_leaves_out_rows_of_closed_days_and_forgets_idle_users():
    found, c = check_of([[0.5] * 12, [5.5] * 1, [0.6] * 50, [6.5], [200.0]])
    assert c.past.value is not None
    found, c = check_of([[0.5] * 12, [5.5], [0.6] * 50])
    assert c.past.value[1] == 12
    list(c.handleExpiredTimer((7,), Mark(10**15), None))
    list(c.handleExpiredTimer((7,), Mark(10**15), None))
    assert c.past.value is None and not c.open


@pytest.mark.parametrize("size", [1, 3, 30])
def test_closed_days_of_a_group_of_users(size):
    rng = random.Random(size)
    counts = {u: {d: rng.choice([1, 1, 2, 3, 9]) for d in range(30) if rng.random() < 0.8} for u in (7, 8, 2**60 + 1)}
    c = jobs.ClosedDays()
    c.init(Handle())
    found = collections.defaultdict(list)
    for first in range(0, 30, size):
        rows = [(u, (DAY + dt.timedelta(days=d)).date(), n) for u, by in counts.items() for d, n in by.items() if first <= d < first + size]
        rng.shuffle(rows)
        frame = pd.DataFrame(rows, columns=["user_id", "day", "n"])
        if rows:
            for out in c.handleInputRows((3,), iter([frame[:2], frame[2:]]), None):
                for r in out.itertuples():
                    found[r.user_id].append(((r.day - DAY.date()).days, r.n, round(r.z, 6), r.severity))
    assert found == {u: w for u, by in counts.items() if (w := judged(by))} and found


def test_closed_days_forget_idle_users_and_begin_them_anew():
    c = jobs.ClosedDays(idle_days=30)
    c.init(Handle())

    def users(*rows):
        frame = pd.DataFrame([(u, (DAY + dt.timedelta(days=d)).date(), n) for u, d, n in rows], columns=["user_id", "day", "n"])
        list(c.handleInputRows((3,), iter([frame]), None))
        held = c.past.value[0]
        return {held[k]: held[k + 2] for k in range(0, len(held), 5)}

    assert users((1, 0, 12), (2, 0, 5), (2, 25, 1)) == {1: 12, 2: 6}
    assert users((2, 31, 1)) == {2: 7}
    assert users((2, 70, 3), (1, 70, 4)) == {1: 4, 2: 3}


# registry

@pytest.fixture(scope="module")
def history(spark):
    rows = [(k, str(k), 1 + k % 3, float(k * 37 % 101), "Deposit", DAY + dt.timedelta(minutes=7 * k), "ab"[k % 7 == 0]) for k in range(150)]
    return spark.createDataFrame(rows, S.TRANSACTIONS)


def test_registry_keeps_versions_and_compacts(spark, history, tmp_path):
    registry = ModelRegistry(spark, f"{tmp_path}/models", buckets=4)
    assert registry.latest() == 0 and registry.trained().count() == 0 and registry.forests(0) is None and registry.population(0) is None
    assert live.retrain(registry, history.filter("event_id < 100 AND user_id <> 3"), trees=5) == 1
    assert live.retrain(registry, history.filter("event_id < 100 AND user_id <> 3"), trees=5) is None
    assert live.retrain(registry, history.filter("event_id < 100 OR user_id = 1"), trees=5) == 2
    assert {r.user_id: (r.n_rows, r.version) for r in registry.trained().collect()} == {1: (50, 2), 2: (33, 1), 3: (33, 2)}
    assert {r.user_id: r.n_rows for r in registry.trained(1).collect()} == {1: 34, 2: 33}
    features = behaviour.behaviour_features(history, "scoring")
    before = {v: sorted(map(tuple, models.score_forests(features, registry.forests(v)).collect())) for v in (1, 2)}
    assert registry.compact() == 3
    assert sorted(map(tuple, models.score_forests(features, registry.forests(3)).collect())) == before[2] != before[1]
    assert sorted(map(tuple, models.score_forests(features, registry.forests(1)).collect())) == before[1]
    assert {r.user_id for r in registry.forests(3, spark.createDataFrame([(2,), (9,)], "user_id long")).collect()} == {2}


def test_a_version_is_published_once(spark, tmp_path):
    files.write_once(spark, f"{tmp_path}/a/1.json", "é")
    assert files.read(spark, f"{tmp_path}/a/1.json") == "é" and files.names(spark, f"{tmp_path}/a") == ["1.json"]
    with pytest.raises(FileExistsError):
        files.write_once(spark, f"{tmp_path}/a/1.json", "b")


def test_a_version_published_midway_counts_from_the_next_batch_on(spark, history, tmp_path):
    registry, at = ModelRegistry(spark, f"{tmp_path}/models", buckets=4), str(tmp_path)
    S.land_in_order(history.filter("event_id < 75"), f"{at}/landed/0", "timestamp")
    S.land_in_order(history.filter("event_id >= 75"), f"{at}/landed/1", "timestamp")

    def then(scored, batch):
        if not batch:
            registry.publish(forests=models.train_forests(behaviour.behaviour_features(history), trees=5))

    with keyed_state(spark):
        stream = live.model_inputs(jobs.stream_features(S.read_stream(spark, f"{at}/landed/*", S.TRANSACTIONS, files=1), mode="scoring"))
        sink = live.model_sink(registry, at, then)
        jobs.run_batches(stream, sink, f"{at}/checkpoint", mode="append")
    scored = spark.read.parquet(f"{at}/scored")
    by_batch = {(r.batch, r.version, r.known) for r in scored.select("batch", "version", F.col("personal").isNotNull().alias("known")).distinct().collect()}
    assert by_batch == {(b, min(b, 1), b > 0) for b in range(max(b for b, _, _ in by_batch) + 1)} and len(by_batch) > 1
    # the first batch again, after the version came: the pin holds, and nothing is written twice
    spark.read.schema(stream.schema).parquet(f"{at}/features/batch=0").write.parquet(f"{at}/again")
    sink(spark.read.parquet(f"{at}/again"), 0)
    assert spark.read.parquet(f"{at}/scored").count() == 150
    assert spark.read.parquet(f"{at}/scored/batch=0").select("version").distinct().collect()[0][0] == 0


def test_grown_users_of_a_micro_batch(spark, history, tmp_path):
    registry = ModelRegistry(spark, f"{tmp_path}/models", buckets=4)
    registry.publish(forests=models.train_forests(behaviour.behaviour_features(history.filter("user_id = 1")), trees=2))
    scored = spark.createDataFrame([(1, 49), (1, 12), (2, 40), (3, 5)], "user_id long, prior_count long")
    assert {(r.user_id, r.n) for r in live.grown(scored, registry).collect()} == {(2, 41)}


def test_retraining_at_the_end_of_a_batch(spark, history, tmp_path):
    registry = ModelRegistry(spark, f"{tmp_path}/models", buckets=4)
    then = live.retraining(registry, lambda: history, growth=1.2, trees=2)

    def batch(last):
        rows = history.filter(F.col("event_id") <= last)
        then(rows.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("prior_count"), F.max("timestamp").alias("timestamp")), 0)
        return {r.user_id: (r.n_rows, r.version) for r in registry.trained().collect()}

    assert batch(80) == {}
    assert batch(89) == {1: (30, 1), 2: (30, 1), 3: (30, 1)}
    assert batch(104) == {1: (30, 1), 2: (30, 1), 3: (30, 1)}
    assert batch(107) == {1: (36, 2), 2: (36, 2), 3: (36, 2)}
    assert batch(107) == {1: (36, 2), 2: (36, 2), 3: (36, 2)} and registry.latest() == 2


# upserts

CHANGES = "k long, at timestamp, seq long, value string"


def table_of(spark, folder):
    return UpsertTable(spark, folder, spark.createDataFrame([], CHANGES).schema, "k", ["at", "seq"], buckets=4)


def changes_of(seed, n=120):
    rng = random.Random(seed)
    return [(rng.randint(0, 20), DAY + dt.timedelta(hours=rng.randint(0, 99)), i, rng.choice(["x", "y", None])) for i in range(n)]


def last_of(changes, until=None):
    out = {}
    for k, at, seq, value in changes:
        if until is None or at <= until:
            old = out.get(k, (None, None, None, 0))
            new = (at, seq, value) if old[0] is None or (at, seq) > old[:2] else old[:3]
            out[k] = (*new, old[3] + 1)
    return out


def state_of(df):
    return {r.k: (r["at"], r.seq, r.value, r.n) for r in df.collect()}


@pytest.mark.parametrize("groups", [1, 3])
def test_upserts_in_any_grouping_and_replayed(spark, tmp_path, groups):
    changes, table, horizon = changes_of(groups), table_of(spark, str(tmp_path)), DAY + dt.timedelta(hours=40)
    for b in range(groups):
        rows = spark.createDataFrame([*changes[b::groups], (None, DAY, 1, "x"), (1, None, 1, "x")], CHANGES)
        table.apply(rows, b)
        table.apply(rows, b)
        if b == 1:
            table.compact(horizon)
    assert state_of(table.read()) == last_of(changes)
    for hours in (41, 70):
        until = DAY + dt.timedelta(hours=hours)
        assert state_of(table.read(until)) == last_of(changes, until)
    table.compact(horizon)
    table.apply(spark.createDataFrame(changes[:5], CHANGES), 0)
    assert state_of(table.read()) == last_of(changes)
    assert table.compact(DAY + dt.timedelta(hours=60)) > 0
    assert table.compact(DAY + dt.timedelta(hours=200)) > 0 and table.compact(DAY + dt.timedelta(hours=200)) == 0
    assert state_of(table.read()) == last_of(changes)
    with pytest.raises(ValueError, match="folded"):
        table.read(DAY)
    with pytest.raises(ValueError, match="already"):
        table.compact(DAY)


def test_compaction_rewrites_touched_buckets_alone(spark, tmp_path):
    table = table_of(spark, str(tmp_path))
    assert table.read().count() == 0
    table.apply(spark.createDataFrame([(k, DAY, 1, "x") for k in range(50)], CHANGES), 0)
    table.compact(DAY)
    table.apply(spark.createDataFrame([(7, DAY + dt.timedelta(days=1), 1, "y")], CHANGES), 1)
    before = table.manifest()["current"]
    assert table.compact(DAY + dt.timedelta(days=2)) == 1
    after = table.manifest()["current"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r.value for r in table.read().filter("k = 7").collect()} == {"y"} and table.read().count() == 50


# as-of joins

@pytest.mark.parametrize("itself", [True, False])
@pytest.mark.parametrize("most", [5, 1 << 16])
def test_values_carried_over_slices(spark, most, itself):
    rng = random.Random(most)
    rows = [(rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.05 else DAY + dt.timedelta(hours=rng.randint(0, 60)), i, rng.choice([None, "a", "b"]), rng.choice([None, 1, -1])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, at timestamp, i long, v string, d int").repartition(5)
    got = {r.i: (r["last"], r.total) for r in asof.carried(df, "k", ["at", "i"], {"last": F.col("v")}, {"total": F.col("d")}, most=most, slices=7, itself=itself).collect()}
    want, state = {}, collections.defaultdict(lambda: (None, 0))
    for k, _, i, v, d in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        before, state[k] = state[k], (v or state[k][0], state[k][1] + (d or 0))
        want[i] = state[k] if itself else before
    assert got == want


def test_busy_keys_are_cut(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 1_000_000).alias("at"), "id")
    sizes = [r["count"] for r in asof.slices_of(df, "k", F.unix_micros("at"), most=100, slices=16).groupBy("_slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1000
    assert {r[0] for r in asof.slices_of(df, "k", F.unix_micros("at")).select("_slice").distinct().collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_velocity_of_busy_users_equals_the_windows(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, str(i), rng.choice([1, 1, 2, 3]), rng.choice([None, 0.25, -3.5, 100.0]), "Deposit", None if i % 50 == 0 else DAY + dt.timedelta(seconds=rng.choice([60, 1800, 3600]) * rng.randint(0, 200)), rng.choice([None, "a", "b", "c"]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, S.TRANSACTIONS).repartition(4)
    want, got = (sorted(map(tuple, behaviour.velocity(df, most=m, slices=5).collect())) for m in (10**9, 3))
    assert len(want) == 294 and got == want


@pytest.mark.parametrize("most", [3, 1 << 16])
def test_review_budget_of_busy_days(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.choice(["d1", "d1", "d2", None]), rng.choice([None, 0.1, 0.2, rng.random()])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, d string, s double").repartition(3)
    got = {r.k: (r.day, r["rank"], r.route) for r in evaluation.review_budget(df, F.col("d"), "s", "k", 4, most=most, slices=6).collect()}
    want = {}
    for day in ("d1", "d2", None):
        order = sorted((r for r in rows if r[1] == day), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want |= {r[0]: (day, n, "review" if n <= 4 else "auto") for n, r in enumerate(order, 1)}
    assert got == want


def test_admission_at_the_time(spark):
    h = lambda x: DAY + dt.timedelta(hours=x)
    txns = spark.createDataFrame([(i, 1, h(i)) for i in range(8)] + [(9, 2, h(3))], "txn_id long, user_id long, timestamp timestamp")
    toggles = spark.createDataFrame([(1, h(5)), (1, h(6))], "user_id long, at timestamp")
    alerts = spark.createDataFrame(
        [(1, h(0), h(3), "Low"), (1, h(1), None, "High"), (1, h(2), h(1), "Medium"), (1, h(3), None, None)],
        "user_id long, generated_at timestamp, resolved_at timestamp, severity string",
    )
    got = {r.txn_id: (r.pending, r.is_frozen, r.last_severity, r.reason) for r in asof.admission_at(txns, toggles, alerts, 2).collect()}
    assert got == {
        0: (0, False, None, None), 1: (1, False, "Low", None), 2: (2, False, "High", "pending alerts"), 3: (1, False, "Medium", None),
        4: (2, False, "Medium", "pending alerts"), 5: (2, True, "Medium", "frozen"), 6: (2, False, "Medium", "pending alerts"),
        7: (2, False, "Medium", "pending alerts"), 9: (0, False, None, None),
    }


def test_changes_are_grouped_once_for_known_and_new_keys(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, at timestamp, seq long").schema
    table = UpsertTable(spark, f"{tmp_path}/table", schema, "k", ["at", "seq"], buckets=2)
    at = lambda d: DAY.replace(tzinfo=None) + dt.timedelta(days=d)
    table.apply(spark.createDataFrame([(1, at(0), 1), (2, at(0), 1), (3, at(0), 2)], schema), 0)
    assert table.compact(at(1)) == len({n for n in (tmp_path / "table" / "changes" / "0").iterdir() if n.name.startswith("bucket=")})
    table.apply(spark.createDataFrame([(1, at(2), None), (2, at(-1), 9), (4, at(2), 1), (4, at(2), 3)], schema), 1)
    rows = table.read()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    assert sorted(tuple(r)[:4] for r in rows.collect()) == [(1, at(2), None, 2), (2, at(0), 1, 2), (3, at(0), 2, 1), (4, at(2), 3, 2)]
