"""Queries of the graph view, drift by feature and period, recalibration, customer ids and leak-free folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import behaviour, drift, evaluation, folds, graph, scoring
from ledgerlark.plans.queries import _SCORED, _VIEWS3, _W, _scored, _shared, _views, query, r6, r9
from ledgerlark.sources import tables as S

#: Accounts are orders, and a device is what a supplier ships on a day under a flag.
_EDGES = "e AS (SELECT DISTINCT l_orderkey AS account, l_suppkey::VARCHAR || '~' || l_shipdate::DATE::VARCHAR || '~' || l_returnflag AS device FROM lineitem)"
_LINKS = "l AS (SELECT DISTINCT a.account AS x, b.account AS y FROM e a JOIN e b ON a.device = b.device AND a.account <> b.account)"
_CLOSURE = "r AS (SELECT DISTINCT account AS x, account AS y FROM e UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    device = F.concat_ws("~", F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag")
    return S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("account"), device.alias("device")).distinct()


@query(f"""WITH RECURSIVE {_EDGES}, {_LINKS}, {_CLOSURE}, c AS (SELECT x AS account, min(y) AS ring FROM r GROUP BY x),
s AS (SELECT ring, count(*) AS ring_size FROM c GROUP BY ring), m AS (SELECT x AS account, count(*) AS met FROM l GROUP BY x)
SELECT account, ring, ring_size, coalesce(met, 0) AS met FROM c JOIN s USING (ring) LEFT JOIN m USING (account)""")
def account_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of accounts over shared devices, and how many others each account has met on its own ones."""
    edges = _edges(spark, sf)
    return graph.rings(edges, _shared(spark)).join(graph.accounts_met(edges), "account").select("account", "ring", "ring_size", "met")


#: No short fraction, so that means of few accounts are no ties where they are rounded.
_SHARE = 0.3141592653589793
_RISK = f"""{_EDGES}, s AS (SELECT account, coalesce(is_fraud, false)::INT::DOUBLE AS seed FROM (SELECT DISTINCT account FROM e) LEFT JOIN v_labels ON account = alert_id)"""
for _k in range(3):
    _RISK += f""", d{_k} AS (SELECT device, avg({'seed' if not _k else 'risk'}) AS m FROM e JOIN {'s' if not _k else f'r{_k - 1}'} USING (account) GROUP BY device),
r{_k} AS (SELECT s.account, {1 - _SHARE!r}::DOUBLE * any_value(seed) + {_SHARE!r}::DOUBLE * avg(m) AS risk FROM s JOIN e ON s.account = e.account JOIN d{_k} USING (device) GROUP BY s.account)"""


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    seeds = S.labels(spark, sf).select(F.col("alert_id").alias("account"), F.col("is_fraud").cast("int").alias("fraud"))
    return graph.propagated(_edges(spark, sf), seeds, _shared(spark), share=_SHARE)


@query(f"WITH {_RISK} SELECT account, round(risk, 9) AS risk FROM r2")
def fraud_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return _risk(spark, sf).select("account", r9("risk"))


@query(_VIEWS3 + f""", {_RISK}, j AS (SELECT t.*, risk FROM t LEFT JOIN r2 ON txn = account),
w AS (SELECT *, (population IS NOT NULL)::INT * 2.0 + (personal IS NOT NULL)::INT + (risk IS NOT NULL)::INT AS weight FROM j)
SELECT txn, round(CASE WHEN weight > 0 THEN (coalesce(population * 2, 0) + coalesce(personal, 0) + coalesce(risk, 0)) / weight END, 9) AS fused,
  round(greatest(population, personal, risk) - least(population, personal, risk), 9) AS disagreement FROM w""")
def graph_view_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """The population's, the personal and the graph's view as one score, and how far they disagree."""
    views = {"population": 2.0, "personal": 1.0, "graph": 1.0}
    rows = _views(spark, sf).join(_risk(spark, sf).select(F.col("account").alias("txn"), F.col("risk").alias("graph")), "txn", "left")
    return rows.withColumns({"fused": scoring.fused(views), "disagreement": scoring.disagreement(*views)}).select("txn", r9("fused"), r9("disagreement"))


_DRIFTING = ["amt", "addr1", "c1"]
_PARTS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, strftime(txn_dt, '%Y') AS period, txn_dt < TIMESTAMP '1997-01-01' AS r FROM v_training" for f in _DRIFTING)


@query(f"""WITH t AS ({_PARTS}), q AS (SELECT feature, quantile_cont(x, [{', '.join(str(k / 100) for k in range(1, 100))}]) AS cuts FROM t WHERE r GROUP BY feature),
b AS (SELECT feature, period, r, len(list_filter(cuts, lambda c: c < x)) AS cell FROM t JOIN q USING (feature) WHERE x IS NOT NULL),
e AS (SELECT feature, cell, count(*) FILTER (WHERE r) AS e FROM b GROUP BY ALL), n AS (SELECT feature, period, cell, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT p.feature, p.period, e.cell, e, coalesce(n, 0) AS n FROM (SELECT DISTINCT feature, period FROM n) p JOIN e ON p.feature = e.feature
  LEFT JOIN n ON n.feature = e.feature AND n.period = p.period AND n.cell = e.cell),
f AS (SELECT *, abs(sum(n) OVER w / sum(n) OVER (PARTITION BY feature, period)::DOUBLE - sum(e) OVER w / sum(e) OVER (PARTITION BY feature, period)::DOUBLE) AS far
  FROM g WINDOW w AS (PARTITION BY feature, period ORDER BY cell)),
c AS (SELECT feature, period, cell // 10 AS bin, sum(n) AS n, sum(e) AS e, max(far) AS far FROM f GROUP BY ALL),
s AS (SELECT feature, period, n, far, greatest(n / sum(n) OVER (PARTITION BY feature, period)::DOUBLE, 0.0001) AS a, greatest(e / sum(e) OVER (PARTITION BY feature, period)::DOUBLE, 0.0001) AS x FROM c)
SELECT feature, period, sum(n)::BIGINT AS n, round(sum((a - x) * ln(a / x)), 6) AS psi, round(max(far), 6) AS ks FROM s GROUP BY feature, period""")
def drift_by_period(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.training(spark, sf)
    found = drift.drift_table(rows, _DRIFTING, F.date_format("txn_dt", "yyyy"), F.col("txn_dt") < F.lit("1997-01-01").cast("timestamp"))
    return found.select("feature", "period", "n", r6("psi"), r6("ks"))


_CELLS = f"""{_SCORED}, b AS (SELECT greatest(least(floor(score * 1000), 999), 0)::INT AS cell, count(*) AS n, sum(label)::BIGINT AS p FROM t GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY cell) AS i, sum(n) OVER (ORDER BY cell) AS cn, sum(p) OVER (ORDER BY cell) AS cp FROM b),
m AS (SELECT j.i AS j, k.i AS k, (k.cp - j.cp + j.p) / (k.cn - j.cn + j.n)::DOUBLE AS mean FROM i j JOIN i k ON k.i >= j.i),
u AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM m),
g AS (SELECT k AS i, max(least) AS rate FROM u GROUP BY k), h AS (SELECT cell, n, round(rate, 9) AS rate FROM i JOIN g USING (i))"""


@query(f"{_CELLS} SELECT min(cell) AS low, max(cell) AS high, sum(n)::BIGINT AS n, rate FROM h GROUP BY rate")
def isotonic_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return drift.isotonic_blocks(_scored(spark, sf)).select("low", "high", "n", r9("rate"))


@query(f"""{_CELLS}, c AS (SELECT label, score, rate FROM t JOIN h ON greatest(least(floor(score * 1000), 999), 0) = cell),
x AS (SELECT count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM c GROUP BY least(floor(score * 10), 9)), y AS (SELECT count(*) AS n, abs(avg(rate) - avg(label)) AS gap FROM c GROUP BY least(floor(rate * 10), 9))
SELECT round((SELECT sum(n * gap) / sum(n) FROM x), 6) AS before, round((SELECT sum(n * gap) / sum(n) FROM y), 6) AS after""")
def recalibration(spark: SparkSession, sf: str) -> DataFrame:
    """The expected calibration error of a score before and after isotonic recalibration."""
    rows = _scored(spark, sf)
    rows = drift.recalibrated(rows, drift.isotonic_blocks(rows)).withColumn("calibrated", F.round("calibrated", 9))
    errors = [evaluation.calibration_bins(rows, score=c).agg(F.sum("gap").alias(name)) for c, name in (("score", "before"), ("calibrated", "after"))]
    return errors[0].crossJoin(F.broadcast(errors[1])).select(r6("before"), r6("after"))  # one row each


_RECORDS = """f AS (SELECT o_custkey, min(o_orderdate::DATE) AS first FROM orders GROUP BY o_custkey),
x AS (SELECT o_orderkey AS txn_id, CASE WHEN o_orderpriority[1] <> '4' THEN c_mktsegment || c_nationkey::VARCHAR END AS card,
  CASE WHEN o_orderpriority[1] NOT IN ('4', '5') THEN round(c_acctbal)::BIGINT END AS addr, CASE WHEN o_orderpriority[1] <> '1' THEN c_name END AS email, first AS start
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN f USING (o_custkey))"""


@query(f"""WITH RECURSIVE {_RECORDS}, e AS (SELECT txn_id AS account, 'a' || card || '~' || addr::VARCHAR || '~' || start::VARCHAR AS device FROM x WHERE card IS NOT NULL AND addr IS NOT NULL
  UNION SELECT txn_id, 'b' || email || '~' || start::VARCHAR FROM x WHERE email IS NOT NULL), {_LINKS},
r AS (SELECT txn_id AS x, txn_id AS y FROM x UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x) SELECT x AS txn_id, min(y) AS customer_id FROM r GROUP BY x""")
def customer_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Customers put together again from cards, addresses and mail, with the day an account began, which a record's day counter tells."""
    orders, customer = S.table(spark, sf, "orders"), S.table(spark, sf, "customer")
    first = orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("_first"))
    rank = F.substring("o_orderpriority", 1, 1)
    records = (
        orders.join(first, "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("txn_id"), F.to_date("o_orderdate").alias("day"), F.date_diff(F.to_date("o_orderdate"), F.col("_first")).alias("counter"),
            F.when(rank != "4", F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))).alias("card"),
            F.when(~rank.isin("4", "5"), F.round("c_acctbal").cast("long")).alias("addr"), F.when(rank != "1", F.col("c_name")).alias("email"),
        ).withColumn("start", graph.account_start("day", "counter"))
    )
    found = graph.customers(records, {"a": ["card", "addr", "start"], "b": ["email", "start"]}, "txn_id", _shared(spark))
    return records.select("txn_id").join(found, "txn_id", "left").select("txn_id", F.coalesce("customer_id", "txn_id").alias("customer_id"))


_KNOWN = "x AS (SELECT o_orderkey AS txn_id, o_custkey AS entity, o_orderdate AS t, labeled_at AS known FROM orders LEFT JOIN v_labels ON o_orderkey = alert_id)"
_FOLDS = f"""{_KNOWN}, q AS (SELECT quantile_cont(epoch_us(t)::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS c FROM x),
a AS (SELECT x.*, k AS fold, CASE WHEN epoch_us(t) >= c[k] AND (k = 4 OR epoch_us(t) < c[k + 1]) THEN 'test' WHEN epoch_us(t) < c[k] AND epoch_us(known) + 7 * 86400000000 < c[k] THEN 'train' END AS role
  FROM x, q, range(1, 5) AS s(k))"""


def _known(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("timestamp").alias("t"))
    return rows.join(S.labels(spark, sf).select(F.col("alert_id").alias("txn_id"), F.col("labeled_at").alias("known")), "txn_id", "left")


@query(f"WITH {_FOLDS} SELECT txn_id, fold::INT AS fold, role FROM a WHERE role IS NOT NULL")
def walk_forward_folds(spark: SparkSession, sf: str) -> DataFrame:
    return folds.walk_forward(_known(spark, sf), "t", "known").select("txn_id", "fold", "role")


@query(f"""WITH {_FOLDS}, w AS (SELECT 'walk forward' AS split, entity, t, known, fold, role FROM a WHERE role IS NOT NULL
  UNION ALL SELECT 'random', entity, t, known, 1, CASE WHEN md5(txn_id::VARCHAR) < '4' THEN 'test' ELSE 'train' END FROM x),
f AS (SELECT split, fold, entity, min(t) AS first FROM w WHERE role = 'test' GROUP BY ALL)
SELECT w.split, count(*) AS rows, count(*) FILTER (WHERE role = 'train' AND first IS NOT NULL AND (known IS NULL OR known >= first)) AS leaking
FROM w LEFT JOIN f ON w.split = f.split AND w.fold = f.fold AND w.entity = f.entity GROUP BY w.split""")
def leakage(spark: SparkSession, sf: str) -> DataFrame:
    """How many train rows leak under walk-forward folds, which is none, and under a random split."""
    rows = _known(spark, sf)
    random = rows.withColumns({"fold": F.lit(1), "role": F.when(F.md5(F.col("txn_id").cast("string")) < "4", "test").otherwise("train")})
    found = None
    for name, split in (("walk forward", folds.walk_forward(rows, "t", "known")), ("random", random)):
        counts = split.agg(F.count(F.lit(1)).alias("rows")).crossJoin(folds.leaks(split, "entity", "t", "known").agg(F.count(F.lit(1)).alias("leaking")))  # one row each
        counts = counts.withColumn("split", F.lit(name))
        found = counts if found is None else found.unionByName(counts)
    return found.select("split", "rows", "leaking")


_LAST = f"{_W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
_ROBUST = ", ".join(
    f"{{'z': coalesce(round(abs({c} - median({c}) {_LAST}) / CASE WHEN mad({c}) {_LAST} > 0 THEN mad({c}) {_LAST} ELSE 1 END, 6), 0), 'feature': '{c}'}}" for c in behaviour.FEATURES
)


@query(f"""WITH f AS (SELECT event_id, user_id, timestamp, amount, ln(1 + greatest(amount, 0)) AS log_amount, hour(timestamp)::DOUBLE AS hour, (isodow(timestamp) - 1)::DOUBLE AS weekday,
  coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) {_W}))) / 1e6, 0) AS delta_prev_seconds,
  coalesce(avg(amount) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS rolling_mean_10,
  (count(amount) {_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))::DOUBLE AS rolling_count_10,
  (CASE WHEN lag(event_id) {_W}) IS NULL OR coalesce(device_id, '') <> lag(coalesce(device_id, '')) {_W}) THEN 1 ELSE 0 END)::DOUBLE AS device_change
  FROM v_transactions WHERE timestamp IS NOT NULL),
r AS (SELECT event_id, user_id, list_reverse_sort([{_ROBUST}])[1] AS top FROM f)
SELECT event_id, user_id, top.feature AS first, top.z AS z FROM r""")
def robust_reason_codes(spark: SparkSession, sf: str) -> DataFrame:
    found = behaviour.robust_reasons(behaviour.behaviour_features(S.transactions(spark, sf)))
    return found.select("event_id", "user_id", F.col("reasons")[0]["feature"].alias("first"), F.col("reasons")[0]["z"].alias("z"))
