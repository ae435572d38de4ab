"""Metrics, trust and drift over scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.asof import SLICED_ROWS, SLICES, carried
from ledgerlark.operators.ranks import before_slice, in_slices, quantiles, smallest

def binary_metrics(rows: DataFrame, label: str = "label", score: str = "score", cut: float = 0.5, *by: str) -> DataFrame:
    """Confusion counts and accuracy, precision, recall and F1, per group of by."""
    y, p = F.col(label) == 1, F.col(score) >= cut
    n = F.count(F.lit(1))

    def count(c: Column) -> Column:
        return F.count_if(c)

    tp, fp, fn, tn = count(y & p), count(~y & p), count(y & ~p), count(~y & ~p)
    return (
        rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by)
        .agg(
            tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
            F.try_divide(tp + tn, n).alias("accuracy"),
            F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        )
    )


def class_report(rows: DataFrame, label: str = "label", score: str = "score", cut: float = 0.5) -> DataFrame:
    """class (0 and 1), precision, recall, f1 and support of each."""
    k = binary_metrics(rows, label, score, cut)

    def one(name: int, hit: str, wrong: str, missed: str) -> Column:
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        share = lambda top, low: F.coalesce(F.try_divide(top, low), F.lit(0.0))
        return F.struct(
            F.lit(name).alias("class"), share(h, h + w).alias("precision"), share(h, h + m).alias("recall"),
            share(2 * h, 2 * h + w + m).alias("f1"), (h + m).alias("support"),
        )

    return k.select(F.inline(F.array(one(0, "tn", "fn", "fp"), one(1, "tp", "fp", "fn"))))


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """positives, negatives and auc: the share of pairs in order, ties counting half."""
    values = (
        rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("x"))
        .agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    )
    # negatives below a positive: those of its slice, and those of the slices before
    near = F.sum(F.col("p") * (F.col("b_n") + 0.5 * F.col("n")))
    slices = in_slices(values, "x", ["p", "n"]).groupBy("slice").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), near.alias("near"))
    return slices.withColumn("won", F.col("near") + F.col("p") * before_slice("n")).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
        F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n").cast("double")).alias("auc"),
    )


def calibration_bins(rows: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """bin, n, mean score and rate, and gap: the bin's share of the expected calibration error."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    per = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate")
    )
    total = F.sum("n").over(Window.partitionBy())  # as many rows as bins
    return per.withColumn("gap", F.col("n") / total * F.abs(F.col("mean_score") - F.col("rate")))


def conformal(calibration: DataFrame, test: DataFrame, alpha: float = 0.1, label: str = "label", score: str = "score") -> DataFrame:
    """One row: split-conformal threshold from calibration rows, and test coverage and mean set size."""
    wrong = F.when(F.col(label) == 1, 1 - F.col(score)).otherwise(F.col(score))
    threshold = smallest(calibration, wrong, lambda n: min(n, int(-(-(n + 1) * (1 - alpha) // 1)))).withColumnRenamed("x", "threshold")
    size = F.when(F.col(score) <= F.col("threshold"), 1).otherwise(0) + F.when(1 - F.col(score) <= F.col("threshold"), 1).otherwise(0)
    return test.crossJoin(F.broadcast(threshold)).groupBy("threshold").agg(
        F.avg(F.when(wrong <= F.col("threshold"), 1.0).otherwise(0.0)).alias("coverage"), F.avg(size).alias("mean_set_size")
    )


def champion_challenger(rows: DataFrame, period: Column, champion: str, challenger: str, label: str = "label", cut: float = 0.5) -> DataFrame:
    """Per period, F1 of two score columns and the challenger's gain."""
    rows = rows.withColumn("period", period)
    one, two = (binary_metrics(rows, label, s, cut, "period").select("period", F.col("f1").alias(s)) for s in (champion, challenger))
    return one.join(two, "period", "full").withColumn("gain", F.col(challenger) - F.col(champion))


def mcnemar(rows: DataFrame, first: str, second: str, label: str = "label", cut: float = 0.5) -> DataFrame:
    """Discordant counts of two deciders and McNemar's statistic with continuity correction."""
    y = F.col(label) == 1
    a, b = ((F.col(s) >= cut) == y for s in (first, second))
    only = rows.agg(F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"))
    off, n = F.abs(F.col("first_only") - F.col("second_only")) - 1, F.col("first_only") + F.col("second_only")
    return only.withColumn("statistic", F.coalesce(F.try_divide(F.pow(F.greatest(off, F.lit(0)).cast("double"), F.lit(2.0)), n), F.lit(0.0)))


#: Of 65,536 even draws, those from which on a Poisson(1) weight is at least 1, 2, ..: its distribution in 65,536ths, rounded up.
POISSON = [24110, 48219, 60274, 64292, 65297, 65498]
#: Draws that one md5 gives, of 16 bits each.
_DRAWS = 8


def bootstrap_rate(rows: DataFrame, value: Column, rounds: int = 100, level: float = 0.95, key: str = "txn_id") -> DataFrame:
    """mean, low and high of a mean, by a Poisson bootstrap whose weights are digits of the key's md5 with the round.

    Tasks add each row to `rounds` sums of theirs, which are all that is sent. Rows without a key or a value don't count.
    """
    hashes = F.array(*[F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{j}"))) for j in range(-(-rounds // _DRAWS))])
    rows = rows.select(value.cast("double").alias("v"), hashes.alias("h"), F.col(key)).filter(F.col(key).isNotNull() & F.col("v").isNotNull())
    drawn = rows.select("v", "h", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("k"))
    digits = F.substring(F.get("h", F.floor(F.col("k") / _DRAWS).cast("int")), 4 * (F.col("k") % _DRAWS) + 1, F.lit(4))
    # hexadecimal texts of one length are in order of their numbers
    weight = sum((F.when(F.col("d") >= f"{c:04x}", 1).otherwise(0) for c in POISSON), F.lit(0))
    weighed = drawn.select("k", "v", digits.alias("d")).select("k", "v", weight.alias("w"))
    draws = weighed.groupBy("k").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    return draws.agg(F.avg("m").alias("mean"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def psi(rows: DataFrame, is_reference: Column, column: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """One row: the population stability index of a column's other rows against the reference ones, over quantile bins of these."""
    rows = rows.select(F.col(column).cast("double").alias("x"), F.coalesce(is_reference, F.lit(False)).alias("r")).filter("x IS NOT NULL")
    shares = [i / bins for i in range(1, bins)]
    cuts = quantiles(rows, {"x": F.when(F.col("r"), F.col("x"))}, shares).select(F.col("quantiles").alias("_c"))
    b = F.size(F.filter("_c", lambda c: c < F.col("x")))
    both = rows.crossJoin(F.broadcast(cuts)).groupBy(b.alias("bin")).agg(F.count_if("r").alias("e"), F.count_if(~F.col("r")).alias("a"))
    over = Window.partitionBy()  # as many rows as bins
    e, a = (F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(over)), F.lit(0.0)), F.lit(floor)) for c in ("e", "a"))
    return both.withColumn("part", (a - e) * F.ln(a / e)).agg(F.sum("part").alias("psi"), F.count(F.lit(1)).alias("bins"))


def ks(rows: DataFrame, is_reference: Column, column: str) -> DataFrame:
    """One row: the largest distance between the distribution functions of a column's reference rows and its other ones."""
    r = F.coalesce(is_reference, F.lit(False))
    values = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(
        F.count_if(r).alias("e"), F.count_if(~r).alias("a")
    )
    far = F.try_divide(F.col("b_e") + F.col("e"), "t_e") - F.try_divide(F.col("b_a") + F.col("a"), "t_a")
    step = F.try_divide(F.col("e"), "t_e") - F.try_divide(F.col("a"), "t_a")
    slices = in_slices(values, "x", ["e", "a"]).groupBy("slice").agg(F.max(far).alias("top"), F.min(far).alias("low"), F.sum(step).alias("step"))
    before = before_slice("step")
    return slices.select(F.greatest(F.abs(before + F.col("top")), F.abs(before + F.col("low"))).alias("far")).agg(F.max("far").alias("ks"))


def review_budget(rows: DataFrame, day: Column, score: str, key: str, budget: int, most: int = SLICED_ROWS, slices: int = SLICES) -> DataFrame:
    """rows with day, rank and route: the day's `budget` riskiest go to review. Busy days are ranked in slices of scores."""
    risk = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    placed = rows.withColumns({"day": day, "_risk": risk})
    ranked = carried(placed, "day", ["_risk", key], {}, {"rank": F.lit(1)}, F.col("_risk"), most, slices).withColumn("rank", F.col("rank").cast("int"))
    return ranked.drop("_risk").withColumn("route", F.when(F.col("rank") <= budget, "review").otherwise("auto"))


def uncertainty_queue(rows: DataFrame, labelled: DataFrame, day: Column, score: str, key: str, most: int) -> DataFrame:
    """Per day, the `most` unlabelled rows whose scores are nearest to one half."""
    w = Window.partitionBy("day").orderBy(F.abs(F.col(score) - 0.5), key)
    return (
        rows.filter(F.col(score).isNotNull())
        .join(labelled.select(key), key, "left_anti")
        .withColumn("day", day)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= most)
    )
