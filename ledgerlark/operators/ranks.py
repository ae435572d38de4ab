"""Exact ranks and quantiles of columns of any size, in bounded tasks."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a column's values are cut into, as two to this power.
_LEVELS = 10
#: Shares at which values are cut to narrow a selection, and the accuracy of these cuts: ranks err by less than 1 / ACCURACY.
_CUTS, _ACCURACY = 1000, 10_000
#: Values of a bracket that the driver may take; with more, the bracket is cut again.
GATHERED = 100_000


def in_slices(values: DataFrame, x: str, counts: list[str]) -> DataFrame:
    """values, one per value of x, with slice; b_<count>: the sum of the smaller values' counts in the slice; t_<count>: the sum of all.

    Slices are in order of x and lie between approximate quantiles, so that outliers don't crowd the others into
    one; there is a fixed, small number of them. Rows come dealt by slice, so that grouping them by it needs no shuffle.
    """
    slices = 1 << _LEVELS
    shares = ", ".join(f"{k / slices}D" for k in range(1, slices))  # as text, for one call instead of one for each
    whole = values.agg(F.expr(f"percentile_approx(`{x}`, array({shares}))").alias("_cuts"), *[F.sum(c).alias(f"t_{c}") for c in counts])
    # a binary search for the number of cuts below x
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(_LEVELS))])
    below = F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(F.col("_cuts"), low + step - 1) < F.col(x), low + step).otherwise(low)
    )
    sliced = values.crossJoin(F.broadcast(whole)).withColumn("slice", below).drop("_cuts")  # one row
    inside = Window.partitionBy("slice").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.withColumns({f"b_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts})


def before_slice(c: str) -> Column:
    """The sum of c over the slices before, where there is a row for each slice."""
    return F.coalesce(F.sum(c).over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def cumulated(values: DataFrame, x: str, counts: list[str]) -> DataFrame:
    """values, one per value of x, with c_<count>: the sum of the smaller values' counts. No single task sorts all values."""
    sliced = in_slices(values, x, counts)
    sums = sliced.groupBy("slice").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    offsets = sums.select("slice", *[before_slice(f"_{c}").alias(f"_o_{c}") for c in counts])
    return sliced.join(F.broadcast(offsets), "slice").select(
        *values.columns, *[(F.col(f"b_{c}") + F.col(f"_o_{c}")).alias(f"c_{c}") for c in counts]
    )


#: A column's name and the two values, or None, between which its values count.
Bracket = tuple[str, float | None, float | None]


def _within(x: Column, low: float | None, high: float | None) -> Column:
    return x.isNotNull() & (F.lit(True) if low is None else x > low) & (F.lit(True) if high is None else x < high)


def _cut(df: DataFrame, columns: dict[str, Column], brackets: list[Bracket]) -> dict[Bracket, tuple[int, int, int, list[float]]]:
    """For each bracket, in one pass: how many values lie below, at its lower end and inside, and where the inside ones are cut."""
    grid = ", ".join(f"{k / _CUTS}D" for k in range(_CUTS + 1))  # as text, for one call instead of one for each
    xs = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])
    place = {name: f"x{i}" for i, name in enumerate(columns)}
    aggregates = []
    for i, (name, low, high) in enumerate(brackets):
        x = F.col(place[name])
        inside = F.when(_within(x, low, high), x)
        xs = xs.withColumn(f"b{i}", inside)
        ends = [F.lit(0), F.lit(0)] if low is None else [F.count_if(x < low), F.count_if(x == low)]
        aggregates += [*ends, F.count(f"b{i}"), F.expr(f"percentile_approx(b{i}, array({grid}), {_ACCURACY})")]
    row = xs.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggregates)]).first()
    return {b: tuple(row[4 * i : 4 * i + 4]) for i, b in enumerate(brackets)}


def _gather(df: DataFrame, columns: dict[str, Column], brackets: list[Bracket]) -> dict[Bracket, list[tuple[float, int]]]:
    """For each bracket, ends included: (value, number of values up to it) in order; the number below comes first, without a value."""
    tagged = []
    for i, (name, low, high) in enumerate(brackets):
        x = columns[name].cast("double")
        below = F.lit(False) if low is None else x < low
        counts = x.isNotNull() & (F.lit(True) if high is None else x <= high)
        tagged.append(F.struct(F.when(counts, F.lit(i)).alias("i"), F.when(~below, x).alias("x")))
    rows = df.select(F.inline(F.array(*tagged))).filter("i IS NOT NULL").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    found: dict[Bracket, list[tuple[float, int]]] = defaultdict(list)
    for i, x, n in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] is not None and math.isnan(r[1]), r[1] or 0.0)):
        here = found[brackets[i]]
        here.append((x, n + (here[-1][1] if here else 0)))
    return found


def _select(df: DataFrame, columns: dict[str, Column], places) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """How many values each column has, and its values at places(number of values), from 0.

    Approximate quantiles bracket each value and passes over df narrow the brackets, each to about a
    hundredth of a share, until at most GATHERED values lie in one. Those are counted and looked
    through; so a value is exact, and neither a task nor the driver meets more of them.
    """
    cuts = _cut(df, columns, [(name, None, None) for name in columns])
    totals = {name: cuts[name, None, None][2] for name in columns}
    wanted: dict[tuple[str, int], Bracket] = {
        (name, p): (name, None, None) for name, n in totals.items() for p in places(n) if 0 <= p < n
    }
    found: dict[tuple[str, int], float] = {}
    ready: dict[tuple[str, int], Bracket] = {}
    while wanted:
        for target, bracket in list(wanted.items()):
            below, at_low, inside, grid = cuts[bracket]
            (name, low, high), rank = bracket, target[1] - below - at_low
            if rank < 0 or rank >= inside:
                found[target] = low if rank < 0 else high
                del wanted[target]
                continue
            first = math.floor(((rank - 1) / inside - 4 / _ACCURACY) * _CUTS)
            last = math.ceil(((rank + 2) / inside + 4 / _ACCURACY) * _CUTS)
            closer = (name, grid[first] if first > 0 else low, grid[last] if last < _CUTS else high)
            wanted[target] = closer
            # a bracket stays as it is only around three values or fewer
            if closer == bracket or inside * (min(last, _CUTS) - max(first, 0)) / _CUTS + 2 * inside / _ACCURACY <= GATHERED:
                ready[target] = closer
                del wanted[target]
        if wanted:
            cuts = _cut(df, columns, list(dict.fromkeys(wanted.values())))
    if ready:
        gathered = _gather(df, columns, list(dict.fromkeys(ready.values())))
        for target, bracket in ready.items():
            found[target] = next(x for x, upto in gathered[bracket] if target[1] < upto)
    return totals, found


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> DataFrame:
    """column and quantiles (one for each share, between neighbours by proportion) of each of the columns.

    Exact; nulls don't count, and a column of nulls has null quantiles. Runs at once, in two passes
    over df, or more where it has very many rows.
    """
    totals, found = _select(df, columns, lambda n: {f(s * (n - 1)) for s in shares for f in (math.floor, math.ceil)})

    def at(name: str, share: float) -> float | None:
        place = share * (totals[name] - 1)
        a, b = found.get((name, math.floor(place))), found.get((name, math.ceil(place)))
        part = place - math.floor(place)
        return a if a == b or a is None else (1 - part) * a + part * b

    rows = [
        F.struct(F.lit(name).alias("column"), F.array(*[F.lit(at(name, s)).cast("double") for s in shares]).alias("quantiles"))
        for name in columns
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def smallest(df: DataFrame, value: Column, place: int | Callable[[int], int]) -> DataFrame:
    """One row with x: the value that is place-th in order, from 1; null if there are fewer. Runs at once, as quantiles does.

    place may be told from the number of values that aren't null.
    """
    at = place if callable(place) else lambda n: place
    totals, found = _select(df, {"x": value}, lambda n: {at(n) - 1})
    return df.sparkSession.range(1).select(F.lit(found.get(("x", at(totals["x"]) - 1))).cast("double").alias("x"))
