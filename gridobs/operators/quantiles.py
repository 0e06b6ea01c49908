"""Exact quantiles of whole columns and of groups, none of which a single task has to hold."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridobs.operators.tables import cut, with_rows_of

#: Values that are numbered in one place.
FEW = 200_000
#: The same for values by group, and the cuts of a group's histogram (a square, less one: a value is placed among the coarse ones first).
FEW_OF_GROUP, SIDE, CUTS = 50_000, 16, 255


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """For each column the interpolated quantiles asked for; NULL ignored, None without values.

    A quantile lies between two ranks. Approximate quantiles, whose state is bounded, give a narrow range around each rank, and counts tell where in it the rank is;
    the range is narrowed until it holds a ``few`` values or one value, and only these are numbered. ``df`` is read a few times.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in wanted}
    if not x:
        return {}
    n = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(x.values()))).first()
    size = {c: n[f"n{i}"] for i, c in enumerate(x)}
    place = {(c, p): p * (size[c] - 1) for c in wanted for p in wanted[c] if size[c]}
    ranks = sorted({(c, f(at)) for (c, _), at in place.items() for f in (math.floor, math.ceil)})
    low: dict[tuple[str, int], float | None] = dict.fromkeys(ranks)
    high, before, inside = dict(low), dict.fromkeys(ranks, 0), {r: size[r[0]] for r in ranks}
    slack, whole = dict.fromkeys(ranks, 2e-4), set()

    def within(c: str, a: float | None, b: float | None) -> Column:
        return x[c].isNotNull() & (F.lit(True) if a is None else (x[c] >= F.lit(a)) & (x[c] <= F.lit(b)))

    while todo := [r for r in ranks if inside[r] > few and r not in whole and (low[r] is None or low[r] != high[r])]:
        around = {r: [min(1.0, max(0.0, (r[1] - before[r] + 0.5) / inside[r] + s * slack[r])) for s in (-1, 1)] for r in todo}
        row = df.agg(*(F.percentile_approx(F.when(within(r[0], low[r], high[r]), x[r[0]]), around[r], 10_000).alias(f"q{i}") for i, r in enumerate(todo))).first()
        tried = {r: row[f"q{i}"] for i, r in enumerate(todo)}
        counts = df.agg(*(v for i, r in enumerate(todo) for v in (F.count_if(x[r[0]] < F.lit(tried[r][0])).alias(f"b{i}"), F.count_if(within(r[0], *tried[r])).alias(f"i{i}")))).first()
        for i, r in enumerate(todo):
            holds = counts[f"b{i}"] <= r[1] < counts[f"b{i}"] + counts[f"i{i}"]
            if holds and (counts[f"i{i}"] < inside[r] or tried[r][0] == tried[r][1]):
                (low[r], high[r]), before[r], inside[r] = tried[r], counts[f"b{i}"], counts[f"i{i}"]
            elif slack[r] > 1:  # cannot be narrowed
                whole.add(r)
            else:
                slack[r] *= 4
    value = {r: low[r] for r in ranks if low[r] is not None and low[r] == high[r]}
    left = [r for r in ranks if r not in value]
    if left:
        asked = F.explode(F.filter(F.array(*(F.when(within(r[0], low[r], high[r]), F.struct(F.lit(i).alias("i"), x[r[0]].alias("x"))) for i, r in enumerate(left))), lambda v: v.isNotNull()))
        counted = df.select(asked.alias("v")).groupBy("v.i", "v.x").count()
        end = F.sum("count").over(Window.partitionBy("i").orderBy("x"))
        want = F.element_at(F.array(*(F.lit(r[1] - before[r]) for r in left)), F.col("i") + 1)
        found = counted.withColumn("end", end).where((want >= F.col("end") - F.col("count")) & (want < F.col("end"))).select("i", "x").collect()
        value |= {left[r.i]: r.x for r in found}

    def quantile(c: str, p: float) -> float | None:
        if not size[c]:
            return None
        at = place[c, p]
        a, b = value[c, math.floor(at)], value[c, math.ceil(at)]
        return a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b

    return {c: [quantile(c, p) for p in ps] for c, ps in wanted.items()}


def _interval(x: Column, intervals: str) -> Column:
    """The interval (low, high, ...) of a sorted array of disjoint ones that holds ``x``, or NULL."""
    last = F.get(intervals, F.size(F.filter(intervals, lambda s: s["_low"] <= x)) - 1)
    return F.when(x <= last["_high"], last)


def _bucket(x: Column, cuts: Column, coarse: Column) -> Column:
    """Twice the number of cuts below ``x``, one more if a cut equals it: repeated values have a bucket of their own. ``coarse`` is every sixteenth cut."""
    skipped = F.size(F.filter(coarse, lambda c: c < x)) * SIDE
    below = skipped + F.size(F.filter(F.slice(cuts, skipped + 1, F.lit(SIDE)), lambda c: c < x))
    return 2 * below + F.coalesce(F.get(cuts, below) == x, F.lit(False)).cast("int")


def values_at_ranks(rows: DataFrame, wanted: DataFrame, by: Sequence[str], few: int = FEW_OF_GROUP) -> DataFrame:
    """``by, _rank, _x``: the value of every rank (from 0) in ``wanted`` (``by, _rank``) among the group's values ``_x`` in ``rows`` (``by, _x``; no NULL or NaN; stable).

    All groups are narrowed at once, and only where a rank falls: approximate quantiles of an interval, whose state is bounded, cut it into buckets; exact counts, least and greatest values of
    the buckets tell which of them holds the rank. When an interval holds a ``few`` values or one, its values are counted and numbered. A group of few values is so from the start.
    The cuts decide the work only, never a result.
    """
    by, x = list(by), F.col("_x")
    sizes = rows.groupBy(*by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count("*").alias("_in"))
    at = cut(wanted.join(sizes, by).where("_rank >= 0 AND _rank < _in").select(*by, "_rank", "_low", "_high", F.lit(0).cast("long").alias("_before"), "_in"))
    wide = (F.col("_in") > few) & (F.col("_low") < F.col("_high"))
    parts = [(i + 1) / (CUTS + 1) for i in range(CUTS)]

    def inside(intervals: DataFrame, *more: str) -> DataFrame:
        """Rows in the intervals of their group, with the interval's columns."""
        of_group = cut(intervals.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_low", "_high", *more))).alias("_all")))
        return with_rows_of(rows, of_group, by).withColumn("_s", _interval(x, "_all")).where("_s IS NOT NULL").select(*by, "_x", "_s._low", *(f"_s.{c}" for c in more))

    while at.where(wide).limit(1).count():
        open_ = cut(at.where(wide).select(*by, "_low", "_high").distinct())
        cuts = inside(open_).groupBy(*by, "_low").agg(F.percentile_approx("_x", parts, 10_000).alias("_cuts"))
        cuts = cuts.withColumn("_coarse", F.array(*(F.get("_cuts", F.lit(k)) for k in range(SIDE - 1, CUTS, SIDE))))
        placed = inside(open_.join(cuts, [*by, "_low"]), "_cuts", "_coarse").withColumn("_b", _bucket(x, F.col("_cuts"), F.col("_coarse")))
        counted = placed.groupBy(*by, "_low", "_b").agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        counted = counted.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by, "_low").orderBy("_b")))  # two rows a cut and interval
        falls = (F.col("_rank") - F.col("_before") >= F.col("_end") - F.col("_c")) & (F.col("_rank") - F.col("_before") < F.col("_end"))
        narrower = at.where(wide).join(counted, [*by, "_low"]).where(falls)
        narrower = narrower.select(*by, "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_before") + F.col("_end") - F.col("_c")).alias("_before"), F.col("_c").alias("_in"))
        at = cut(at.where(~wide).unionByName(narrower))
    rest = at.where("_low < _high")
    counted = inside(rest.select(*by, "_low", "_high").distinct()).groupBy(*by, "_low", "_x").agg(F.count("*").alias("_c"))
    counted = counted.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by, "_low").orderBy("_x")))
    ranks = rest.groupBy(*by, "_low").agg(F.collect_list(F.struct((F.col("_rank") - F.col("_before")).alias("r"), "_rank")).alias("_ranks"))
    here = F.filter("_ranks", lambda r: (r["r"] >= F.col("_end") - F.col("_c")) & (r["r"] < F.col("_end")))
    found = counted.join(ranks, [*by, "_low"]).select(*by, F.explode(here).alias("_r"), "_x").select(*by, "_r._rank", "_x")
    return found.unionByName(at.where("_low = _high").select(*by, "_rank", F.col("_low").alias("_x")))


def grouped_quantiles(df: DataFrame, by: Sequence[str], column: str, shares: Sequence[float], few: int = FEW_OF_GROUP) -> DataFrame:
    """``by, n, quantiles``: each group's number of values and its interpolated quantiles, exact, in the order of ``shares``; without ``by`` one row for the whole column.

    NULL and NaN values, and rows with a NULL key, take no part; groups without values give no row.
    """
    keys = list(by) or ["_whole"]
    value = F.col(column).cast("double")
    rows = cut(df.withColumns({} if by else {"_whole": F.lit(0)}).dropna(subset=keys).where(value.isNotNull() & ~F.isnan(value)).select(*keys, value.alias("_x")))
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")))
    all_shares = F.lit([float(p) for p in shares])
    place = lambda p, f: f(p * (F.col("n") - 1)).cast("long")
    wanted = sizes.select(*keys, F.explode(F.array_distinct(F.flatten(F.transform(all_shares, lambda p: F.array(place(p, F.floor), place(p, F.ceil)))))).alias("_rank"))
    found = values_at_ranks(rows, wanted, keys, few).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    between = lambda a, b, t: F.when(a == b, a).otherwise(a + (b - a) * (t - F.floor(t)))
    quantiles = F.transform(all_shares, lambda p: between(F.element_at("_at", place(p, F.floor)), F.element_at("_at", place(p, F.ceil)), p * (F.col("n") - 1)))
    return sizes.join(found, keys).select(*by, "n", quantiles.alias("quantiles"))
