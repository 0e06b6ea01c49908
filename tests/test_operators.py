"""Hand-made rows for edges, ties, NULLs and small groups; properties against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridobs.functions import columns as C
from gridobs.functions import special
from gridobs.operators import baseline, collocate, equations, frames, grid, qc, split, stats, superobs
from gridobs.sources import io
from gridobs.streaming import stream

D = dt.date(2020, 1, 1)


def test_grid_edges(spark):
    rows = [(20.0, 100.0), (20.5, 100.0), (49.99, 149.9), (50.0, 120.0), (30.0, 150.0), (float("nan"), 120.0), (None, 120.0)]
    got = [tuple(r) for r in grid.assign_grid(spark.createDataFrame(rows, "latitude double, longitude double")).select("lat_idx", "lon_idx").collect()]
    assert got == [(0, 0), (1, 0), (59, 99)]


def test_grid_with_inexact_edges_agrees_with_its_edges(spark):
    g = C.Grid(res=0.1)
    edges = [20 + k * 0.1 for k in range(0, 300, 7)]
    got = [r[0] for r in spark.createDataFrame([(e,) for e in edges], "x double").select(g.lat_idx("x")).collect()]
    assert got == list(range(0, 300, 7))


def test_bootstrap_against_the_exact_error(spark):
    rng = np.random.default_rng(1)
    groups = {0: [None, None], 1: [400.0], 2: [400.0, 402.0], 3: [400.0] * 3, 4: list(map(float, rng.normal(400, 3, 15)))}
    rows = [(D, 0, k, v, 1.0, 20.0, 100.0) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "date date, lat_idx int, lon_idx int, xco2 double, tropomi_no2 double, latitude double, longitude double")
    got = {r.lon_idx: r for r in superobs.super_observation(df, resamples=2000).collect()}
    assert got[0].n_soundings == 0 and got[0].xco2_bootstrap_std is None and got[1].xco2_bootstrap_std is None
    assert got[2].xco2_bootstrap_std == pytest.approx(math.sqrt(2)) and got[3].xco2_bootstrap_std == 0
    x, n = np.sort(groups[4]), 15
    at_least = [sum(math.comb(n, j) * (k / n) ** j * (1 - k / n) ** (n - j) for j in range(8, n + 1)) for k in range(n + 1)]
    p = np.diff(at_least)  # chance that each value is the median of a resample
    exact = math.sqrt(p @ x**2 - (p @ x) ** 2)
    assert got[4].xco2_bootstrap_std == pytest.approx(exact, rel=0.1)


def test_bootstrap_is_one_statistic_at_every_size(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.standard_t(2, 3000), 1: rng.standard_t(2, 3001), 2: rng.choice([400.0, 410.0], 2500, p=[0.49, 0.51]), 3: np.full(2000, 400.0), 4: rng.normal(400, 3, 12), 5: [1.0, 2.0]}
    rows = [(D, 0, k, float(v), 1.0, 20.0, 100.0) for k, vs in groups.items() for v in vs] + [(D, 0, 0, None, 1.0, 20.0, 100.0)]
    df = spark.createDataFrame(rows, "date date, lat_idx int, lon_idx int, xco2 double, tropomi_no2 double, latitude double, longitude double")
    run = lambda m: {r.lon_idx: r for r in superobs.super_observation(df, resamples=1000, few=m).drop("date").collect()}
    few, many = run(10_000), run(100)
    assert len(few) == len(many) == 6
    for k, vs in groups.items():
        assert [x for c, x in many[k].asDict().items() if c != "xco2_bootstrap_std"] == [x for c, x in few[k].asDict().items() if c != "xco2_bootstrap_std"]
        assert many[k].xco2_bootstrap_std == pytest.approx(few[k].xco2_bootstrap_std, rel=1e-9, abs=1e-9)
        if len(vs) > 2:
            x, (low, high) = np.sort(vs), superobs.middle_ranks(len(vs), 1000)
            assert many[k].xco2_bootstrap_std == pytest.approx(np.std((x[low] + x[high]) / 2, ddof=1), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("n", [3, 4, 28, 9_999, 10_001])
def test_ranks_are_those_of_resamples(n):
    """Mean and spread of the drawn middle ranks against resamples that draw every value."""
    rng = np.random.default_rng(n)
    drawn = np.sort(rng.integers(0, n, (4000, n)), axis=1)[:, [(n - 1) // 2, n // 2]]
    ranks = np.stack(superobs.middle_ranks(n, 20_000), axis=1)
    assert ranks.min() >= 0 and ranks.max() < n and (ranks[:, 0] <= ranks[:, 1]).all()
    spread = drawn.std(axis=0)
    assert np.abs(ranks.mean(axis=0) - drawn.mean(axis=0)).max() <= 5 * (spread / math.sqrt(4000)).max() and ranks.std(axis=0) == pytest.approx(spread, rel=0.06)
    assert (ranks[:, 1] - ranks[:, 0]).mean() == pytest.approx((drawn[:, 1] - drawn[:, 0]).mean(), rel=0.1, abs=0.05)
    again = superobs.middle_ranks.__wrapped__(n, 20_000)
    assert (again[0] == ranks[:, 0]).all()  # a pure function of its arguments


def zonal(spark, rows, columns):
    df = spark.createDataFrame([(D, 0, i, *r) for i, r in enumerate(rows)], f"date date, lat_idx int, lon_idx int, {columns}")
    return {r.lon_idx: r.xco2_background for r in baseline.daily_zonal_background(df).collect()}[0]


def test_zonal_background(spark):
    assert zonal(spark, [(400.0,), (402.0,), (410.0,)], "xco2 double") == 402
    assert zonal(spark, [(400.0, 1.0), (402.0, 1.0), (410.0, 1.0)], "xco2 double, odiac_emission double") == 402
    two = [(400.0 + i, 1.0) for i in range(4)] + [(500.0, 9.0)] * 5
    assert zonal(spark, two, "xco2 double, odiac_emission double") == 500  # four clean rows: all count
    assert zonal(spark, [(400.0 + i, 1.0) for i in range(5)] + [(500.0, 9.0)] * 6 + [(600.0, None)], "xco2 double, odiac_emission double") == 402


def test_tiers(spark):
    rows = [(D, 0, 0, m, y, "NCP", 400.0) for m, y in ((1, 2020), (2, 2021))] + [(D, 9, 9, 1, 2020, "XXX", 410.0)]
    df = spark.createDataFrame(rows, "date date, lat_idx int, lon_idx int, month int, year int, eaic_region string, xco2 double")
    sc = lambda rows, s: spark.createDataFrame(rows, s)
    out = baseline.apply_tiered_baseline(
        df, sc([(0, 0, 1, 399.0)], "lat_idx int, lon_idx int, month int, clim double"), sc([("NCP", 2, 398.0)], "eaic_region string, month int, region_clim double"),
        sc([(1, 397.0), (2, 396.0)], "month int, global_clim double"), sc([(0, 0, 2020, 0.5)], "lat_idx int, lon_idx int, year int, delta double"), sc([("NCP", 2021, 0.25)], "eaic_region string, year int, region_delta double"))
    got = sorted((r.baseline_tier, r.xco2_anomaly) for r in out.collect())
    assert got == [(11, 0.5), (22, 1.75), (32, 13.0)]


@pytest.mark.parametrize("other", [False, True])
def test_tiers_from_sums_are_those_of_the_rows(spark, other):
    """The lookups of month sums against those of the observations, NULL values and keys included; the observations take part in one join."""
    rng = np.random.default_rng(7)
    few = lambda n: None if rng.random() < 0.03 else int(rng.integers(n))
    rows = []
    for _ in range(1500):
        y, m = int(rng.integers(2018, 2021)), int(rng.integers(1, 13))
        rows.append((few(4), few(4), y, m, dt.date(y, m, 1), ["NCP", "KCR", "OUT"][int(rng.integers(3))], None if rng.random() < 0.1 else float(rng.normal(400, 2))))
    rows += [(0, 0, None, None, None, "NCP", 400.0), (8, 8, 2030, 1, dt.date(2030, 1, 1), "JKT", None)]
    all_rows = spark.createDataFrame(rows, "lat_idx int, lon_idx int, year int, month int, year_month date, eaic_region string, xco2 double")
    fit = all_rows.where("month > 3 AND coalesce(lat_idx, 0) <> 2 AND year < 2020") if other else all_rows
    cells = baseline.valid_cells_by_region(fit)
    lookups = baseline.monthly_climatology(fit, cells), baseline.region_climatology(fit), baseline.global_climatology(fit), baseline.yearly_deviation_by_region(fit, cells), baseline.region_deviation(fit)
    want = baseline.apply_tiered_baseline(all_rows, *lookups)
    got = baseline.tiered_anomaly(fit, apply_to=all_rows if other else None, with_tier=True)
    look = lambda d: sorted(((r.lat_idx, r.lon_idx, r.year, r.month, r.eaic_region, round(r.xco2, 9), round(r.xco2_baseline, 6), round(r.xco2_anomaly, 6), r.baseline_tier) for r in d.collect()), key=str)
    assert look(got) == look(want) and len({r.baseline_tier for r in got.collect()}) > 1


def test_outliers_exempt_small_groups(spark):
    rows = [(1, 400.0)] * 8 + [(1, 999.0)] + [(2, 400.0 + i % 2) for i in range(20)] + [(2, 999.0), (2, None), (None, 999.0)]
    got = qc.outlier_filter(spark.createDataFrame(rows, "month int, xco2 double"))
    assert got.where("xco2 = 999").count() == 2 and got.count() == 31


def test_correlation(spark):
    rows = [(0, 0, float(i), float(i)) for i in range(9)] + [(0, 1, float(i) if i else None, -float(i)) for i in range(10)] + [(0, 2, 1.0, float(i)) for i in range(10)] + [(0, 3, float(i), -float(i)) for i in range(12)]
    got = {r.lon_idx: r for r in stats.cell_correlation(spark.createDataFrame(rows, "lat_idx int, lon_idx int, tropomi_no2 double, xco2_anomaly double")).collect()}
    assert set(got) == {1, 2, 3} and got[1].r is None and got[2].r is None and got[2].p is None and got[3].r == -1 and got[3].p == 0


def test_p_values_and_quantiles():
    # closed forms: n = 4 is p = 1 - |r|; n = 3 is the arcsine law
    r = np.array([-0.9, -0.3, 0.0, 0.5, 0.99])
    assert special.pearson_p_values(r, np.full(5, 4)) == pytest.approx(1 - np.abs(r), abs=1e-10)
    assert special.pearson_p_values(r, np.full(5, 3)) == pytest.approx(1 - 2 / np.pi * np.arcsin(np.abs(r)), abs=1e-10)
    assert special.pearson_p_values(np.array([0.3, 1.0, np.nan]), np.array([2, 9, 9]))[:2].tolist() == [1, 0]
    p = np.array([1e-9, 0.01, 0.3, 0.5, 0.975, 1 - 1e-9])
    x = special.normal_quantiles(p)
    assert [0.5 * math.erfc(-v / math.sqrt(2)) for v in x] == pytest.approx(p.tolist(), rel=1e-8) and x[4] == pytest.approx(1.959963985)


def by_definition(p, alpha=0.05):
    m, known = len(p), sorted(x for x in p if x is not None)
    c = sum(1 / i for i in range(1, m + 1))
    ok = [x for i, x in enumerate(known, 1) if x <= i / m * alpha / c]
    return [x is not None and bool(ok) and x <= max(ok) for x in p]


@pytest.mark.parametrize("ranges", [2, 5, 1000])
def test_false_discovery(spark, ranges):
    rng = np.random.default_rng(ranges)
    for p in ([1.0] * 5, [None, None], [0.0, 0.0, 1.0], [0.001] * 3 + [0.9] * 3, [*map(float, rng.random(200) ** 4), None, *[1e-4] * 20], [i / 60 * 0.05 for i in range(1, 60)], [10.0**-i for i in range(300)] + [0.02] * 300):
        got = stats.fdr_by(spark.createDataFrame(list(enumerate(p)), "i int, p double"), ranges=ranges).orderBy("i").collect()
        assert [r.significant for r in got] == by_definition(p)
    assert stats.fdr_by(spark.createDataFrame([], "i int, p double")).count() == 0
    assert not stats.fdr_by(spark.createDataFrame([(float("nan"),), (0.5,)], "p double")).where("significant").count()


def test_false_discovery_of_many_values_in_few_passes(spark):
    """Plans and jobs do not grow with the values, and the largest passing value is the one by definition."""
    n = 2_000_000
    df = spark.range(n).select(F.when(F.col("id") % 20 == 0, F.col("id") / F.lit(float(n)) * 1e-4).otherwise((F.col("id") + 1) / F.lit(float(n))).alias("p")).persist()
    x = np.sort(df.toPandas().p.to_numpy())
    k = np.nonzero(x <= np.arange(1, n + 1) / n * (0.05 / (0.5772156649015329 + math.log(n) + 0.5 / n)))[0].max()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fdr", "fdr")
    got = stats.fdr_by(df)
    jobs = len(tracker.getJobIdsForGroup("fdr"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.where("significant").count() == k + 1 and jobs <= 12
    df.unpersist()


def test_year_maps():
    names = lambda n: list(split.year_map(list(range(n))).values())
    assert names(1) == ["train"] and names(2) == ["train", "test"] and names(3) == ["train", "train", "test"]
    assert names(5) == ["train"] * 3 + ["test", "val"] and names(7) == ["train"] * 4 + ["test", "val", "val"]


def test_undersample_counts_and_repeats(spark):
    rows = [(i, "Korea_Japan", "train") for i in range(10)] + [(100 + i, "East_China", "train" if i < 37 else "test") for i in range(50)] + [(900, "East_China", "val")]
    df = spark.createDataFrame(rows, "id long, region string, split string")
    got = split.undersample(df, ["id"])
    n = {(r.region, r.split): r["count"] for r in got.groupBy("region", "split").count().collect()}
    assert n == {("Korea_Japan", "train"): 10, ("East_China", "train"): round(20 * 37 / 51), ("East_China", "test"): round(20 * 13 / 51), ("East_China", "val"): 1}
    again = split.undersample(df.repartition(7), ["id"])
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in again.collect())
    assert split.undersample(df.where("region <> 'Korea_Japan'"), ["id"]).count() == 51


def test_cap_and_sequences(spark):
    df = spark.createDataFrame([(D + dt.timedelta(i), 0, 0, float((-1) ** i * i) if i else None) for i in range(20)], "date date, lat_idx int, lon_idx int, xco2_anomaly double")
    assert sorted(abs(r.xco2_anomaly) for r in split.cap_per_cell(df, 3).collect()) == [17, 18, 19]
    for n, want in ((2, 0), (3, 0), (4, 1), (7, 4)):
        got = frames.sequences(df.where(F.col("date") < D + dt.timedelta(n)))
        assert got.select("seq").distinct().count() == want and got.count() == 3 * want
    dense = frames.dense_frames(df.where("xco2_anomaly IS NOT NULL"), "xco2_anomaly", C.Grid(res=10.0)).first()
    assert len(dense.frame) == 15 and dense.frame[1:] == [0.0] * 14


@pytest.mark.parametrize("cell", [0.25, 0.1])
def test_nearest_join_is_exact(spark, cell):
    rng = np.random.default_rng(3)
    days = [D + dt.timedelta(k) for k in range(3)]
    left = [(i, days[i % 3], float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(20, 50, 90), rng.uniform(100, 150, 90)))] + [(98, D, None, 110.0), (99, D, 25.0, float("nan"))]
    right = [(days[k % 2], float(x), float(y), float(k)) for k, (x, y) in enumerate(zip(rng.uniform(20, 25, 60), rng.uniform(100, 150, 60)))] + [(D, None, 110.0, 7.0)]
    a = spark.createDataFrame(left, "sounding_id long, date date, latitude double, longitude double")
    b = spark.createDataFrame(right, "date date, lat double, lon double, v double")
    joined = collocate.nearest_join(a, b, ["v", "absent"], cell=cell)
    assert "CartesianProduct" not in (plan := joined._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    got = {r.sounding_id: r for r in joined.collect()}
    assert len(got) == 92 and got[98].v is None and got[99].v is None
    for i, day, x, y in left[:90]:
        near = min(((math.dist((x, y), (p, q)), v) for d, p, q, v in right if d == day and p is not None), default=None)
        assert (got[i].v is None) if near is None else (got[i].v == near[1] and got[i].distance == pytest.approx(near[0])), i


def test_nearest_join_on_clustered_points(spark):
    """All points in one corner, all probes in another or amid the points: exact, and few pairs a probe at every step."""
    rng = np.random.default_rng(8)
    n = 4000
    p = np.stack([rng.normal(21, 0.05, n), rng.normal(101, 0.3, n)], axis=1)
    p[:400] = p[400:800]  # repeated places
    q = np.concatenate([rng.uniform([45, 145], [50, 150], (150, 2)), rng.normal([21, 101], [0.1, 0.5], (100, 2)), rng.uniform([20.9, 110], [21.1, 150], (50, 2))])
    right = spark.createDataFrame([(D, float(y), float(x), float(i)) for i, (y, x) in enumerate(p)], "date date, lat double, lon double, v double")
    left = spark.createDataFrame([(i, D, float(y), float(x)) for i, (y, x) in enumerate(q)], "sounding_id long, date date, latitude double, longitude double")
    got = {r.sounding_id: r for r in collocate.nearest_join(left, right, ["v"]).collect()}
    d2 = (q[:, None, 0] - p[None, :, 0]) ** 2 + (q[:, None, 1] - p[None, :, 1]) ** 2
    for i in range(len(q)):
        best = min((d2[i, j], *p[j], j) for j in np.flatnonzero(d2[i] <= d2[i].min() * (1 + 1e-12)))
        assert got[i].v == best[3] and got[i].distance == pytest.approx(math.sqrt(best[0]), rel=1e-12), i
    points = right.groupBy("date", "lat", "lon").agg(F.min(F.struct("v")).alias("_v"))
    levels, finest = collocate._levels(points, "date", 0.25, 4, 360.0)
    asked = left.select("sounding_id", "date", F.col("latitude").alias("_y"), F.col("longitude").alias("_x"))
    for k in range(1, len(levels) + 1):
        cells = collocate._nearest_cells(asked, levels[:k], "date", "sounding_id")
        assert cells.groupBy("sounding_id").count().agg(F.max("count")).first()[0] <= 100
    there = points.withColumn("_cy", F.floor(F.col("lat") / finest)).withColumn("_cx", F.floor(F.col("lon") / finest))
    pairs = cells.join(there, ["date", "_cy", "_cx"]).groupBy("sounding_id").count().agg(F.avg("count"), F.max("count")).first()
    assert pairs[0] < 100 and pairs[1] < 400, pairs


def test_nearest_join_keeps_ties(spark):
    """A point just outside the first block is as near as one inside: the smaller place counts."""
    right = spark.createDataFrame([(D, 0.5, 1.125, 1.0), (D, 0.125, 1.5, 2.0), (D, 0.125, 0.75, 3.0)], "date date, lat double, lon double, v double")
    left = spark.createDataFrame([(1, D, 0.125, 1.125)], "sounding_id long, date date, latitude double, longitude double")
    assert collocate.nearest_join(left, right, ["v"]).first().v == 3.0


def test_rasters_and_hours(spark):
    pts = spark.createDataFrame([(1, 50.0, 100.0, 2020, 1), (2, 45.0, 105.0, 2020, 2), (3, 10.0, 99.0, 2020, 1)], "id int, latitude double, longitude double, year int, month int")
    raster = spark.createDataFrame([(0, 0, 7.0, 2020, 1), (1, 1, 8.0, 2020, 1)], "row int, col int, value double, year int, month int")
    got = {r.id: (r.a, r.b) for r in collocate.sample_raster(collocate.sample_raster(pts, raster, collocate.Transform(), "a"), raster, collocate.Transform(), "b", ["year", "month"]).collect()}
    assert got == {1: (7.0, 7.0), 2: (8.0, None), 3: (None, None)}
    t = lambda h: dt.datetime(2020, 1, 1, h, 30)
    gr = spark.createDataFrame([(D, t(3), t(3)), (D, t(3), t(3)), (D, t(4), t(5)), (D, t(23), t(0))], "date date, time_start timestamp, time_end timestamp")
    assert sorted(r.hour for r in collocate.overpass_hours(gr).collect()) == [3, 4, 5]


def test_only_touched_tiles_are_read(spark, tmp_path):
    path, t = str(tmp_path / "tiles"), collocate.Transform(50.0, 100.0, 0.5)
    raster = spark.range(60 * 100 * 2).select((F.col("id") % 60).cast("int").alias("row"), (F.floor(F.col("id") / 60) % 100).cast("int").alias("col"), F.lit(2020).alias("year"), (F.floor(F.col("id") / 6000) + 1).cast("int").alias("month"), F.col("id").cast("double").alias("value"))
    io.write_raster_tiles(raster, path, 16)
    rows = [(1, 49.9, 100.1, 2020, 1), (2, 45.0, 101.0, 2020, 1), (3, 30.2, 140.3, 2020, 2), (4, 10.0, 99.0, 2020, 1), (5, None, 100.0, 2020, 1), (6, 30.2, 140.3, 2021, 2)]
    pts = spark.createDataFrame(rows, "id int, latitude double, longitude double, year int, month int")
    got = collocate.sample_tiles(pts, spark.read.parquet(path), t, "v", 16)
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
    touched = {"tile=2020_1_0_0", "tile=2020_2_2_5"}
    files = list((tmp_path / "tiles").rglob("*.parquet"))
    for f in files:  # a tile that no point lies in can't be read any more
        if f.parent.name not in touched:
            f.write_bytes(b"not a file of columns")
    want = {r.id: r.v for r in collocate.sample_raster(pts, raster, t, "v", ["year", "month"]).collect()}
    assert {r.id: r.v for r in got.collect()} == want and want[1] == 0.0 and want[2] is not None and want[3] is not None and len(files) > 40


def test_missing_values(spark, tmp_path):
    df = spark.createDataFrame([(1.0, -9999, -5.0, "1.5"), (float("nan"), 3, 2.0, "x"), (None, 4, None, "2")], "a double, b int, population_density double, s string")
    got = [tuple(r) for r in io.normalize_missing(df, {"b": -9999}).collect()]
    assert got == [(1.0, None, None, "1.5"), (None, 3, 2.0, "x"), (None, 4, None, "2")]
    with pytest.raises(ValueError, match="'a': 2"):
        io.write_ml_ready(df.select("a"), str(tmp_path / "x"))
    io.write_ml_ready(df.select("b"), str(tmp_path / "y"))
    assert dict(qc.numeric_if_mostly(df, 0.5).dtypes)["s"] == "double" and dict(qc.numeric_if_mostly(df).dtypes)["s"] == "string"
    assert qc.validate_table(df, ["a", "zz"], 2, 0.3) == ["no column zz", "a: 66.7% missing"]  # one NULL and one NaN of three
    nan = spark.createDataFrame([(float("nan"), "x"), (None, "y"), (1.0, None)], "a double, b string")
    assert qc.validate_table(nan, ["a", "b"], 2, 0.5) == ["a: 66.7% missing"] and qc.validate_table(nan.limit(0), ["a"], 1) == ["0 rows, at least 1 are needed"]


def test_files(spark, tmp_path):
    (tmp_path / "in/A").mkdir(parents=True)
    (tmp_path / "in/B").mkdir()
    (tmp_path / "in/A/OCO2_East_2020.csv").write_text("sounding_id,date,latitude,longitude,xco2,extra\n1234567890123456,2020-01-01 00:00:00,30,120,400.5,9\n")
    (tmp_path / "in/B/oco3_east_2020.csv").write_text("sounding_id,latitude,ret_snow_flag\n2,31,0\n")
    got = {r.file_source: r for r in io.read_soundings(spark, [str(tmp_path / "in/A"), str(tmp_path / "in/B")]).collect()}
    assert got["oco2_east_2020.csv"].sounding_id == 1234567890123456 and got["oco3_east_2020.csv"].xco2 is None and got["oco3_east_2020.csv"].ret_snow_flag == 0
    df = spark.createDataFrame([("20200101", "f1", 1, "s", 2020, "train", 1.0), ("20200102", "f2", 2, "t", 2021, "test", 2.0)], "date string, filename string, v int, sensor string, year int, split string, fluxes double").withColumn("sector", F.col("sensor"))
    out = str(tmp_path / "out")
    io.write_by_date(df, out)
    io.write_by_date(df, out)
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(out).where("date = 20200101").count() == 2
    io.append_new_files(df.limit(1), out + "new")
    io.append_new_files(df, out + "new")
    assert io.read_appended(spark, out + "new").count() == 2 and sorted(r[0] for r in io.finished_files(spark, out + "new").collect()) == ["f1", "f2"]
    io.write_by_sensor_year(df, out + "sy")
    io.write_splits(df, out + "splits")
    io.write_inventory(df, out + "inv")
    io.write_predictions(df, out + "pred")
    io.write_monthly_cube(df, out + "cube")
    assert spark.read.text(out + "splits/metadata").first().value == '{"test":1,"train":1}'
    assert spark.read.option("header", True).csv(out + "inv").count() == spark.read.parquet(out + "sy").count() == spark.read.parquet(out + "cube").count() == 2
    params = stats.fit_scalers(df, ["v", "nope"])
    io.save_scalers(params, out + "sc")
    assert [r.feature for r in io.load_scalers(spark, out + "sc").collect()] == ["v"]
    daily = spark.createDataFrame([(D, 1.0, 2.0, 5.0)] * 2, "date date, lat double, lon double, u10_daily double")
    assert [r.era5_u10 for r in io.daily_weather(daily).collect()] == [5.0]


def test_files_of_differing_headers(spark, tmp_path):
    (tmp_path / "x y").mkdir()
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("a.csv", "sounding_id,latitude,longitude,xco2\n1,30,110,400\n2,31,111,x\n")
    write("b.csv", "sounding_id,xco2,latitude,longitude,extra\n3,402,32,112,9\n")
    write("x y/C[1] {z}+%20.csv", '\ufefflatitude, sounding_id ,time,latitude,"xco2, raw"\n33,4,5.5,99,"1,2"\n')
    write("empty.csv", "")
    write("only_header.csv", "sounding_id,xco2\n")
    write("other.txt", "sounding_id,xco2\n7,7\n")
    for k in range(40):
        write(f"n{k}.csv", ["xco2,sounding_id\n0.5,100\n", "sounding_id,xco2\n100,0.5\n"][k % 2])
    got = io.read_soundings(spark, [str(tmp_path)])
    rows = {r.sounding_id: r for r in got.collect()}
    at = lambda i: tuple(rows[i][c] for c in ("latitude", "longitude", "xco2", "tai_seconds", "file_source"))
    assert at(1) == (30, 110, 400, None, "a.csv") and at(2) == (31, 111, None, None, "a.csv") and at(3) == (32, 112, 402, None, "b.csv")
    assert at(4) == (33, None, None, 5.5, "c[1] {z}+%20.csv")
    assert got.count() == 44 and got.where("sounding_id = 100 AND xco2 = 0.5").count() == 40
    scans = got._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert scans == 5 and got.columns == [*io.SOUNDING_COLUMNS, "file_source"]  # headers, not files
    assert got.select("xco2")._jdf.queryExecution().executedPlan().toString().count("ReadSchema: struct<_0:string>") >= 1  # one column is parsed
    (tmp_path / "none").mkdir()
    assert io.read_soundings(spark, [str(tmp_path / "none")]).count() == 0
    renamed = io.read_soundings(spark, [str(tmp_path / "b.csv")], {"x": "double", "extra": "int"}, {"xco2": "x"}).first()
    assert (renamed.x, renamed.extra) == (402, 9)


def test_equations(spark):
    df = spark.createDataFrame([("no2 / (WS_eff + 1)",), ("tropomi_no2 * WS_eff",), ("tropomi_no2 / BLH_eff",)], "equation string")
    assert [r.valid for r in equations.audit_equations(df).collect()] == [True, False, True]
    scored = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.1)], "equation string, complexity int, loss double")
    assert [r.equation for r in equations.best_equations(scored).collect()] == ["b", "a"]


def test_score_and_weights(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit("train").alias("split"))
    assert frames.score(df, lambda b: b.x * 2).agg(F.sum("prediction")).first()[0] == 90
    assert stats.hotspot_weight(df, "x").where("weight = 5").count() == 1


@pytest.mark.parametrize("batch", [1, 4, 100])
def test_sequences_are_scored_as_dense_frames(spark, batch):
    rng = np.random.default_rng(9)
    g = C.Grid(res=10.0)
    rows = [(D + dt.timedelta(int(d)), int(k // g.n_lon), int(k % g.n_lon), bool(rng.random() < 0.7), float(rng.normal()), float(rng.normal()) if rng.random() < 0.9 else None)
            for d in (0, 1, 2, 4, 5, 9, 12, 13) for k in rng.choice(g.n_lat * g.n_lon, rng.integers(1, 9), replace=False)]
    df = spark.createDataFrame(rows, "date date, lat_idx int, lon_idx int, observed boolean, a double, b double")
    model = lambda x: np.cumsum(x[:, 0, 0] - 2 * x[:, 1, 1] + x[:, 2, 0] * 3, axis=1) + x.sum(axis=(1, 2, 3, 4))[:, None, None]
    got = {(r.seq, r.date, r.lat_idx, r.lon_idx): r.prediction for r in frames.score_sequences(frames.sequences(df), model, ["a", "b"], g, batch=batch).collect()}
    days = sorted({r[0] for r in rows})
    want = {}
    for s in range(len(days) - 3):
        x = np.zeros((1, 3, 2, g.n_lat, g.n_lon))
        for d, i, j, _, a, b in rows:
            if d in days[s : s + 3]:
                x[0, days[s : s + 3].index(d), :, i, j] = a, b or 0
        y = model(x)[0]
        want |= {(s, d, i, j): pytest.approx(y[i, j]) for d, i, j, seen, *_ in rows if d == days[s + 2] and seen}
    assert got == want and len(want) > 5
    assert frames.score_sequences(frames.sequences(df.limit(0)), model, ["a", "b"], g).count() == 0


def test_pixel_stream_takes_each_file_once(spark, tmp_path):
    schema = "filename string, lat double, lon double, no2_tvcd double, qa double"
    name = "S5P____20200101T010203_20200101T020304.nc"
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    batch = spark.createDataFrame([(name, 30.0, 120.0, 1e-6, 0.9), (name, 30.0, 120.0, 1e-6, 0.1), (name, 60.0, 120.0, 1e-6, 0.9)], schema)
    batch.write.parquet(src)
    for _ in range(2):
        stream.ingest_pixels_stream(spark, src, out, check, batch.schema).awaitTermination()
        got = io.read_appended(spark, out).collect()
        assert [(str(r.date), r.time_end, r.no2_tvcd_umol) for r in got] == [("20200101", "20200101T020304", 1.0)]
    batch.write.mode("append").parquet(src)
    stream.ingest_pixels_stream(spark, src, out, check, batch.schema).awaitTermination()
    assert io.read_appended(spark, out).count() == 2


def test_append_that_breaks_off_gives_every_file_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(f"f{i // 3}", i) for i in range(9)], "filename string, v int")
    keep = io._write_manifest

    def breaks(*a):
        raise OSError("lost between data and manifest")

    io.append_new_files(df.where("filename = 'f0'"), path)
    monkeypatch.setattr(io, "_write_manifest", breaks)
    with pytest.raises(OSError):
        io.append_new_files(df.where("filename <> 'f2'"), path)
    assert io.read_appended(spark, path).count() == 3  # what the broken run left does not count
    monkeypatch.setattr(io, "_write_manifest", keep)
    io.append_new_files(df, path)
    io.append_new_files(df, path)
    assert sorted(r.v for r in io.read_appended(spark, path).collect()) == list(range(9))
    with pytest.raises(ValueError, match="no finished run"):
        io.read_appended(spark, str(tmp_path / "none"))


def test_stream_batch_that_breaks_off_gives_every_file_once(spark, tmp_path, monkeypatch):
    schema = "filename string, lat double, lon double, no2_tvcd double, qa double"
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [(f"S5P____2020010{d}T010203_2020010{d}T020304.nc", 30.0, 120.0, 1e-6, 0.9) for d in (1, 2, 3)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    keep, calls = io._write_manifest, []

    def breaks_once(*a):
        calls.append(a)
        if len(calls) == 1:
            raise OSError("lost between data and manifest")
        keep(*a)

    monkeypatch.setattr(io, "_write_manifest", breaks_once)
    with pytest.raises(Exception, match="lost between"):
        stream.ingest_pixels_stream(spark, src, out, check, spark.createDataFrame([], schema).schema).awaitTermination()
    for _ in range(2):
        stream.ingest_pixels_stream(spark, src, out, check, spark.createDataFrame([], schema).schema).awaitTermination()
    assert sorted(str(r.date) for r in io.read_appended(spark, out).collect()) == ["20200101", "20200102", "20200103"] and len(calls) == 2


def test_super_observations_are_appended_once(spark, tmp_path):
    """Three micro-batches with a stop in between, one row behind the watermark: what is written equals a batch over the rows in time."""
    schema = "time timestamp, lat_idx int, lon_idx int, xco2 double, tropomi_no2 double"
    day = lambda d, k: (dt.datetime(2020, 1, d, 6 + k), k % 2, 0, 400.0 + d + k, float(d * k))
    batches = [[day(d, k) for d in (1, 2, 3) for k in range(4)], [day(d, k) for d in (2, 3, 6, 8) for k in range(5)], [day(1, 9), *(day(d, k) for d in (7, 8, 20) for k in range(3))]]
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    late, sizes = 0, []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = stream.write_super_observations(spark.readStream.schema(schema).parquet(src), out, check)
        q.awaitTermination()
        late += stream.late_rows(q)
        sizes.append(spark.read.parquet(out).count())
    in_time = spark.createDataFrame([r for b in batches for r in b if r != day(1, 9)], schema)
    batch = in_time.withColumn("date", F.to_date("time")).groupBy("date", "lat_idx", "lon_idx").agg(F.median("xco2").alias("xco2"), F.median("tropomi_no2").alias("tropomi_no2"), F.count("xco2").alias("n_soundings"))
    want = sorted(map(tuple, batch.where("date < '2020-01-18'").collect()))  # the last day's watermark is two days before it
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) == 12
    assert late == 1 and sizes == [0, 6, 12]


def test_files_follow_the_size_of_a_date(spark, tmp_path):
    """One hot date goes into several files, sparse ones into one each."""
    df = spark.range(200_000).select(F.when(F.col("id") % 1000 == 0, F.concat(F.lit("2020010"), F.col("id") % 7 + 2)).otherwise("20200101").alias("date"), F.col("id").alias("time"), F.hex(F.xxhash64("id")).alias("v"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    try:
        io.write_by_date(df, str(tmp_path / "d"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = {r.d: r.n for r in spark.read.parquet(str(tmp_path / "d")).select(F.regexp_extract("_metadata.file_path", "date=([0-9]+)", 1).alias("d"), F.col("_metadata.file_name").alias("f")).distinct().groupBy("d").agg(F.count("*").alias("n")).collect()}
    assert files["20200101"] >= 3 and max(n for d, n in files.items() if d != "20200101") == 1 and len(files) == 8
    for path in {r[0] for r in spark.read.parquet(str(tmp_path / "d")).select("_metadata.file_path").distinct().collect()}:
        times = [r.time for r in spark.read.parquet(path).collect()]
        assert times == sorted(times)


def test_super_observation_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1 + k // 6, k % 24), k % 2, 0, 400.0 + k, float(k)) for k in range(24)]
    schema = "time timestamp, lat_idx int, lon_idx int, xco2 double, tropomi_no2 double"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    q = stream.super_observation_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("so").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = df.withColumn("date", F.to_date("time")).groupBy("date", "lat_idx", "lon_idx").agg(F.median("xco2").alias("xco2"), F.median("tropomi_no2").alias("tropomi_no2"), F.count("xco2").alias("n_soundings"))
    assert sorted(map(tuple, spark.table("so").collect())) == sorted(map(tuple, batch.collect()))


def test_lookups_are_broadcast(spark):
    df = spark.createDataFrame([(1, 400.0)] * 20, "month int, xco2 double")
    assert "BroadcastHashJoin" in qc.outlier_filter(df)._jdf.queryExecution().toString()


def test_distinct_values_merge_from_partial_results(spark):
    rows = [(D + dt.timedelta(int(i) % 2), int(v)) for i, v in enumerate(np.random.default_rng(1).integers(0, 100_000, 3000))] + [(D, 0), (D, 32_767), (D, 32_768), (D + dt.timedelta(1), 0), (D, None)]
    df = spark.createDataFrame(rows, "date date, v long")
    days = [stats.distinct_partials(df.where(F.col("date") == D + dt.timedelta(k)), F.col("v")) for k in range(2)]
    n = len({v for _, v in rows if v is not None})
    assert stats.merged_distinct(days[0].union(days[1])).first().n_distinct == stats.merged_distinct(stats.distinct_partials(df, F.col("v"))).first().n_distinct == n
    assert stats.merged_distinct(stats.distinct_partials(df.limit(0), F.col("v"))).first().n_distinct == 0


def test_grouped_quantiles(spark):
    from gridobs.operators.quantiles import grouped_quantiles

    rng = np.random.default_rng(6)
    n = 8000
    g = rng.choice(5, n, p=[0.6, 0.2, 0.1, 0.0995, 0.0005])
    x = rng.standard_t(2, n)
    x[rng.random(n) < 0.3] = 7.0
    x[g == 2] = 1.5
    rows = [(int(a), float(b)) for a, b in zip(g, x)] + [(0, None), (0, float("nan")), (None, 1.0), (9, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    p = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    for few in (50_000, 60):
        got = {r.g: r for r in grouped_quantiles(df, ["g"], "x", p, few).collect()}
        assert set(got) == set(g.tolist())
        for k, r in got.items():
            assert r.n == (g == k).sum() and r.quantiles == pytest.approx(np.quantile(x[g == k], p), rel=1e-12, abs=1e-12), (k, few)
    whole = grouped_quantiles(df.where("g IS NOT NULL"), [], "x", p, 60).first()
    assert whole.quantiles == pytest.approx(np.quantile(x, p), rel=1e-12) and grouped_quantiles(df.limit(0), ["g"], "x", p).count() == 0


def test_a_hot_group_is_not_held_by_a_task(spark, monkeypatch):
    """A million distinct values of one group: no window or aggregate behind the narrowing gets more than ``few`` of them."""
    from gridobs.operators import quantiles

    df = spark.range(1_000_000).select(F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(99).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**15)) / 1e3).alias("x"))
    seen = []
    keep = quantiles.cut
    monkeypatch.setattr(quantiles, "cut", lambda d: (seen.append(d.columns), keep(d))[1])
    few = 20_000
    got = {r.g: r.quantiles for r in quantiles.grouped_quantiles(df, ["g"], "x", [0.25, 0.75], few).collect()}
    want = {r.g: list(r.q) for r in df.groupBy("g").agg(F.percentile("x", F.lit([0.25, 0.75])).alias("q")).collect()}
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want) and len(got) == 8
    rows = df.withColumnRenamed("x", "_x")
    wanted = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", F.floor(0.25 * (F.col("n") - 1)).cast("long").alias("_rank"))
    found = quantiles.values_at_ranks(rows.persist(), wanted, ["g"], few)
    plan = found._jdf.queryExecution().toString()
    assert "percentile(" not in plan and seen.count(["g", "_rank", "_low", "_high", "_before", "_in"]) >= 2  # narrowed at least once


def test_exact_quantiles_by_narrowing(spark):
    from gridobs.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(5)
    n = 6000
    cols = {"a": rng.standard_t(2, n), "b": rng.integers(0, 3, n).astype(float), "c": np.full(n, 7.0), "d": np.where(rng.random(n) < 0.5, np.nan, rng.exponential(size=n)), "e": np.full(n, np.nan)}
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in zip(*cols.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).persist()
    p = [0.0, 0.1, 0.5, 0.75, 1.0]
    for few in (200_000, 50):
        got = exact_quantiles(df, {c: p for c in cols}, few)
        assert got["e"] == [None] * 5
        for c in "abcd":
            v = cols[c][~np.isnan(cols[c])]
            assert got[c] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12), (c, few)
    assert exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}


def test_sketches_merge_and_leave_nulls_out(spark):
    rows = spark.range(60_000).select(F.expr("id % 7").alias("date"), F.expr("CASE WHEN id % 10 > 0 THEN concat('k', id % 20000) END").alias("k"), F.lit("a").alias("g"))
    parts = stats.distinct_sketches(rows, "k", ["g", "date"])
    assert parts.count() == 7
    (one,) = stats.merged_sketches(parts, ["g"]).collect()
    assert abs(one.n_distinct - 18_000) <= 0.04 * 18_000
    assert stats.merged_sketches(stats.distinct_sketches(rows.where("k IS NULL"), "k", ["g"]), ["g"]).first().n_distinct == 0
    assert stats.merged_sketches(stats.distinct_sketches(rows.limit(0), "k", ["g"])).first().n_distinct == 0
