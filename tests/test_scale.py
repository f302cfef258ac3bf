"""Work that must not grow with the square of the input, and pairs by blocks against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import solvers
from lumenframe.operators import cnmf, graph, near, register, seeds
from lumenframe.plans import catalog

RNG = np.random.default_rng(5)


def test_long_traces_are_normalised_once(spark):
    y = RNG.normal(size=(4, 40_000)) + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)] + [(4, [2.0] * 5)], "unit_id long, y array<double>")
    t = time.time()
    got = {r["unit_id"]: r["z"] for r in graph.unit_norm(df).collect()}
    assert time.time() - t < 20  # the mean was taken anew for each of its samples
    z = y - y.mean(1, keepdims=True)
    assert np.array([got[i] for i in range(4)]) == pytest.approx(z / np.linalg.norm(z, axis=1, keepdims=True)) and got[4] is None


def test_init_a_of_long_movies(spark):
    y = RNG.normal(size=(9, 20_000)) + RNG.normal(size=20_000)
    traces = spark.createDataFrame([(i // 3, i % 3, r.tolist()) for i, r in enumerate(y)], "height int, width int, y array<double>")
    t = time.time()
    got = seeds.init_a(traces, spark.createDataFrame([(7, 1, 1)], "id long, height int, width int"), 0.1, 1.0).toPandas()
    assert time.time() - t < 30
    want = np.corrcoef(y)[4]
    assert len(got) == 5 and got["value"].to_numpy() == pytest.approx(want[got["height"] * 3 + got["width"]])


def test_init_a_by_segments_and_regions(spark, monkeypatch):
    rng = np.random.default_rng(11)
    y = rng.normal(size=(400, 70)) + 0.5 * rng.normal(size=70)
    y[21], y[22] = 2.0, np.nan  # does not vary; has gaps
    traces = spark.createDataFrame([(i // 20, i % 20, r.tolist()) for i, r in enumerate(y)] + [(2, 20, [1.0, 2.0, 4.0])], "height int, width int, y array<double>")
    at = [(i, i * 7 % 20, i * 3 % 20) for i in range(40)] + [(40, 1, 1), (41, 1, 2), (42, 1, 2), (42, 1, 2), (43, 2, 20), (44, 90, 90)]
    places = spark.createDataFrame(at, "id long, height int, width int")
    d = y - y.mean(1, keepdims=True)
    corr = d @ d.T / np.maximum(np.outer(*[np.linalg.norm(d, axis=1)] * 2), 1e-9)
    corr[21] = corr[:, 21] = 0.0
    for segment in (1024, 16):
        monkeypatch.setattr(seeds, "SEGMENT", segment)
        for thres, wnd in ((-0.05, 2.0), (0.2, 5.5)):
            want = [(u, h, w, 1.0) for u, h, w in at]
            for u, h, w in at[:-2]:
                for j in range(400):
                    c, d2 = corr[h * 20 + w, j], (h - j // 20) ** 2 + (w - j % 20) ** 2
                    if 0 < d2 <= wnd * wnd and not c <= thres:
                        want.append((u, j // 20, j % 20, c))
            for u, h, w in at[:-1]:  # the short trace has 0 with all
                for b in range(21) if u == 43 else [20]:
                    for a in range(20) if u == 43 else [2]:
                        if thres < 0 and 0 < (a - h) ** 2 + (b - w) ** 2 <= wnd * wnd and (b < 20 or a == 2):
                            want.append((u, a, b, 0.0))
            got = seeds.init_a(traces, places, thres, wnd)
            assert "FlatMapGroupsInArrow" in plan(got)  # no trace is joined to an edge
            got, want = sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)
            assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], nan_ok=True)


def test_a_small_field_is_turned_by_several_tasks(spark):
    from lumenframe.model import LabelledFrame

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        y = RNG.normal(size=(30, 64))
        y[4] = y[3]
        frames = spark.createDataFrame([(40 - i if i != 4 else 37, 8, 8, r.tolist()) for i, r in enumerate(y)], "frame long, height int, width int, px array<double>").repartition(3)
        got = LabelledFrame(frames, ("frame", "height", "width"), layout="frame").to_traces().df.withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["task"].nunique() > 1  # all pixels were one task's before
    assert np.stack(got.sort_values(["height", "width"])["y"]) == pytest.approx(y[::-1].T)
    with pytest.raises(Exception, match="fewer than 8 x 8"):
        LabelledFrame(frames.withColumn("px", F.slice("px", 1, 63)), ("frame", "height", "width"), layout="frame").to_traces().df.collect()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kernels_behind_cells_run_once(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("med_baseline", "smooth_low", "denoise_median", "preview_sweep"):
        got = catalog.QUERIES[name](spark, sf)
        runs = got._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython")
        assert runs == (2 if name == "preview_sweep" else 1), name  # that sweep has two settings
    from lumenframe.model import LabelledFrame

    rows = spark.createDataFrame([(1, [1.0, None]), (2, []), (3, None)], "unit_id long, y array<double>")
    assert sorted(map(tuple, LabelledFrame(rows, ("unit_id", "frame"), layout="trace").to_cells().df.collect()), key=str) == [(1, 0, 1.0), (1, 1, None)]


def test_kernels_take_part_of_a_batch(spark):
    from lumenframe.operators.blocks import map_traces

    rows = spark.range(0, 5000, 1, 1).select("id", F.when(F.col("id") % 2 == 0, F.array_repeat(F.col("id").cast("double"), 64)).otherwise(F.array(F.col("id").cast("double"))).alias("y"))
    got = rows.select("id", "y", map_traces(lambda x: [float(x.size)] * len(x), returns="double").alias("n"), map_traces(lambda x: x + 1).alias("z")).collect()
    assert max(r["n"] for r in got) <= 1 << 16  # was the whole batch
    assert all(r["z"] == [v + 1 for v in r["y"]] for r in got)


def feet(spark, n=60, side=6, seed=2):
    rng = np.random.default_rng(seed)
    on = rng.random((n, side * side)) < 0.5
    on[:5] = on[0]  # copies
    rows = [(int(u), int(p // side), int(p % side), 1.0) for u, p in zip(*np.nonzero(on), strict=True)]
    return on, spark.createDataFrame(rows, "unit_id long, height int, width int, value double")


def test_supports_meet_by_blocks(spark, monkeypatch):
    on, a = feet(spark)
    shared = on.astype(int) @ on.T
    n = on.sum(1)
    want = {(i, j): shared[i, j] / (n[i] + n[j] - shared[i, j]) for i in range(60) for j in range(i + 1, 60)}
    for block, pixels in ((2048, 1024), (7, 5)):
        monkeypatch.setattr(near.pack, "__defaults__", (block, False))
        monkeypatch.setattr(cnmf, "PIXELS", pixels)
        got = cnmf.jaccard_edges(a, 0.4)
        assert "Join" not in plan(got).split("MapInArrow")[0] and "MapInArrow" in plan(got)  # no pair goes through a join
        assert {(r["src"], r["dst"]): r["jaccard"] for r in got.collect()} == {k: v for k, v in want.items() if v > 0.4}


def test_tile_pairs_come_once_without_a_shuffle_of_pairs(spark):
    x = np.random.default_rng(3).uniform(0, 3, (50, 2)).round(3)
    x[:6] = x[0]
    df = spark.createDataFrame([(i % 3, i, float(h), float(w)) for i, (h, w) in enumerate(x)], "session int, unit_id long, height double, width double")
    got = register.tile_pairs(df, (1.0, 1.0))
    assert "Aggregate" not in plan(got).split("MapInArrow")[0] and "MapInArrow" in plan(got)
    want = {}
    for sa, sb in ((0, 1), (0, 2), (1, 2)):
        both = np.array([x[i] for i in range(50) if i % 3 in (sa, sb)])
        tiles = []
        for d in (0, 1):
            lo, span = both[:, d].min(), both[:, d].max() - both[:, d].min()
            n = int(np.ceil(span * 2))
            tiles.append([lo + i * (span / (n - 1) if n > 1 else 0.0) for i in range(n)])
        within = lambda i, d, c: c - 1 <= x[i][d] <= c + 1
        for i in range(sa, 50, 3):
            for j in range(sb, 50, 3):
                if all(any(within(i, d, c) and within(j, d, c) for c in tiles[d]) for d in (0, 1)):
                    want[sa, sb, i, j] = np.hypot(*(x[i] - x[j]))
    rows = got.collect()
    assert len(rows) == len(want) and {(r["session_a"], r["session_b"], r["unit_a"], r["unit_b"]): r["distance"] for r in rows} == pytest.approx(want)


def test_unit_merge_finds_a_forest_by_blocks(spark, monkeypatch):
    on, a = feet(spark, 40, 4)
    y = np.random.default_rng(4).normal(size=(40, 30))
    y[3] = 1.0  # does not vary
    c = spark.createDataFrame([(i, t, float(y[i, t])) for i in range(40) for t in range(30)], "unit_id long, frame long, value double")
    z = y - y.mean(1, keepdims=True)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    label = np.arange(40)
    for _ in range(40):
        for i, j in zip(*np.nonzero((z @ z.T > 0.25) & (on.astype(int) @ on.T > 0)), strict=True):
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    assert 1 < len(set(label)) < 40
    for block in (2048, 7):
        monkeypatch.setattr(near.pack, "__defaults__", (block, False))
        labels = cnmf.unit_merge(a, c, 0.25)[2]
        assert {r["unit_id"]: r["label"] for r in labels.collect()} == dict(enumerate(label.tolist()))
    traces = c.groupBy("unit_id").agg(F.collect_list("value").alias("y"))
    assert cnmf._correlated(a, traces, 0.0).count() < 40 * 16  # not all pairs: an edge for each unit in a task at most


def places(spark, n=70, seed=6):
    x = np.random.default_rng(seed).normal(size=(n, 2)).round(3)
    x[:20] = x[0] + np.random.default_rng(seed).normal(size=(20, 2)).round(4) * 1e-2  # a crowded cell
    x[3] = x[4]
    df = spark.createDataFrame([(i, i % 4, float(h), float(w)) for i, (h, w) in enumerate(x)] + [(n, 0, float("nan"), 0.0)], "id long, session int, height double, width double")
    d = x[:, None] - x
    return x, df, np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])


def test_radius_correlation_moves_blocks(spark, monkeypatch):
    x, df, d = places(spark)
    y = np.random.default_rng(7).normal(size=(70, 12))
    y[5] = 2.0
    t = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y) if i != 6], "unit_id long, y array<double>")
    want = {(i, j): 0.0 if 5 in (i, j) else np.corrcoef(y[i], y[j])[0, 1] for i in range(70) for j in range(i + 1, 70) if d[i, j] <= 0.3 and 6 not in (i, j)}
    monkeypatch.setattr(near, "BLOCK", 4)
    got = graph.radius_correlation(df, t, 0.3)
    assert "Join" not in plan(got).split("MapInArrow")[0]
    assert {(r["src"], r["dst"]): r["corr"] for r in got.collect()} == pytest.approx(want)


def test_partition_counts_without_pairs(spark):
    _, df, _ = places(spark)
    parts = df.withColumn("part", F.floor(F.coalesce(F.nanvl("height", F.lit(0.0)))).cast("long"))
    got = graph.radius_diagnostics(parts, 0.5, 100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.partition_diagnostics(parts, graph.radius_pairs(df, 0.5), n_frames=100).collect()))


def test_radius_components_against_edges(spark):
    _, df, _ = places(spark)
    for radius in (0.01, 0.1, 0.3):
        want = graph.connected_components(graph.radius_pairs(df, radius).select("src", "dst"), df.select("id"))
        assert sorted(map(tuple, graph.radius_components(df, radius).collect())) == sorted(map(tuple, want.collect()))


def test_mutual_pairs_against_the_pair_table(spark, monkeypatch):
    _, df, _ = places(spark)
    cents = df.withColumnRenamed("id", "unit_id")
    want = sorted(map(tuple, register.mutual_nearest(register.pair_distance(cents, 0.4)).collect()))
    for block in (2048, 3):
        monkeypatch.setattr(near.pack, "__defaults__", (block, False))
        assert sorted(map(tuple, register.mutual_pairs(cents, 0.4).collect())) == want and want


def test_pair_distance_by_blocks(spark):
    _, df, d = places(spark)
    got = register.pair_distance(df.withColumnRenamed("id", "unit_id"), 0.4)
    assert "Join" not in plan(got).split("MapInArrow")[0]
    want = {(i % 4, i, j % 4, j): d[i, j] for i in range(70) for j in range(70) if i % 4 < j % 4 and d[i, j] < 0.4}
    assert {tuple(r)[:4]: r["distance"] for r in got.collect()} == want


def test_radius_pairs_by_blocks(spark, monkeypatch):
    _, df, d = places(spark)
    want = {(i, j): d[i, j] for i in range(70) for j in range(i + 1, 70) if d[i, j] <= 0.4}
    for block in (2048, 3):
        monkeypatch.setattr(near.pack, "__defaults__", (block, False))
        got = graph.radius_pairs(df, 0.4)
        assert "Join" not in plan(got).split("MapInArrow")[0]
        assert {(r["src"], r["dst"]): r["distance"] for r in got.collect()} == want


def test_mappings_make_no_pair_table(spark, monkeypatch):
    monkeypatch.setattr(register, "pair_distance", None)
    for name in ("fill_mapping", "overlay_counts", "mapping_pivot"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_init_c_of_more_units_than_pixels(spark):
    rng = np.random.default_rng(8)
    a = rng.random((30, 12)) * (rng.random((30, 12)) < 0.5)
    a[:, 11] = 0  # a pixel without units
    y = rng.normal(size=(5, 12))
    feet = spark.createDataFrame([(i, p // 4, p % 4, float(a[i, p])) for i, p in zip(*map(np.ndarray.tolist, np.nonzero(a)), strict=True)] + [(50, 9, 9, 2.0)], "unit_id long, height int, width int, value double")
    cells = [(f, p // 4, p % 4, float(y[f, p])) for f in range(5) for p in range(12)] + [(f, 9, 9, float(f)) for f in range(5)]
    movie = spark.createDataFrame(cells, "frame long, height int, width int, value double")
    for rounds in (2, 60):
        out = cnmf.init_c(movie, feet, rounds)
        got = out.toPandas().set_index(["unit_id", "frame"])["value"]
        assert len(got) == 31 * 5 and [got[50, f] for f in range(5)] == pytest.approx([f / 2 for f in range(5)])
        want = np.linalg.lstsq(a.T, y.T, rcond=None)[0] if rounds > 2 else cnmf._steps(lambda p: a @ (a.T @ p), a @ y.T, 2)
        assert np.array([[got[i, f] for f in range(5)] for i in range(30)]) == pytest.approx(want, abs=1e-6)
    assert "MapInArrow" in plan(out)  # units meet solutions of the pixels; no matrix of units by units


def test_quick_rounding_is_rounding(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=20_000), rng.normal(size=2000) * 1e5, np.arange(-2000, 2000) / 2e6, np.arange(-50, 50) + 0.5, [0.0, -0.0, 1e300, np.inf, np.nan, -1e-9]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "value double")
    for digits in (4, 6):
        want = df.select(F.round(F.nanvl("value", F.lit(None).cast("double")), digits) + F.lit(0.0))
        assert [repr(r[0]) for r in catalog._r(df, digits=digits).collect()] == [repr(r[0]) for r in want.collect()]


def test_traces_are_deconvolved_together():
    rng = np.random.default_rng(10)
    y = np.abs(rng.normal(size=(12, 40))).cumsum(1) % 3
    g = np.stack([rng.uniform(0.3, 0.8, 12), rng.uniform(-0.1, 0.1, 12)], 1)
    noise = rng.uniform(0.01, 0.2, 12)
    starts = [None if i % 2 else (np.ones(40) * 0.1, 0.2, 0.1) for i in range(12)]
    got = solvers.deconvolve_many(y, g, noise, 1.0, 50, starts)
    for i in range(12):
        for x, want in zip(got, solvers.deconvolve(y[i], g[i], float(noise[i]), 1.0, 50, starts[i]), strict=True):
            assert x[i] == pytest.approx(want, abs=1e-7)
