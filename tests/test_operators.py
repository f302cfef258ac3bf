import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.model import LabelledFrame
from lumenframe.operators import algebra, cnmf, graph, image, motion, register, seeds
from lumenframe.plans import pipeline, simulate
from lumenframe.sources import store, video
from lumenframe.streaming import online

RNG = np.random.default_rng(1)


@pytest.fixture(scope="module")
def cells(spark):
    x = RNG.normal(size=(6, 4, 5))
    rows = [(f, h, w, float(x[f, h, w])) for f in range(6) for h in range(4) for w in range(5)]
    return spark.createDataFrame(rows, "frame long, height int, width int, value double").cache(), x


def test_layouts_round_trip(cells):
    df, x = cells
    lf = LabelledFrame(df, ("frame", "height", "width"))
    frames = lf.to_frames(4, 5)
    got = frames.to_cells().df.toPandas().sort_values(["frame", "height", "width"])["value"].to_numpy()
    assert got == pytest.approx(x.ravel())
    y = {(r["height"], r["width"]): r["y"] for r in lf.to_traces().df.collect()}
    assert y[2, 3] == pytest.approx(x[:, 2, 3])
    for tile in (3, 256):
        z = {(r["height"], r["width"]): r["y"] for r in frames.to_traces(tile).df.collect()}
        assert z == y
    assert lf.sel(frame=(1, 3)).sizes()["frame"] == 3 and lf.isel("frame", 0, 2).sizes()["frame"] == 3


def test_gaps_are_refused(cells):
    with pytest.raises(Exception, match="gaps"):
        LabelledFrame(cells[0].where("NOT (frame = 0 AND height = 0 AND width = 0)"), ("frame", "height", "width")).to_frames(4, 5).df.collect()


def test_merge_conflicts_are_refused(cells):
    df = cells[0].where("frame = 0")
    assert algebra.merge_same(df, df, ["frame", "height", "width"]).count() == df.count()
    with pytest.raises(Exception, match="conflict"):
        algebra.merge_same(df, df.withColumn("value", F.lit(9.0)), ["frame", "height", "width"]).collect()


def test_components_against_union_find(spark):
    n = 300
    e = RNG.integers(0, n, (220, 2))
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in e.tolist():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    for small in (0, graph.SMALL_EDGES):
        got = graph.connected_components(spark.createDataFrame(pd.DataFrame(e, columns=["src", "dst"])), spark.range(n).select("id"), small=small)
        assert {r["node"]: r["label"] for r in got.collect()} == {i: find(i) for i in range(n)}
    path = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    assert graph.connected_components(path, small=0).where("label != 0").count() == 0
    assert graph.connected_components(path, spark.range(103).select("id"), False).where("label = -1").count() == 2


def test_edge_correlation_against_numpy(spark):
    x = RNG.normal(size=(12, 80))
    x[3] = 1.0
    edges = [(0, 1), (2, 3), (4, 5), (6, 7), (0, 6), (3, 9), (5, 11)]
    t = spark.createDataFrame([(i, x[i].tolist()) for i in range(12)], "unit_id long, y array<double>")
    for r in graph.edge_correlation(spark.createDataFrame(edges, "src long, dst long"), t).collect():
        want = 0.0 if 3 in (r["src"], r["dst"]) else np.corrcoef(x[r["src"]], x[r["dst"]])[0, 1]
        assert r["corr"] == pytest.approx(want, abs=1e-9)


def test_partition_diagnostics_of_a_line(spark):
    points = spark.range(8).select("id", F.col("id").cast("double").alias("height"), F.lit(0.0).alias("width"))
    edges = graph.radius_pairs(points, 1.5)
    parts = points.select("id", F.floor(F.col("id") / 2).alias("part"))
    got = graph.partition_diagnostics(parts, edges, n_frames=1000).toPandas()
    assert got["intra"].tolist() == [1] * 4 and got["cross"].sum() == 2 * 3 and edges.count() == 7
    assert got["mib"].iloc[0] == pytest.approx(2 * 1000 * 4 / 1024**2)


SCENARIOS = {
    "extend": ([(1, 0, 2, 1), (2, 1, 3, 2)], "majority", {(1, 0), (2, 1), (3, 2)}),
    "tie": ([(1, 0, 2, 1), (2, 1, 3, 2), (1, 0, 3, 5)], "majority", {(1, 0), (2, 1)}),
    "majority": ([(1, 0, 2, 1), (2, 1, 3, 2), (1, 0, 3, 5), (2, 1, 4, 3), (3, 2, 4, 3)], "majority", {(1, 0), (2, 1), (3, 2), (4, 3)}),
    "strict": ([(1, 0, 2, 1), (2, 1, 3, 2), (1, 0, 3, 5), (2, 1, 4, 3), (3, 2, 4, 3)], "strict", {(1, 0), (2, 1), (4, 3)}),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_mapping_scenarios(spark, name):
    pairs, mode, want = SCENARIOS[name]
    df = spark.createDataFrame([(f"s-{a}", b, f"s-{c}", d) for a, b, c, d in pairs], "session_a string, unit_a long, session_b string, unit_b long")
    rows = register.resolve_mapping(df, mode).collect()
    assert {(int(r["session"].split("-")[1]), r["unit_id"]) for r in rows} == want
    assert len({r["mapping_id"] for r in rows}) == 1


def test_store_metadata_leaves_data_alone(spark, cells, tmp_path):
    folder = f"{tmp_path}/m0/s0/store"
    store.save(cells[0], folder, "A", {"animal": "m0"})
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "m0/s0/store/A").glob("*.parquet")}
    store.update_meta(spark, folder, {"session": "s0"})
    assert {p: p.stat().st_mtime_ns for p in files} == files
    got = store.open_variable(spark, folder, "A")
    assert got.first()["session"] == "s0" and got.first()["animal"] == "m0"
    with pytest.raises(FileExistsError):
        store.save(cells[0], folder, "A")
    again = store.save(store.open_variable(spark, folder, "A").drop("animal", "session").where("frame < 2"), folder, "A", overwrite=True)
    assert again.count() == 40 and store.variables(spark, folder) == ["A"]
    assert store.find_folders(spark, str(tmp_path)) and store.chunk_plan({"frame": 1000, "height": 100, "width": 100}, 4, "frame", 8) == (209, 200)


def test_videos_load_in_natural_order(spark, tmp_path):
    clips = [RNG.integers(0, 256, (n, 6, 8)).astype(np.uint8) for n in (3, 4, 2)]
    for name, clip in zip(("msCam2.avi", "msCam10.avi", "msCam1.avi"), clips, strict=True):
        (tmp_path / name).write_bytes(video.encode_avi(clip))
    want = np.concatenate([clips[2], clips[0], clips[1]])
    got = video.load_videos(spark, str(tmp_path)).orderBy("frame").collect()
    assert np.array([r["px"] for r in got]).reshape(9, 6, 8) == pytest.approx(want)
    half = video.load_videos(spark, str(tmp_path), downsample={"frame": 2, "height": 2, "width": 2}, strategy="mean")
    rows = half.orderBy("frame").collect()
    assert len(rows) == 4 and rows[0]["px"][0] == pytest.approx(want[:2, :2, :2].mean())
    out = video.write_video(video.load_videos(spark, str(tmp_path)), str(tmp_path / "out.bin"), norm=False)
    assert (video.decode_avi(open(out, "rb").read()) == want).all()


def test_zero_mass_footprints_are_refused(spark):
    a = spark.createDataFrame([(10, 0, 0, 1.0), (20, 0, 1, 0.0)], "unit_id long, height int, width int, value double")
    c = spark.createDataFrame([(10, 0, 1.0), (20, 0, 1.0)], "unit_id long, frame long, value double")
    with pytest.raises(ValueError, match="mass"):
        cnmf.unit_merge(a, c)


def test_init_c_solves_overlapping_units(spark):
    a = RNG.random((3, 16)) * (RNG.random((3, 16)) > 0.4)
    c = RNG.random((3, 7))
    y = (c.T @ a).reshape(7, 4, 4)
    ad = spark.createDataFrame([(u, i // 4, i % 4, float(a[u, i])) for u in range(3) for i in range(16) if a[u, i]], "unit_id long, height int, width int, value double")
    yd = spark.createDataFrame([(f, i // 4, i % 4, float(y[f, i // 4, i % 4])) for f in range(7) for i in range(16)], "frame long, height int, width int, value double")
    got = cnmf.init_c(yd, ad).toPandas().sort_values(["unit_id", "frame"])["value"].to_numpy().reshape(3, 7)
    assert got == pytest.approx(c, abs=1e-6)


def test_motion_over_chunks(spark):
    p = simulate.planted_movie(90, 40, 9, 0.01, 0.25, 0.5, seed=2)
    got = motion.estimate_motion(simulate.frames_df(spark, p["movie"]), chunk=16).orderBy("frame").toPandas()
    error = -got[["dy", "dx"]].to_numpy() - p["shifts"]
    assert np.sqrt((error**2).mean()) < 0.5 and abs(got["dy"].mean()) < 1e-9


def test_empty_tables(spark, cells):
    none = cells[0].where("frame < 0")
    assert image.glow_removal(none).count() == 0 and image.frame_summary(none).count() == 0
    edges = spark.createDataFrame([], "src long, dst long")
    assert graph.connected_components(edges).count() == 0 and seeds.windows(1, 10, 5)


def test_pipeline_finds_planted_cells(spark, tmp_path):
    p = simulate.planted_movie(160, 32, 4, 0.03, seed=5)
    cfg = pipeline.Config(motion=False, window=60, step=40, max_wnd=4, diff=0.2, pnr_thres=1.1, ks_sig=0.5, merge_dist=6, merge_corr=0.5, init_corr=0.5, init_wnd=7, noise_freq=0.25, pnr_freq=0.1)
    out = pipeline.run(spark, simulate.frames_df(spark, p["movie"]), str(tmp_path / "store"), cfg)
    truth = spark.createDataFrame([(u, int(h), int(w)) for u in range(4) for h, w in zip(*np.nonzero(p["A"][u] > 0.2), strict=True)], "unit_id long, height int, width int")
    score = pipeline.evaluate(out["A"], truth, 0.2)
    assert score["recall"] >= 0.75, score


def test_stream_summary_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = online.windowed_summary(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 hour", "1 minute")
    q = stream.writeStream.format("memory").queryName("summary").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("summary").agg(F.sum("n")).first()[0] == 200


@pytest.mark.parametrize(("n", "target"), [(333, 5), (64, 16), (1, 1), (0, 3)])
def test_large_parts_split_as_one_task_would(spark, monkeypatch, n, target):
    from lumenframe.functions.stats import spatial_partition

    rng = np.random.default_rng(21)
    xy = rng.integers(0, 9, (n, 2)).astype(float)
    xy[: n // 3] = 4.0  # a hot point
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), float(h), float(w)) for i, (h, w) in zip(ids, xy, strict=True)], "id long, height double, width double")
    by = np.argsort(ids)
    want = dict(zip(ids[by].tolist(), spatial_partition(xy[by], target).tolist(), strict=True)) if n else {}
    monkeypatch.setattr(graph, "TASK_POINTS", 40)
    got = {r["id"]: r["part"] for r in graph.kd_partition(df.repartition(3), target).collect()}
    assert got == want and (not n or max(np.bincount(list(got.values()))) <= target)


def test_motion_with_bad_frames_and_fields(spark):
    """Blank frames do not disturb the others' shifts; a field of shifts moves patches their own way."""
    rng = np.random.default_rng(41)
    y, x = np.mgrid[:40, :40]
    scene = sum(np.exp(-((y - b) ** 2 + (x - c) ** 2) / 16) for b, c in rng.uniform(12, 28, (6, 2)))
    from lumenframe.functions import images, shifts

    true = np.cumsum(rng.uniform(-0.6, 0.6, (30, 2)), 0)
    movie = np.stack([images.translate(scene, *t) for t in true])
    bad = [4, 13, 22]
    movie[bad] = 0.0
    movie[bad, 0, 0] = movie[bad, 39, 39] = 1.0
    df = spark.createDataFrame([(i, 40, 40, f.ravel().tolist()) for i, f in enumerate(movie)], "frame long, height int, width int, px array<double>")
    fine = [i for i in range(30) if i not in bad]
    for how in ({"circ_thres": 0.3, "max_sh": 15}, {"circ_thres": 0.3, "max_sh": 15, "alt_error": 1.0, "mask": 0.01}):
        got = motion.estimate_motion(df, chunk=10, **how).orderBy("frame").toPandas()[["dy", "dx"]].to_numpy()
        error = (got[fine] - got[fine].mean(0)) + (true[fine] - true[fine].mean(0))
        assert np.sqrt((error**2).mean()) < 0.5  # as for movies without bad frames
    one = df.where("frame = 0")
    fields = motion.estimate_fields(df.where("frame IN (1, 2, 3)"), one, 20)
    assert fields.count() == 3 * 4
    fixed = {r["frame"]: np.array(r["px"]).reshape(40, 40) for r in motion.apply_fields(df, fields, 20).collect()}
    assert set(fixed) == {1, 2, 3}
    for i, f in fixed.items():
        field = np.array([[[r["dy"], r["dx"]] for r in sorted((r for r in fields.where(f"frame = {i}").collect() if r["grid0"] == g), key=lambda r: r["grid1"])] for g in (0, 1)])
        assert f == pytest.approx(shifts.apply_field(movie[i], field, 20))


def test_init_c_equals_least_squares(spark):
    """Overlapping units over more frames than a task solves at once, against numpy."""
    rng = np.random.default_rng(42)
    a = np.where(rng.uniform(size=(5, 30)) < 0.5, rng.uniform(0.5, 1, (5, 30)), 0)
    movie = rng.normal(size=(300, 30))
    cells = [(f, 0, w, float(movie[f, w])) for f in range(300) for w in range(30)]
    feet = [(u, 0, w, float(a[u, w])) for u in range(5) for w in range(30) if a[u, w]]
    got = cnmf.init_c(spark.createDataFrame(cells, "frame long, height int, width int, value double"), spark.createDataFrame(feet, "unit_id long, height int, width int, value double"), 20)
    want = np.linalg.lstsq(a.T, movie.T, rcond=None)[0]
    rows = got.collect()
    assert len(rows) == 1500 and all(r["value"] == pytest.approx(want[r["unit_id"], r["frame"]], abs=1e-6) for r in rows)


def test_components_with_nulls_in_keys_agree(spark):
    rows = [((None, 1), ("a", 2)), (("a", 2), ("b", None)), (("c", 3), ("d", 4))]
    e = spark.createDataFrame(rows, "src struct<s:string,u:long>, dst struct<s:string,u:long>")
    here, there = ({(tuple(r["node"]), tuple(r["label"])) for r in graph.connected_components(e, small=n).collect()} for n in (100, 0))
    assert here == there and len({x for _, x in here}) == 2


def test_spatial_update_with_background(spark):
    """Pixels that mix two units and a background come apart into their weights."""
    rng = np.random.default_rng(43)
    c, f = np.maximum(rng.normal(size=(2, 200)), 0), np.abs(np.sin(np.arange(200) / 9)) + 0.2
    weights = {(0, 0): (1.0, 0.0, 0.5), (0, 1): (0.6, 0.3, 1.0), (0, 2): (0.0, 0.8, 0.7)}
    y = spark.createDataFrame([(h, w, (a * c[0] + b * c[1] + k * f).tolist()) for (h, w), (a, b, k) in weights.items()], "height int, width int, y array<double>")
    a = spark.createDataFrame([(u, 0, 1, 1.0) for u in (0, 1)], "unit_id long, height int, width int, value double")
    units = spark.createDataFrame([(u, c[u].tolist()) for u in (0, 1)], "unit_id long, y array<double>")
    sn = y.select("height", "width", F.lit(0.0).alias("sn"))
    back = spark.createDataFrame([(f.tolist(),)], "y array<double>")
    out, norm, b = cnmf.update_spatial(y, a, units, sn, 1, 0.1, 1, 3, (0, None), False, back)
    got = {(r["unit_id"], r["width"]): r["value"] for r in out.collect() if r["value"] > 1e-6}
    assert got == pytest.approx({(u, w): v[u] for (_, w), v in weights.items() for u in (0, 1) if v[u]}, abs=1e-5)
    assert {r["width"]: r["value"] for r in b.collect()} == pytest.approx({w: v[2] for (_, w), v in weights.items()}, abs=1e-5)
    assert {r["unit_id"]: r["norm"] for r in norm.collect()} == pytest.approx({0: 1.0, 1: 0.8}, abs=1e-5)


def test_temporal_update_options(spark):
    """A group shares the scale it is solved at; a warm start ends where a cold one does; post_scal fits the traces."""
    from lumenframe.functions import signals

    rng = np.random.default_rng(44)
    spikes = (rng.uniform(size=(3, 300)) < 0.05) * rng.uniform(1, 2, (3, 300))
    traces = np.stack([signals.ar_response(s, [0.8]) for s in spikes]) * np.array([[1.0], [3.0], [2.0]]) + rng.normal(scale=0.05, size=(3, 300))
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(traces)] + [(9, [-1.0] * 300)], "unit_id long, y array<double>")
    cold = {r["unit_id"]: r for r in cnmf.update_temporal(df, p=1, penalty=0.05, max_iters=300).collect()}
    assert set(cold) == {0, 1, 2}
    assert all(np.corrcoef(cold[i]["c"], traces[i])[0, 1] > 0.95 for i in range(3))
    warm = spark.createDataFrame([(i, cold[i]["s"], cold[i]["b"], cold[i]["c0"]) for i in range(3)], "unit_id long, s array<double>, b double, c0 double")
    again = {r["unit_id"]: r for r in cnmf.update_temporal(df, p=1, penalty=0.05, max_iters=300, warm=warm).collect()}
    assert all(np.abs(np.array(again[i]["c"]) - np.array(cold[i]["c"])).max() < 0.1 * np.abs(traces[i]).max() for i in range(3))
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (9, 9)], "unit_id long, label long")
    shared = {r["unit_id"]: r for r in cnmf.update_temporal(df, p=1, penalty=0.05, max_iters=300, groups=groups).collect()}
    assert shared[2]["c"] == pytest.approx(cold[2]["c"]) and shared[0]["c"] != pytest.approx(cold[0]["c"], rel=1e-6)
    scaled = {r["unit_id"]: r for r in cnmf.update_temporal(df, p=1, penalty=0.05, max_iters=300, post_scal=True).collect()}
    for i in range(3):
        c = np.array(scaled[i]["c"])
        assert (c @ traces[i]) / (c @ c) == pytest.approx(1.0, abs=1e-6)
    feet = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 1.0), (1, 0, 1, 1.0), (2, 5, 5, 1.0)], "unit_id long, height int, width int, value double")
    assert {(r["unit_id"], r["label"]) for r in cnmf.overlap_groups(feet, 0.1).collect()} == {(0, 0), (1, 0), (2, 2)}


def test_evaluation_with_traces_and_histogram(spark):
    feet = lambda rows: spark.createDataFrame(rows, "unit_id long, height int, width int, value double")
    truth = feet([(u, u * 10, w, 1.0) for u in range(3) for w in range(4)])
    found = feet([(10 + u, u * 10, w, 1.0) for u in range(2) for w in range(1, 4)] + [(50, 90, 0, 1.0)])
    t = [np.sin(np.arange(50) / (2 + u)) for u in range(3)]
    traces = lambda rows: spark.createDataFrame(rows, "unit_id long, y array<double>")
    got = pipeline.evaluate(found, truth, 0.3, traces([(10 + u, (2 * t[u] + 1).tolist()) for u in range(2)]), traces([(u, x.tolist()) for u, x in enumerate(t)]))
    assert [p[:2] for p in got["pairs"]] == [(10, 0), (11, 1)] and got["recall"] == pytest.approx(2 / 3) and got["precision"] == pytest.approx(2 / 3)
    assert got["correlation"] == pytest.approx(1.0)
    values = spark.createDataFrame([(float(x),) for x in [*np.random.default_rng(1).normal(0, 1, 300), *np.random.default_rng(2).normal(8, 1, 100)]] + [(None,)], "ptp double")
    rows = seeds.mixture_histogram(values, "ptp", 20).orderBy("bin").collect()
    assert sum(r["n"] for r in rows) == 400 and sum(r["density"] * (r["high"] - r["low"]) for r in rows) == pytest.approx(1, abs=0.1)
    assert seeds.mixture_histogram(values.limit(0), "ptp").count() == 0


def test_co_partitioned_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = store.co_partition(spark.range(50).withColumnRenamed("id", "k"), spark.range(20, 70).withColumnRenamed("id", "k"), ["k"], 3)
        j = a.join(b, "k")
        assert j.count() == 30
        assert j._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_packed_tiffs():
    import struct
    import zlib

    x = np.arange(24, dtype=np.uint8).reshape(4, 6)
    for kind, body in ((1, x.tobytes()), (8, zlib.compress(x.tobytes())), (32773, bytes([23]) + x.tobytes())):
        tags = [(256, 4, 6), (257, 4, 4), (258, 3, 8), (259, 3, kind), (273, 4, 8), (279, 4, len(body))]
        at = 8 + len(body) + len(body) % 2
        entries = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in tags)
        data = b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)
        assert (video.decode_tiff(data)[0] == x).all() and video.count_frames("a.tif", data) == 1
    assert video._unpack_runs(bytes([254, 7, 128, 1, 5, 6])) == bytes([7, 7, 7, 5, 6])


def test_movies_are_counted_by_their_headers(spark, tmp_path):
    movie = (np.arange(5 * 6 * 8) % 256).astype(np.uint8).reshape(5, 6, 8)
    df = spark.createDataFrame([(i, 6, 8, f.ravel().astype(float).tolist()) for i, f in enumerate(movie)], "frame long, height int, width int, px array<double>")
    path = video.write_video(df, str(tmp_path / "msCam1.avi"), norm=False)
    data = open(path, "rb").read()
    assert data == video.encode_avi(movie) and video.count_frames("a.avi", data) == 5 and (video.decode_avi(data) == movie).all()
    np.save(tmp_path / "m.npy", movie)
    assert video.count_frames("m.npy", open(tmp_path / "m.npy", "rb").read()) == 5


def test_a_variable_moved_aside_is_taken_back(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    store.save(spark.range(3), folder, "x")
    assert store.save(spark.range(5), folder, "x", overwrite=True).count() == 5
    (tmp_path / "store" / "x").rename(tmp_path / "store" / "_old-x")  # as if the driver had been lost there
    assert store.open_variable(spark, folder, "x").count() == 5 and store.variables(spark, folder) == ["x"]
