import numpy as np
import pytest

from lumenframe.functions import images, shifts, signals, solvers, stats
from lumenframe.sources import video

RNG = np.random.default_rng(0)


def test_box_mean_reflects():
    x = np.arange(16.0).reshape(1, 4, 4)
    assert images.box_mean(x, 3)[0, 0, 0] == pytest.approx(np.mean([0, 0, 1, 0, 0, 1, 4, 4, 5]))


def test_opening_removes_small_bright_spots():
    x = np.zeros((1, 9, 9))
    x[0, 4, 4] = 5
    assert images.background(x, "tophat", 1)[0, 4, 4] == 5
    assert images.background(np.ones((1, 9, 9)), "tophat", 1).max() == 0


def test_label_matches_flood_fill():
    mask = RNG.random((12, 15)) > 0.5
    got = images.label(mask)
    seen, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 12 and 0 <= b < 15 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert (got == seen).all()


@pytest.mark.parametrize("move", [(4, -3), (-5, 2), (0, 6)])
def test_whole_shifts_are_found(move):
    f = RNG.random((64, 64))
    assert shifts.xcorr_shift(f, np.roll(f, move, (0, 1))) == pytest.approx([-move[0], -move[1]], abs=1e-6)


@pytest.mark.parametrize("move", [(1.5, -2.5), (0.4, 3.2)])
def test_subpixel_shifts(move):
    y, x = np.mgrid[:96, :96]
    f = np.sin(y / 7) * np.cos(x / 5) + 1.5
    assert -shifts.xcorr_shift(f, images.translate(f, *move)) == pytest.approx(move, abs=0.5)


def test_translate_direction():
    f = np.zeros((32, 32))
    f[10, 12] = 1
    assert np.unravel_index(images.translate(f, 3, 2).argmax(), f.shape) == (13, 14)
    assert np.unravel_index(images.shift_rounded(f, 3, 2, 0).argmax(), f.shape) == (13, 14)


def test_estimate_recovers_drift():
    from lumenframe.plans.simulate import planted_movie

    p = planted_movie(60, 48, 9, 0.01, 0.3, 0.5, seed=3)
    _, found, _ = shifts.estimate(p["movie"], 3)
    assert np.sqrt(((-found - p["shifts"]) ** 2).mean()) < 0.5


def test_fft_filter_parts_add_up():
    x = RNG.normal(size=(3, 64))
    assert signals.fft_filter(x, 0.25, "low") + signals.fft_filter(x, 0.25, "high") == pytest.approx(x)
    assert signals.fft_filter(x, 0.25, "low")[0] == pytest.approx(np.fft.irfft(np.where(np.arange(33) < 16, np.fft.rfft(x[0]), 0)))


def test_butter_gain():
    b, a = signals.butter_coefficients(0.1, "low")
    z = np.exp(-2j * np.pi * 0.1 * np.arange(3))
    assert abs((b * z).sum() / (a * z).sum()) == pytest.approx(1 / np.sqrt(2))
    assert b.sum() / a.sum() == pytest.approx(1)


@pytest.mark.parametrize("how", ["mean", "median", "logmexp"])
def test_noise_level(how):
    x = RNG.normal(0, 2.0, (8, 4096))
    assert signals.noise_welch(x, how=how).mean() == pytest.approx(2 / np.sqrt(1 if how == "mean" else 1), rel=0.4)
    assert signals.noise_fft(x, how="mean").mean() == pytest.approx(2, rel=0.1)


def test_ar_coefficients_of_known_process():
    x = signals.ar_response(RNG.normal(size=(1, 20000)), np.array([1.2, -0.4]))[0]
    assert signals.ar_coefficients(x, 0.0, 2) == pytest.approx([1.2, -0.4], abs=0.05)


def test_rising_run_counts_steps():
    assert signals.rising_run(np.array([0, 1, 0, 2, 5, 9, 1, 2])) == 3
    assert signals.rising_run(np.zeros(5)) == 0


def test_lasso_meets_its_optimality_conditions():
    x, w = RNG.normal(size=(200, 5)), np.array([1.0, 0, 2, 0, 0.5])
    y = x @ w + RNG.normal(0, 0.1, 200)
    got = solvers.nonnegative_lasso(x, y, 0.05)
    xc, yc = x - x.mean(0), y - y.mean()
    grad = -xc.T @ (yc - xc @ got) / 200 + 0.05
    assert (np.abs(grad[got > 0]) < 1e-6).all() and (grad > -1e-6).all()


def test_cgls_reaches_least_squares():
    a, b = RNG.normal(size=(50, 6)), RNG.normal(size=50)
    assert solvers.cgls(a, b, 20) == pytest.approx(np.linalg.lstsq(a, b, rcond=None)[0], abs=1e-6)


def test_deconvolution_finds_spikes_and_beats_trivial_objectives():
    g, s = np.array([0.9]), np.zeros(150)
    s[[20, 60, 100]] = 1.0
    y = signals.ar_response(s, g) + 0.2 + RNG.normal(0, 0.03, 150)
    c, found, b, c0 = solvers.deconvolve(y, g, 0.03, 1.0)
    assert (found >= 0).all() and b >= y.min()
    assert {int(i) for i in np.argsort(-found)[:3]} == {20, 60, 100}
    z = np.zeros(150)
    assert solvers.objective(y, c, found, b, c0, g, 0.03) < solvers.objective(y, z, z, y.mean(), 0, g, 0.03)


@pytest.mark.parametrize(("target", "parts"), [(16, 1), (10, 2), (8, 2), (5, 4), (4, 4), (3, 8), (2, 8), (1, 16)])
def test_partition_of_a_grid(target, parts):
    points = np.array([divmod(i, 4) for i in range(16)], float)
    got = stats.spatial_partition(points, target)
    assert sorted(set(got.tolist())) == list(range(parts)) and (np.bincount(got) == 16 // parts).all()


@pytest.mark.parametrize("bad", [np.zeros(3), np.zeros((5, 3)), np.array([[np.nan, 0]]), np.array([[np.inf, 0]])])
def test_partition_rejects(bad):
    with pytest.raises(ValueError):
        stats.spatial_partition(bad, 2)


def test_partition_keeps_clusters():
    points = np.array([(h, w) for h in (0, 100) for w in np.linspace(0, 1, 8)])
    got = stats.spatial_partition(points, 8)
    assert len(set(got[:8])) == len(set(got[8:])) == 1


def test_ks_tells_normal_from_spiky():
    assert stats.normal_ks(RNG.normal(size=2000))[1] > 0.05
    assert stats.normal_ks(RNG.exponential(size=2000))[1] < 1e-6


def test_mixture_splits_two_groups():
    x = np.concatenate([RNG.normal(0, 1, 300), RNG.normal(10, 1, 100)])
    mask = stats.mixture_mask(x)
    assert mask[300:].all() and not mask[:300].any()


def test_assignment_is_best():
    import itertools

    c = RNG.random((4, 6))
    best = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4))
    assert sum(c[i, j] for i, j in stats.assign(c)) == pytest.approx(best)
    assert sum(c.T[i, j] for i, j in stats.assign(c.T)) == pytest.approx(best)


def test_avi_and_tiff_round_trip():
    f = RNG.integers(0, 256, (5, 7, 9)).astype(np.uint8)
    assert (video.decode_avi(video.encode_avi(f)) == f).all()
    import struct

    page = f[0].tobytes()
    tags = [(256, 4, 9), (257, 4, 7), (258, 3, 8), (259, 3, 1), (273, 4, 8), (279, 4, len(page))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    data = b"II*\0" + struct.pack("<I", 8 + len(page)) + page + ifd
    assert (video.decode_tiff(data)[0] == f[0]).all()


def test_bad_frames_and_wrong_templates_leave_the_others_alone():
    """Noise frames are no targets when they are known to be bad; masks and facing ends change nothing where all is well."""
    rng = np.random.default_rng(31)
    y, x = np.mgrid[:48, :48]
    scene = sum(a * np.exp(-((y - b) ** 2 + (x - c) ** 2) / 18) for a, b, c in zip(rng.uniform(1, 2, 8), rng.uniform(12, 36, 8), rng.uniform(12, 36, 8), strict=True))
    true = np.cumsum(rng.uniform(-0.8, 0.8, (24, 2)), 0)
    movie = np.stack([images.translate(scene, *t) for t in true])
    bad = [5, 11, 17]
    movie[bad] = rng.uniform(0, 2, (3, 48, 48))
    fine = [i for i in range(24) if i not in bad]
    quality = np.array([shifts.template_quality(f, 20) for f in movie])
    assert (quality[fine] > 0.5).mean() >= 0.8
    moved = lambda s: np.abs((s[fine] - s[fine].mean(0)) + (true[fine] - true[fine].mean(0))).max()
    movie[bad] = 0.0  # blank frames have no roundness at all
    movie[bad, 0, 0] = movie[bad, 47, 47] = 1.0
    assert all(shifts.template_quality(movie[i], 20) < 0.3 for i in bad)
    _, known, ends = shifts.estimate(movie, 3, circ_thres=0.3, max_sh=20)
    assert moved(known) < 0.5 and ends[0].shape == (48, 48)
    _, other, _ = shifts.estimate(movie, 3, circ_thres=0.3, max_sh=20, alt_error=1.0, mask=0.01)
    assert moved(other) < 0.5
    with np.testing.assert_raises(ValueError):
        shifts.estimate(movie, 3, how="median")


def test_roundness_of_outlines():
    y, x = np.mgrid[:41, :41]
    disk = (y - 20) ** 2 + (x - 20) ** 2 <= 15**2
    assert 0.85 < shifts.roundness(disk) <= 1.0
    ring = disk & ((y - 20) ** 2 + (x - 20) ** 2 > 5**2)
    assert shifts.roundness(ring) == shifts.roundness(disk)
    square = np.zeros((9, 9), bool)
    square[2:7, 2:7] = True
    assert shifts.roundness(square) == pytest.approx(4 * np.pi * 16 / 16**2)
    two = square.copy()
    two[0, 0] = True
    assert shifts.roundness(two) == 0 and shifts.roundness(np.zeros((3, 3), bool)) == 0
    assert shifts.roundness(np.eye(5, dtype=bool)) == 0.0


def test_local_and_subpixel_matching():
    rng = np.random.default_rng(32)
    y, x = np.mgrid[:32, :32]
    f = sum(np.exp(-((y - b) ** 2 + (x - c) ** 2) / 20) for b, c in rng.uniform(8, 24, (5, 2)))
    for move in ((0.4, -0.3), (2.6, 1.2), (-3.0, 2.0)):
        got = shifts.match_template(f, images.translate(f, *move), 6, subpixel=True)
        assert got == pytest.approx([-move[0], -move[1]], abs=0.35)
        assert shifts.match_template(f, images.translate(f, *move), 6) == pytest.approx(np.round([-move[0], -move[1]]), abs=1)
    wave = np.sin(2 * np.pi * x / 8) + 0.01 * y
    assert abs(shifts.match_template(wave, np.roll(wave, 1, 1), 12, local=True)[1]) <= 1
    flat = np.ones((6, 6))
    assert (shifts.match_template(flat, flat, 2) == 0).all()


def test_fields_of_shifts_are_applied():
    rng = np.random.default_rng(33)
    f = images.gaussian_filter(rng.normal(size=(1, 64, 64)), 9, 2.0)[0]
    uniform = np.full((4, 4, 2), (1.5, -2.0))
    assert shifts.apply_field(f, uniform, 16) == pytest.approx(images.translate(f, 1.5, -2.0))
    field = np.zeros((4, 4, 2))
    field[:2, :, 0], field[2:, :, 0] = 1.0, -1.0
    warped = shifts.apply_field(f, field, 16)
    back = shifts.patch_field(f, warped, 16)
    fixed = shifts.apply_field(warped, back, 16)
    inner = slice(10, 54)
    assert np.abs(fixed - f)[inner, inner].mean() < 0.6 * np.abs(warped - f)[inner, inner].mean()
