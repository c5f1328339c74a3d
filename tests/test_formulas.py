"""Operators against values worked out by hand or by plain loops from the documented formulas."""

import json
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiegrid.operators import catalog, experiments, features, fit, jobs, patches, points, quality, raster, selection, solvers
from tiegrid.plans.work import join_on_hot_keys, running_sums
from tiegrid.streaming import jobs as streams

from .test_units import AFFINE, MATCH, PROJECTIVE, events, made, run_stream

PIXELS = "image_id bigint, x bigint, y bigint, v double"


def image(spark, a, image_id=1):
    return spark.createDataFrame([(image_id, x, y, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], PIXELS)


def grid(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


def test_disk_functions(spark):
    angles = spark.createDataFrame([(1, 60.0, 0.0, 30.0), (2, 60.0, 0.0, None), (3, None, None, None), (4, 90.0, 60.0, 90.0)], "image_id bigint, incidence double, emission double, phase double")
    of = lambda model: {r[0]: r[1] for r in angles.select("image_id", raster.disk_function(model, F.col("incidence"), F.col("emission"), F.col("phase"))).collect()}
    lunar = of("lunar_lambert")
    # exp(-1/2) = 0.60653066; 2 * 0.5 / 1.5 = 0.66666667.
    assert lunar[1] == pytest.approx(0.39346934 * 0.66666667 + 0.60653066 * 0.5) and lunar[2] == pytest.approx(0.5) and lunar[3] == pytest.approx(1.0)
    assert lunar[4] == pytest.approx(0.77686984 * 2e-6 / (0.5 + 1e-6) + 0.22313016e-6, rel=1e-6)
    hapke = of("hapke")
    # Phase 0: lobes (1 - 0.0441) / 1.21**3 and / 0.79**3, weights 0.3 and 0.7; B = 0.9.
    p = 0.3 * 0.9559 / 1.771561 + 0.7 * 0.9559 / 0.493039
    assert hapke[2] == pytest.approx(0.21 / (4 * math.pi) / 3 * (1.9 * p + 1)) and hapke[3] == pytest.approx(0.21 / (4 * math.pi) / 2 * (1.9 * p + 1))
    assert set(of("none").values()) == {1.0}


def test_covariance_flags_and_score(spark):
    rows = [(1, 1.0, 0.5, 10.0, 0.8), (2, 1.0, 0.6, 190.0, 0.8), (3, 2.0, 0.9, 0.0, 0.8), (4, 2.0, 1.0, 0.0, 0.8), (5, 2.4, 0.6, 0.0, 0.8), (6, None, None, None, None), (7, 0.3, 0.9, 0.0, 1.0), (8, 1.3, 0.7, 0.0, 1.0)]
    m = spark.createDataFrame(rows, "match_id bigint, sigma_major double, sigma_minor double, angle double, confidence double")
    got = {r["match_id"]: r for r in points.covariance_axes(m).collect()}
    flags = {k: (r["is_elongated"], r["is_isotropic"], r["is_uncertain"]) for k, r in got.items()}
    assert flags == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True), 4: (False, False, True), 5: (True, False, False), 6: (False, True, False), 7: (False, True, False), 8: (False, False, False)}
    assert got[2]["axis_angle"] == 10 and got[7]["axis_minor"] == 0.3 and got[6]["axis_major"] == 0.5 and got[6]["trace"] == pytest.approx(0.5)
    score = {r["match_id"]: r["rank_score"] for r in points.score_covariance(m).collect()}
    assert score[1] == pytest.approx(0.8 / (1 + 0.5 * 0.5**0.5) * (1 + 0.6 / 2)) and score[6] == pytest.approx(1 / (1 + 0.5 * 0.5**1.2) * 1.3)
    c = spark.createDataFrame([(1, None, None, None, 2.0, 1.0, 2.0), (2, None, 0.5, 20.0, 1e6, 0.0, 1e-9), (3, 1.0, 0.5, 0.0, None, 0.0, 1.0)], "match_id bigint, sigma_major double, sigma_minor double, angle double, cxx double, cxy double, cyy double")
    got = {r["match_id"]: r for r in points.covariance_axes(c).collect()}
    assert got[1]["axis_major"] == pytest.approx(math.sqrt(3)) and got[1]["axis_minor"] == pytest.approx(1) and got[1]["axis_angle"] == pytest.approx(45) and got[1]["cxy"] == 1
    assert got[2]["axis_major"] == pytest.approx(10) and got[2]["axis_minor"] == pytest.approx(0.01) and got[2]["axis_angle"] == 20 and got[3]["cxx"] == pytest.approx(1)


def test_spatial_quality(spark):
    p = spark.createDataFrame([(1, 0.4, 1.0, 128.0, 300.0), (2, None, None, None, None), (3, 2.0, 9.0, 0.0, 5.0)], "kp bigint, uniqueness double, refine_px double, kx double, ky double")
    got = {r["kp"]: r["quality"] for r in patches.spatial_quality(p, 512.0, 512.0).collect()}
    assert got[1] == pytest.approx(0.2 + 0.35 * math.exp(-0.75) + 0.15 * 0.5) and got[2] == pytest.approx(0.25 + 0.35 * 0.35 + 0.075) and got[3] == pytest.approx(0.5 + 0.35 * 0.15 + 0.15 * 0.05)


def test_calibration_verdicts(spark):
    rng = np.random.default_rng(4)
    for scale, want in ((1.0, "PROBABILISTICALLY_CALIBRATED"), (3.0, "OVERCONFIDENT_UNCALIBRATED"), (0.3, "CONSERVATIVE_BOUNDS")):
        e = rng.normal(0, math.sqrt(scale), (2000, 2))
        rows = [(float(x), float(y), 1.0, 0.0, 1.0, "valid" if k % 10 else "flat_peak", bool(k % 10)) for k, (x, y) in enumerate(e)]
        r = experiments.calibration_report(spark.createDataFrame(rows, "error_x double, error_y double, cxx double, cxy double, cyy double, status string, is_valid boolean")).first()
        d2 = (e**2).sum(1)[[k for k in range(2000) if k % 10]]
        observed = [round(float((d2 <= -2 * math.log(1 - p)).mean()), 4) for p in experiments.LEVELS]
        assert r["verdict"] == want and r["reliability"] == pytest.approx(observed, abs=1e-4) and r["flat_rate"] == 0.1 and r["n_failed"] == 0
        assert r["ece"] == pytest.approx(np.mean(np.abs(np.array(observed) - experiments.LEVELS)), abs=1e-4) and r["scale_factor"] == pytest.approx(np.median(d2) / (2 * math.log(2)))
        assert r["inside_p95"] == pytest.approx((np.sqrt(d2) <= 2.4860).mean())


def sobel(p):
    q = np.pad(p, 1, mode="reflect")
    s = lambda dy, dx: q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
    return s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1), s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)


def test_orientation_patches(spark):
    a, b = np.random.default_rng(5).normal(size=(2, 30, 30))
    pa, pb = image(spark, a), image(spark, b)
    kp = spark.createDataFrame([(1, 1, 15, 14), (1, 2, 2, 3), (1, 3, 90, 90)], "image_id bigint, kp_id bigint, kx bigint, ky bigint")
    got = {r["kp_id"]: np.array(r["desc"]) for r in patches.orientation_histogram(pa, kp, 4, 8).collect()}
    for k, kx, ky in ((1, 15, 14), (2, 2, 3)):
        patch = a[max(0, ky - 4) : ky + 4, max(0, kx - 4) : kx + 4]
        gx, gy = sobel(patch)
        want = []
        h, w = (max(1, n // 2) for n in patch.shape)
        for cy in (0, h):
            for cx in (0, w):
                turn = np.clip(((np.arctan2(gy, gx) + np.pi) / (2 * np.pi) * 8).astype(int), 0, 7)[cy : cy + h, cx : cx + w]
                want += [np.hypot(gx, gy)[cy : cy + h, cx : cx + w][turn == n].sum() for n in range(8)]
        assert np.allclose(got[k], np.array(want) / np.linalg.norm(want))
    assert not got[3].any()
    pairs = spark.createDataFrame([(1, 1, 15, 14, 12, 17), (1, 2, 15, 14, 2, 3)], "image_id bigint, kp_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    agreed = {r["kp_id"]: r["agreement"] for r in patches.orientation_agreement(pa, pb, pairs, 4).collect()}
    (ax, ay), (bx, by) = sobel(a[10:18, 11:19]), sobel(b[13:21, 8:16])
    w = np.hypot(ax, ay) * np.hypot(bx, by)
    assert agreed[1] == pytest.approx((w * (np.cos(np.arctan2(ay, ax) - np.arctan2(by, bx)) ** 2)).sum() / w.sum()) and agreed[2] == 0.5
    same = patches.orientation_agreement(pa, image(spark, -a), pairs.selectExpr("image_id", "kp_id", "x1", "y1", "x1 AS x2", "y1 AS y2"), 4).filter("kp_id = 1").first()
    assert same["agreement"] == pytest.approx(1)


def test_bit_codes_destripe_and_masks(spark):
    a = np.array([[0.0, 1, 2], [3, 4, 5], [6, 7, 8]])
    code = grid(raster.lbp(image(spark, a)), "code", a.shape)
    # Clockwise from the upper left, bit 0 first; edges repeat, so equal neighbours set bits.
    assert code[1, 1] == 8 + 16 + 32 + 64 and code[0, 0] == 255
    assert grid(raster.census(image(spark, a)), "code", a.shape)[1, 1] == 16 + 32 + 64 + 128
    striped = np.array([[2.0, -3, 8], [2, -3, 8], [4, -1, 8]])
    # Column medians 2, -3 and 8, their median 2: the second column stays.
    assert np.allclose(grid(raster.destripe(image(spark, striped)), "v", a.shape), striped * [1, 1, 0.25])
    zero = striped - [2, 0, 0]
    assert np.allclose(grid(raster.destripe(image(spark, zero)), "v", a.shape), zero)
    holes = np.arange(100.0).reshape(10, 10)
    holes[0, 0], holes[9, 9] = np.nan, np.inf
    mask = grid(raster.shadow_mask(image(spark, holes)).withColumn("shadow", F.col("shadow").cast("double")), "shadow", holes.shape)
    assert mask[0, 0] == mask[9, 9] == 1 and mask.sum() == 2 + 3
    dark = spark.createDataFrame([(1, 85.0)], "image_id bigint, incidence double")
    assert raster.shadow_mask(image(spark, holes), 0.03, dark).filter("NOT shadow").count() == 0
    assert raster.shadow_mask(image(spark, np.full((2, 2), np.nan))).filter("shadow").count() == 0
    flat = grid(raster.stretch01(image(spark, np.full((3, 3), 7.0))), "v", (3, 3))
    assert not flat.any() and np.isnan(grid(raster.stretch01(image(spark, holes)), "v", holes.shape)[0, 0])


def test_spectral_gate_and_residuals(spark):
    bands = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]]
    cube = spark.createDataFrame([(1, k, 0, b) for k, b in enumerate(bands)], "image_id bigint, x bigint, y bigint, bands array<double>")
    angle = {r["x"]: r["angle"] for r in raster.spectral_angle(cube).collect()}
    assert angle[0] == pytest.approx(math.pi / 4, abs=1e-6) and angle[2] == pytest.approx(0, abs=1e-3) and angle[3] == pytest.approx(math.pi / 2)
    assert raster.spectral_angle(cube, reference=[1.0, 0.0]).filter("x = 1").first()["angle"] == pytest.approx(math.pi / 2)
    overlay = spark.createDataFrame([(1, k, 0, v) for k, v in enumerate((9.0, 2.0, 4.0, 5.0))], PIXELS)
    gated = raster.sam_gate(overlay, raster.spectral_angle(cube), 0.35)
    assert {r["x"]: (r["v"], r["valid"]) for r in gated.collect()} == {0: (4.5, False), 1: (4.5, False), 2: (4.0, True), 3: (4.5, False)}
    assert raster.sam_gate_summary(gated).first()["rejected_fraction"] == 0.75
    r = raster.spectral_residuals(cube).first()
    assert r["spectral_variance"] == pytest.approx((0.25 + 0.25) / 4) and r["spectral_angle_deg"] == pytest.approx((45 + 45 + 0 + 90) / 4, abs=0.02)


def test_labels_tiles_and_gsd(spark):
    rows = [(1, "maybe", 1, None, None), (2, None, 0, None, None), (3, None, None, "yes", False), (4, None, None, "2", True), (5, "0", 5, None, None), (6, None, None, None, None)]
    m = spark.createDataFrame(rows, "match_id bigint, ground_truth_label string, hand_label int, label string, is_outlier boolean")
    got = {r["match_id"]: (r["truth"], r["truth_source"]) for r in features.label_matches(m, True).collect()}
    assert got == {1: (True, "hand"), 2: (False, "hand"), 3: (True, "ransac"), 4: (False, "ransac"), 5: (False, "synthetic_geometry"), 6: (None, "none")}
    assert {r["truth_source"] for r in features.label_matches(m).collect()} == {"hand", "synthetic_geometry", "none"}
    t = spark.createDataFrame([(1, 1, 4.4, 0.0), (1, 2, 4.6, 0.0), (1, 3, 5.9, 0.0), (1, 4, 1.5, 0.0), (1, 5, -1.4, 1.0)], "pair_id bigint, match_id bigint, source_x double, source_y double")
    assert sorted(r["match_id"] for r in selection.stitch_tiles(t).collect()) == [1, 2, 4]  # 1.47, 1.53, 1.97, 0.5 (to even), -0.47
    g = spark.createDataFrame([(1, 5.0, None, None, None), (2, 5.0, None, None, 2.0), (3, None, 4.0, None, 2.0), (4, 1.0, 10.0, None, 2.0), (5, None, None, None, None)], "id bigint, gsd double, native_gsd double, effective_gsd double, resampling_factor double")
    got = {r["id"]: (r["native_gsd"], r["effective_gsd"], r["gsd"], r["gsd_problem"]) for r in catalog.harmonize_gsd(g).collect()}
    assert got == {1: (5.0, 5.0, 5.0, None), 2: (5.0, 5.0, 5.0, "inconsistent"), 3: (4.0, 2.0, 2.0, None), 4: (10.0, 1.0, 1.0, "inconsistent"), 5: (None, None, None, "native_gsd")}


def exact_p(b, c):
    n, total, term = b + c, Fraction(0), Fraction(1)
    for k in range(min(b, c) + 1):
        total += term
        term = term * (n - k) / (k + 1)
    return float(min(Fraction(1), 2 * total / 2**n))


def test_paired_test_is_exact_at_every_size(spark):
    cases = [(0, 0), (1, 0), (3, 9), (12, 11), (1000, 1100), (1500, 1700), (9000, 9400), (5, 3000)]
    rows = [(k, x, not x) for k, (b, c) in enumerate(cases) for x, n in ((True, b), (False, c)) for _ in range(n)] + [(0, True, True)]
    got = {r["k"]: r for r in experiments.mcnemar(spark.createDataFrame(rows, "k int, x boolean, y boolean"), "x", "y", "k").collect()}
    for k, (b, c) in enumerate(cases):
        assert (got[k]["b"], got[k]["c"]) == (b, c) and got[k]["p_value"] == pytest.approx(exact_p(b, c), rel=1e-8)


def test_arms_and_samples(spark):
    rows = [("same", k, arm, (k + (arm == "new")) % 3 > 0, float(k + 5 * (arm == "new"))) for k in range(9) for arm in ("base", "new")]
    got = {r["domain"]: r for r in experiments.compare_arms(spark.createDataFrame(rows, "domain string, pair_id int, arm string, success boolean, inliers double"), {"inliers": "higher"}).collect()}
    assert set(got) == {"same", None} and got["same"]["median_inliers_new"] == 9 and got["same"]["verdict_inliers"] == "IMPROVED" and (got[None]["b"], got[None]["c"], got[None]["p_value"]) == (3, 3, 1.0)
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 300).round(1), rng.normal(0.5, 1, 200).round(1)
    df = spark.createDataFrame([(float(v), s, bool(v > 0)) for s, x in (("a", a), ("b", b)) for v in x] + [(None, "a", True), (float("nan"), "b", True)], "v double, s string, t boolean")
    r = experiments.ks_two_sample(df, "v", F.col("s") == "a", "t").first()
    every = np.unique(np.concatenate((a, b)))
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in every)
    assert r["d"] == pytest.approx(d) and (r["n_a"], r["n_b"]) == (300, 200) and r["mean_a"] == pytest.approx(a.mean()) and r["std_b"] == pytest.approx(b.std()) and r["prevalence_a"] == pytest.approx(((a > 0).sum() + 1) / 301)


def test_sums_and_joins_by_pieces(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 1000)
    df = spark.createDataFrame([(int(x), int(k)) for k, x in enumerate(v)], "v int, w bigint")
    for down in (False, True):
        for r in running_sums(df, "v", ["w"], down, 16).distinct().collect()[:200]:
            assert r["upto_w"] == sum(k for k, x in enumerate(v) if (x >= r["v"] if down else x <= r["v"]))
    rows = spark.range(5000).selectExpr("CASE WHEN id < 3000 THEN 7 ELSE id END AS k", "id")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    assert sorted(map(tuple, join_on_hot_keys(rows, keyed, "k", "n").select("k", "id", "first").collect())) == sorted((7, i, 0 if i < 3000 else 0) if i < 3000 else (i, i, i) for i in range(5000))


def test_condition_numbers(spark):
    rng = np.random.default_rng(3)
    every = [rng.normal(size=9) * 10.0 ** rng.integers(-2, 3, 9) for _ in range(50)] + [np.array([1.01, -0.02, 300, 0.015, 0.99, -200, 0, 0, 1]), np.eye(3).ravel(), np.ones(9)]
    df = spark.createDataFrame([(k, [float(v) for v in m]) for k, m in enumerate(every)] + [(99, None), (98, [float("nan")] * 9)], "k int, h array<double>")
    got = {r["k"]: r["c"] for r in df.select("k", quality.condition3(F.col("h")).alias("c")).collect()}
    for k, m in enumerate(every[:-1]):
        assert got[k] == pytest.approx(np.linalg.cond(m.reshape(3, 3)), rel=1e-4)
    assert got[99] is None and got[98] is None and (got[52] is None or got[52] > 1e12)


def test_consensus_passes_over_a_degenerate_map(spark):
    """Most matches lie on a line and agree with a flattened map; the sound one with fewer matches is taken."""
    good = made(spark, 1, AFFINE, 25, 0.01)
    flat = [(1, 100 + k, 200.0 * k, 200.0 * k + 0.001 * (k % 3), 300.0, 300.0) for k in range(40)]
    m = spark.createDataFrame([(*r, 1.0) for r in good + flat], MATCH + ", w double")
    found = fit.consensus_fit(m, 2.0, 400).first()
    assert np.allclose(found["h"][:2], AFFINE[:2], atol=0.01) and found["inliers"] >= 25
    heavy = m.withColumn("w", F.when(F.col("match_id") < 25, 1.0).otherwise(0.01))
    assert np.allclose(fit.consensus_fit(heavy, 2.0, 400, weight="w").first()["h"], AFFINE, atol=0.05)


def test_budget_keeps_crowded_cells_from_deciding(spark):
    """300 wrong matches crowd one cell; with four from each cell the spread ones decide."""
    crowd = [(1, 1000 + k, 10 + (k % 17) / 10, 10 + (k // 17) / 10, 400 + (k % 17) / 10, 300 + (k // 17) / 10) for k in range(300)]
    m = spark.createDataFrame([(*r, 0.9) for r in made(spark, 1, AFFINE, 80, 0.2) + crowd], MATCH + ", confidence double")
    found = jobs.register_pairs(m, 512.0, 512.0).first()
    assert found["status"] == "registered" and np.allclose(found["h"][:2], AFFINE[:2], atol=0.02) and found["candidates"] == 380 and found["selected"] <= 84


def test_whitened_homography(spark):
    rng = np.random.default_rng(8)
    rows = []
    for r in made(spark, 1, PROJECTIVE, 80):
        bad = r[1] % 2 == 0
        s = 4.0 if bad else 0.05
        rows.append((*r[:4], r[4] + rng.normal(0, s), r[5] + rng.normal(0, 0.05), s, 0.05, 0.0))
    m = spark.createDataFrame(rows, MATCH + ", sigma_major double, sigma_minor double, angle double")
    off = lambda mode: np.abs(np.array(solvers.fit_homography(m, mode=mode).first()["h"]) / np.array(PROJECTIVE) - 1).max()
    plain, scaled, white = map(off, ("ordinary", "scaled", "whitened"))
    assert white < plain / 3 and scaled < plain and white < 0.3
    with pytest.raises(ValueError, match="no mode"):
        solvers.fit_homography(m, mode="x")


def test_hull_and_displacement(spark):
    p = spark.createDataFrame([(1, float(x), float(y)) for x, y in ((0, 0), (9, 0), (9, 9), (0, 9), (5, 5), (5, 0), (-3, 4), (99, 4))] + [(2, 1.0, 1.0), (2, 2.0, 2.0)], "image_id bigint, px double, py double")
    hulls = {r["image_id"]: {(c["x"], c["y"]) for c in r["hull"]} for r in patches.inlier_hulls(p, 10, 10).collect()}
    assert hulls == {1: {(0, 0), (9, 0), (9, 9), (0, 9)}}
    a = np.random.default_rng(6).normal(size=(40, 40))
    b = -np.roll(a, (2, -1), (0, 1))  # inverted and moved by (-1, 2)
    kp = spark.createDataFrame([(1, 1, 20, 20)], "image_id bigint, kp_id bigint, kx bigint, ky bigint")
    found = patches.search_displacement(image(spark, a), image(spark, b), kp, 5, 4, multimodal=True).first()
    assert (found["dx"], found["dy"]) == (-1, 2) and found["ncc"] == pytest.approx(-1)
    assert found["score"] == pytest.approx(0.6, abs=0.02)


def test_topology_equals_loops(spark):
    rng = np.random.default_rng(9)
    m = [(1, k, *map(float, rng.uniform(0, 300, 4))) for k in range(20)]
    r = features.topology_preservation(spark.createDataFrame(m + [(2, k, 1.0, 2.0, 3.0, 4.0) for k in range(3)], MATCH)).collect()
    assert len(r) == 1
    s, t = np.array(m)[:, 2:4], np.array(m)[:, 4:6]
    d = lambda p, i, j: np.linalg.norm(p[i] - p[j])
    ratios = [d(t, i, j) / d(s, i, j) for i in range(20) for j in range(i + 1, 20) if d(s, i, j) > 5]
    turns = []
    for i in range(20):
        a, b = np.argsort(np.linalg.norm(s - s[i], axis=1))[1:3]
        angle = lambda p: math.degrees(math.acos(np.clip((p[a] - p[i]) @ (p[b] - p[i]) / (d(p, a, i) * d(p, b, i) + 1e-6), -1, 1)))  # noqa: B023, E731
        turns.append(abs(angle(s) - angle(t)))
    shapes, areas = [], []
    for i in range(15):
        for j in range(i + 1, 15):
            for k in range(j + 1, 15):
                x, y = (np.sort([d(p, i, j), d(p, j, k), d(p, k, i)]) for p in (s, t))
                shapes.append(np.abs(x / x.sum() - y / y.sum()).sum())
                area = lambda v: math.sqrt(max(0, np.prod(v.sum() / 2 - v) * v.sum() / 2))
                if area(x) > 10:
                    areas.append(area(y) / area(x))
    want = (np.mean(ratios), np.std(ratios), np.mean(turns), np.median(turns), np.mean(shapes), np.mean(areas))
    assert [r[0][c] for c in ("mean_ratio", "std_ratio", "angle_mean", "angle_median", "shape_mean", "area_ratio")] == pytest.approx(want)


@pytest.mark.parametrize("spread", [1.0, 400.0])
def test_nearest_equals_loops(spark, spread):
    rng = np.random.default_rng(7)
    m = [(1, k, *map(float, (rng.normal(0, 1 if k % 5 else spread, 2))), 0.0, 0.0) for k in range(150)] + [(2, k, float(k), 0.0, 0.0, 0.0) for k in range(3)]
    got = {}
    for r in features.nearest(spark.createDataFrame(m, MATCH), 4).collect():
        got.setdefault((r["pair_id"], r["match_id"]), []).append((r["rank"], r["o_match_id"]))
    for p, i, x, y, *_ in m:
        others = sorted((math.hypot(x - u, y - v), j) for q, j, u, v, *_ in m if q == p and j != i)[:4]
        assert [j for _, j in sorted(got[p, i])] == [j for _, j in others]


def test_networks_of_triplets(spark):
    rows = []
    for t in (1, 2):
        for k, (src, ref) in enumerate([(2, 1), (3, 1), (3, 2)]):
            turned = [1, 0, 10.0 * (src - ref) * t, 0, 1, 0, 0, 0, 1]
            rows += [(t, 10 * t + src, 10 * t + ref, *r[2:]) for r in made(spark, 1, turned, 40, 0.1, 7 * t + k)]
    rows += [(3, 32, 31, *r[2:]) for r in made(spark, 1, AFFINE, 10)]
    m = spark.createDataFrame(rows, "triplet_id bigint, src bigint, ref bigint, source_x double, source_y double, target_x double, target_y double")
    poses, report = solvers.adjust_network(m, network="triplet_id")
    at, status = {r["image_id"]: r["h"][2] for r in poses.collect()}, {r["triplet_id"]: r for r in report.collect()}
    assert abs(at[13] - 20) < 0.5 and abs(at[23] - 40) < 0.5 and at[11] == at[21] == 0 and 31 not in at
    assert status[3]["status"] == "failed" and status[1]["rmse_after"] <= status[1]["rmse_before"] + 1e-9
    legs = spark.createDataFrame([(t, leg, [float(k % 4 == 0) for k in range(9)]) for t in (1, 3) for leg in ("AB", "BC", "CA")], "triplet_id bigint, leg string, h array<double>")
    refs = spark.createDataFrame([(1, 0.6, 6, "LOW_CONFIDENCE")], "triplet_id bigint, fit_rmse double, inliers int, quality_tier string")
    got = {r["triplet_id"]: r for r in jobs.evaluate_triplets(legs, 512.0, 512.0, m, refs).collect()}
    assert got[1]["rmse"] == 0 and got[1]["reference_fit_rmse"] == 0.6 and got[3]["network_status"] == "failed" and got[3]["reference_inliers"] is None


def test_split_is_written(spark, tmp_path):
    df = spark.createDataFrame([(f"g{k % 12}", k % 3 == 0) for k in range(120)], "g string, y boolean")
    split = features.grouped_split(df, "g", "y", 0.3)
    features.persist_split(split, "g", str(tmp_path))
    sides = [{json.loads(line)["g"] for f in (tmp_path / n).glob("*.json") for line in f.read_text().splitlines()} for n in ("train_groups", "test_groups")]
    assert sides[0] | sides[1] == {f"g{k}" for k in range(12)} and not sides[0] & sides[1]


def test_job_state_stream_equals_its_twin(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    fields = lambda df: df.withColumns({"stage": streams.stage_of(F.col("line"))["stage"], "error": F.when(F.col("is_failure"), F.col("line"))})
    run_stream(streams.job_state_stream(fields(stream), ["stage", "error"], 3_600_000), "state", "update", spark, tmp_path)
    last = spark.sql("SELECT job_id, max(updated) AS updated, max_by(stage, updated) AS stage, max_by(error, updated) AS error FROM state GROUP BY job_id")
    twin = streams.job_state(fields(batch), ["stage", "error"], "7 DAYS", F.lit(batch.agg(F.max("ts")).first()[0]))
    assert sorted(map(str, last.collect())) == sorted(map(str, twin.collect()))


def test_suppression_radii(spark):
    """Scores 1.0, 0.95, 0.93: each of the earlier ones exceeds 0.9 of the later."""
    rows = [(1, 1, 0.0, 0.0, 1.0), (1, 2, 10.0, 0.0, 0.95), (1, 3, 11.0, 0.0, 0.93), (1, 4, 500.0, 0.0, 0.5)]
    m = spark.createDataFrame(rows, "pair_id bigint, match_id bigint, source_x double, source_y double, confidence double")
    assert {r["match_id"]: r["radius"] for r in selection.anms(m, 4).collect()} == {1: None, 2: 10.0, 3: 1.0, 4: 489.0}
    # With c of 1.06 only scores over 1.06 times the own count: 1.0 > 0.986 for the third, but not 1.0 > 1.007 for the second.
    assert {r["match_id"]: r["radius"] for r in selection.anms(m, 4, 1.06).collect()} == {1: None, 2: None, 3: 11.0, 4: 489.0}


def mirrored(a):
    return np.pad(a, 1, mode="reflect")


def plain_sobel(a):
    p = mirrored(a)
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return gx, gy


def test_profiles(spark):
    rng = np.random.default_rng(3)
    whole = rng.normal(size=(30, 34)).cumsum(0).cumsum(1)
    a, b = whole[2:26, 3:29], whole[5:25, 1:27]

    def blend(v):
        gx, gy = plain_sobel(v)
        g = np.hypot(gx, gy)
        return 0.6 * (v - v.mean()) / v.std() + 0.4 * (g - g.mean()) / g.std()

    found = {r["axis"]: r for r in raster.profile_shift(image(spark, a), image(spark, b), 6).collect()}
    for axis, mean in (("x", 0), ("y", 1)):
        p, q = blend(a).mean(mean), blend(b).mean(mean)
        scores = {s: sum(p[k] * q[k + s] for k in range(len(p)) if 0 <= k + s < len(q)) / (np.linalg.norm(p) * np.linalg.norm(q) + 1e-9) for s in range(-6, 7)}
        best = max(scores, key=scores.get)
        assert found[axis]["shift"] == best and found[axis]["score"] == pytest.approx(scores[best], rel=1e-9)
    flat = image(spark, np.ones((5, 5)))
    assert {r["score"] for r in raster.profile_shift(flat, flat, 2).collect()} == {0.0}


def test_terrain_figures(spark):
    y, x = np.mgrid[0:6, 0:7]
    z = 0.5 * x * x + 0.25 * y * y + 3.0 * x
    p = mirrored(z)
    curved = 2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * z
    gx, gy = plain_sobel(z)
    for gsd in (1.0, 2.0):
        r = raster.terrain_metrics(image(spark, z), gsd).first()
        slope = np.degrees(np.arctan(np.hypot(gx, gy) / (8 * gsd)))
        assert r["mean_laplacian"] == pytest.approx(np.abs(curved).mean() / gsd**2) and r["mean_slope"] == pytest.approx(slope.mean()) and r["max_slope"] == pytest.approx(slope.max())
    # Inside the image the four corners lie 0.5 + 0.25 above the centre on average, each counted twice.
    assert curved[2, 3] == pytest.approx(2 * 4 * 0.75)
    plane = np.c_[x.ravel(), y.ravel(), np.ones(z.size)]
    off = z.ravel() - plane @ np.linalg.lstsq(plane, z.ravel(), rcond=None)[0]
    assert r["roughness"] == pytest.approx(off.std())
    holes = z.copy()
    holes[2, 2], holes[3, 3] = np.nan, np.inf
    filled = np.where(np.isfinite(holes), holes, holes[np.isfinite(holes)].mean())
    gx, gy = plain_sobel(filled)
    assert raster.terrain_metrics(image(spark, holes), 1.0).first()["max_slope"] == pytest.approx(np.degrees(np.arctan(np.hypot(gx, gy) / 8)).max())
    small = raster.terrain_metrics(image(spark, np.ones((3, 9))), 1.0).first()
    assert small["mean_slope"] is None and small["roughness"] is None
    assert raster.terrain_metrics(image(spark, np.full((5, 5), np.nan)), 1.0).first()["mean_slope"] is None


@pytest.mark.parametrize("azimuth,elevation,z_factor", [(315.0, 40.0, 1.0), (75.0, 3.0, 2.0), (200.0, 89.0, 1.0)])
def test_shaded_relief(spark, azimuth, elevation, z_factor):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(9, 11)).cumsum(0) * 30
    z[4, 4] = np.nan
    filled = np.where(np.isfinite(z), z, np.nanmean(z))
    gx, gy = (g / (8 * 10.0) * z_factor for g in plain_sobel(filled))
    slope, aspect = np.arctan(np.hypot(gx, gy)), np.arctan2(gx, -gy)
    e = min(max(elevation, 5), 85)
    zenith, sun = math.radians(90 - e), math.radians((360 - azimuth + 90) % 360)
    want = np.clip(math.cos(zenith) * np.cos(slope) + math.sin(zenith) * np.sin(slope) * np.cos(sun - aspect), 0, 1)
    assert np.allclose(grid(raster.hillshade(image(spark, z), azimuth, elevation, 10.0, z_factor, 0), "shade", z.shape), want, atol=1e-9)
    dx, dy = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth))
    step, dark = 1 / max(abs(dx), abs(dy)), np.zeros(z.shape, bool)
    for k in range(1, int(5 / step) + 1):
        sx, sy, up = round(k * dx * step), round(k * dy * step), k * step * 10.0 * math.tan(math.radians(e))
        for yy in range(z.shape[0]):
            for xx in range(z.shape[1]):
                if 0 <= yy + sy < z.shape[0] and 0 <= xx + sx < z.shape[1] and filled[yy + sy, xx + sx] > filled[yy, xx] + up:
                    dark[yy, xx] = True
    assert np.allclose(grid(raster.hillshade(image(spark, z), azimuth, elevation, 10.0, z_factor, 5), "shade", z.shape), np.where(dark, 0, want), atol=1e-9)


def test_slopes_at_the_nearest_pixel(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(8, 8)) * 10
    gy, gx = np.gradient(z, 2.0, 2.0)
    slope = np.hypot(gx, gy)
    at = rng.uniform(-1, 8.5, (12, 2))
    at[0], at[1] = (2.5, 3.5), (1.5, 0.5)  # halves go to the even pixel
    error = rng.uniform(0, 3, 12)
    near = slope[np.clip(np.round(at[:, 1]).astype(int), 0, 7), np.clip(np.round(at[:, 0]).astype(int), 0, 7)]
    rows = [(1, k, 1, float(x), float(y), float(e)) for k, ((x, y), e) in enumerate(zip(at, error, strict=True))]
    names = "pair_id bigint, match_id bigint, image_id bigint, px double, py double, error double"
    r = patches.slope_residual_corr(spark.createDataFrame([*rows, (1, 99, 1, 1.0, 1.0, float("inf"))], names), image(spark, z), 2.0).first()
    assert r["n"] == 12 and r["correlation"] == pytest.approx(np.corrcoef(error, near)[0, 1])
    assert patches.slope_residual_corr(spark.createDataFrame(rows[:3], names), image(spark, z), 2.0).first()["correlation"] == 0
    flat = [(*r[:5], 1.0) for r in rows]
    assert patches.slope_residual_corr(spark.createDataFrame(flat, names), image(spark, z), 2.0).first()["correlation"] == 0


def test_given_covariances_count(spark):
    """Eigenvalues of (9, 0, 1) are 9 and 1, whatever the sigmas say; without them the sigmas do."""
    names = "pair_id bigint, cxx double, cxy double, cyy double, sigma_major double, sigma_minor double, angle double"
    rows = [(1, 9.0, 0.0, 1.0, 0.5, 0.5, 0.0), (2, None, None, None, 0.5, 0.25, 90.0), (3, 400.0, 0.0, 1e-9, 0.5, 0.5, 0.0), (4, 2.0, 1.0, 2.0, None, None, None), (5, float("nan"), 0.0, 1.0, None, None, None)]
    found = {r["pair_id"]: (r["sxx"], r["sxy"], r["syy"]) for r in points.conditioned(spark.createDataFrame(rows, names)).collect()}
    want = {1: (9, 0, 1), 2: (0.0625, 0, 0.25), 3: (100, 0, 0.01), 4: (2, 1, 2), 5: (0.25, 0, 0.25)}
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_relief_strain_by_hand(spark):
    """A ridge: the global map misses by 2 px, local maps fit but where they straddle the ridge."""
    xy = [(float(x), float(y)) for x in range(0, 60, 10) for y in range(0, 40, 10)]
    rows = [(1, k, x, y, x + (4.0 if x >= 30 else 0.0) - 2.0, y) for k, (x, y) in enumerate(xy)]
    one = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "pair_id bigint, h array<double>")
    r = features.relief_strain(spark.createDataFrame(rows, "pair_id bigint, match_id bigint, source_x double, source_y double, target_x double, target_y double"), one).first()
    m = np.array(rows)
    squares = []
    for i in range(len(m)):
        near = m[np.lexsort((m[:, 1], np.arange(len(m)) != i, np.hypot(m[:, 2] - m[i, 2], m[:, 3] - m[i, 3])))[:6]]
        a = np.c_[near[:, 2:4], np.ones(6)]
        fit_uv = np.linalg.lstsq(a, near[:, 4:6], rcond=None)[0]
        squares.append(((np.array([m[i, 2], m[i, 3], 1]) @ fit_uv - m[i, 4:6]) ** 2).sum())
    local = math.sqrt(np.mean(squares))
    assert r["global_rmse"] == pytest.approx(2.0) and r["local_rmse"] == pytest.approx(local, abs=1e-6) and r["ratio"] == pytest.approx(2 / max(local, 0.05), rel=1e-5) and r["strained"]
    exact = [(*q[:4], q[2] + 1, q[3]) for q in rows]
    shifted = features.relief_strain(spark.createDataFrame(exact, "pair_id bigint, match_id bigint, source_x double, source_y double, target_x double, target_y double"), one).first()
    assert shifted["ratio"] == pytest.approx(1 / 0.05) and not shifted["strained"]  # a local error of 0 counts as 0.05


def test_no_place_under_a_map_is_no_crash(spark):
    """h33 and z of zero: figures are NULL, other rows go on."""
    flat = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -0.01, 0.0, 1.0]  # z is 0 at x = 100
    one, none = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0]
    h = spark.createDataFrame([(1, flat), (2, one), (3, none), (4, [float("nan")] * 9)], "pair_id bigint, h array<double>")
    truth = spark.createDataFrame([(k, one) for k in range(1, 5)], "pair_id bigint, h array<double>")
    assert {r["pair_id"]: r["corner_error"] for r in points.corner_error(h, truth, 100.0, 50.0).collect()} == {1: None, 2: 0.0, 3: None, 4: None}
    legs = [(1, "AB", one), (1, "BC", one), (1, "CA", none), (2, "AB", one), (2, "BC", one), (3, "AB", flat), (3, "BC", one), (3, "CA", one), (4, "AB", one), (4, "BC", one), (4, "CA", one)]
    legs = spark.createDataFrame(legs, "triplet_id bigint, leg string, h array<double>")
    done = {r["triplet_id"]: r for r in points.complete_cycle(legs).collect()}
    assert [done[k]["status"] for k in (1, 2, 3, 4)] == ["cycle_not_computable", "composed", "measured", "measured"]
    assert done[1]["ca"] is None and done[1]["composed"] is None and done[2]["composed"] == "CA"
    around = {r["triplet_id"]: r for r in points.cycle_consistency(legs, 9 * 100 / 0.7 / 3, 50.0).collect()}
    assert around[4]["rmse"] == 0 and around[4]["is_closed"] and around[1]["rmse"] is None and around[2]["rmse"] is None
    m = spark.createDataFrame([(k, 1, 100.0, 5.0, 1.0, 1.0) for k in range(1, 5)] + [(k, 2, 10.0, 5.0, 1.0, 1.0) for k in range(1, 5)], "pair_id bigint, match_id bigint, source_x double, source_y double, target_x double, target_y double")
    m = m.withColumns({c: F.lit(None).cast("double") for c in ("sigma_major", "sigma_minor", "angle")})
    assert points.residual_summary(m, h).count() == 4 and points.dual_rmse(m, h).count() == 4 and points.absolute_rmse(m, h, 1.0, 1.0).count() >= 2
    assert {r["pair_id"] for r in quality.transform_gate(h).filter("is_valid").collect()} == {1, 2}


def test_flat_patches_have_no_correlation(spark):
    a = np.random.default_rng(1).normal(size=(20, 20))
    a[:9, :9] = 5.0
    k = spark.createDataFrame([(1, 1, 4, 4), (1, 2, 14, 14)], "image_id bigint, kp_id bigint, kx bigint, ky bigint")
    found = {r["kp_id"]: r for r in patches.search_displacement(image(spark, a), image(spark, a), k, 2, 1).collect()}
    assert found.keys() == {2}
    assert (found[2]["dx"], found[2]["dy"]) == (0, 0) and found[2]["ncc"] == pytest.approx(1)


def test_heights_add_to_metres(spark):
    z = np.arange(20.0).reshape(4, 5) ** 2
    rows = [(1, 7, 0.0, 0.0, 1.2, 2.9), (1, 7, 3.0, 1.0, 9.0, -4.0), (2, 7, 1.0, 1.0, 1.0, 1.0)]
    m = spark.createDataFrame(rows, "pair_id bigint, image_id bigint, source_x double, source_y double, target_x double, target_y double")
    h = spark.createDataFrame([(k, [1.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for k in (1, 2)], "pair_id bigint, h array<double>")
    found = {r["pair_id"]: r["rmse_m"] for r in points.absolute_rmse(m, h, 2.0, 3.0, dem=image(spark, z, 7)).collect()}
    # (0.5, 0) against (1.2, 2.9): heights z[0, 0] and z[2, 1]; (3.5, 1) against (9, -4), clamped to (4, 0): z[1, 3] and z[0, 4].
    one = (0.7 * 2) ** 2 + (2.9 * 3) ** 2 + (z[2, 1] - z[0, 0]) ** 2
    two = (5.5 * 2) ** 2 + (5 * 3) ** 2 + (z[0, 4] - z[1, 3]) ** 2
    assert found[1] == pytest.approx(math.sqrt((one + two) / 2)) and found[2] == pytest.approx(1.0)


def plain_covering(kps, n, cols, rows, tolerance=0.1):
    """The halving search as it is described, one image at a time."""
    kps = sorted(kps, key=lambda k: (-k[3], k[0]))
    if len(kps) <= n:
        return {k[0] for k in kps}, None
    low, high, before, result, side = 1, max(cols, rows), -1, kps[:n], None
    while low < high:
        r = (low + high) // 2
        if r == before:
            break
        before, covered, side = r, {}, r
        for k in kps:
            cell = min(math.ceil(cols / r) - 1, max(0, int(k[1] / r))), min(math.ceil(rows / r) - 1, max(0, int(k[2] / r)))
            covered.setdefault(cell, k)
        result = list(covered.values())
        if len(result) > n * (1 + tolerance):
            low = r + 1
        elif len(result) < n * (1 - tolerance):
            high = r - 1
        else:
            break
    return {k[0] for k in result[:n]}, side


def test_square_covering_equals_the_search(spark):
    rng = np.random.default_rng(6)
    kps = {}
    for pair in range(8):
        xy = rng.uniform(-20, 340, (1, 2)) + rng.normal(0, 4 + 20 * pair, (30 + 40 * pair, 2))
        kps[pair] = [(k, float(x), float(y), float(round(c, 1))) for k, ((x, y), c) in enumerate(zip(xy, rng.random(len(xy)), strict=True))]
    kps[8] = [(k, 5.0, 5.0, 1.0) for k in range(60)]  # all in one place
    rows = [(pair, *k) for pair, some in kps.items() for k in some]
    m = spark.createDataFrame(rows, "pair_id bigint, match_id bigint, source_x double, source_y double, confidence double")
    for n in (10, 50):
        found = {}
        for r in selection.square_covering(m, n, 320, 240).collect():
            found.setdefault(r["pair_id"], (set(), set()))[0].add(r["match_id"])
            found[r["pair_id"]][1].add(r["cell_size"])
        for pair, some in kps.items():
            ids, side = plain_covering(some, n, 320, 240)
            assert found[pair] == (ids, {side})


def test_a_lone_neighbour_is_no_match(spark):
    names = "pair_id bigint, kp_id bigint, bands array<double>"
    source = spark.createDataFrame([(1, 1, [0.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, [0.0, 0.0]), (4, 1, [0.0, 0.0])], names)
    target = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, [1.0, 0.0]), (3, 2, [0.0, 3.0]), (4, 1, [1.0, 0.0]), (4, 2, [0.0, 1.0])], names)
    assert {r["pair_id"]: r["kept"] for r in features.descriptor_match(source, target).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_checkpoints_come_first(spark):
    rows = made(spark, 1, AFFINE, 12) + made(spark, 2, AFFINE, 5) + made(spark, 3, AFFINE, 3)
    m = spark.createDataFrame(rows, MATCH).withColumn("inlier", F.lit(True))
    h = spark.createDataFrame([(k, list(map(float, AFFINE))) for k in (1, 2, 3)], "pair_id bigint, h array<double>")
    moved = m.filter("pair_id < 3 AND match_id < 4").withColumn("target_x", F.col("target_x") + 2.0 * F.col("pair_id"))
    images = spark.createDataFrame([(1, 0.9, 0.5), (2, None, None)], "pair_id bigint, ssim double, nmi double")
    r = {x["pair_id"]: x for x in jobs.canonical_metrics(m, h, 512.0, 512.0, checkpoints=moved, images=images).collect()}
    assert [r[k]["validation"] for k in (1, 2, 3)] == ["checkpoints", "checkpoints", "none"] and r[1]["held_out"] == pytest.approx(2) and r[2]["held_out"] == pytest.approx(4)
    assert r[2]["verdict"] == "FAIL" and r[1]["ssim"] == 0.9 and r[3]["ssim"] is None and r[1]["nmi"] == 0.5
    plain = {x["pair_id"]: x for x in jobs.canonical_metrics(m, h, 512.0, 512.0).collect()}
    assert [plain[k]["validation"] for k in (1, 2, 3)] == ["holdout", "leave_one_out", "none"] and plain[1]["ssim"] is None
    assert plain[1]["composite"] != r[1]["composite"] and plain[2]["held_out"] == pytest.approx(0, abs=1e-6)


def test_training_rows_are_counted(spark):
    names = "file string, match_id bigint, source_x double, source_y double, target_x double, target_y double, confidence double, live double, human_label string, ground_truth_label boolean, source_image string, target_image string, region string"
    row = lambda f, i, x, c, live, human, truth: (f, i, x, 0.0, 0.0, 0.0, c, live, human, truth, "a", "b", "r")
    rows = [row("f1", 1, 1.0, 0.5, 1.0, None, True), row("f1", 2, 1.0, 0.5, 1.0, None, True), row("f1", 3, 2.0, None, 1.0, "no", None), row("f1", 4, 3.0, 0.5, None, "yes", None), row("f1", 5, 3.0, 0.5, float("nan"), "yes", None)]
    rows += [row("f2", 6, 1.0, 0.5, 1.0, None, True), row("f2", 7, 9.0, 0.5, 1.0, "?", None), row("f2", 8, 4.0, 0.1, 2.0, "yes", None)]
    m = spark.createDataFrame(rows, names)
    got = {r["file"]: tuple(r)[2:] for r in features.training_report(m, ["confidence", "live"], ["live"], defaults={"confidence": 0.0}).collect()}
    assert got["f1"] == (1, 1, 0, 2, 1, 2, 1, 0, "image_pair") and got["f2"] == (1, 0, 1, 0, 1, 1, 1, 0, "image_pair") and got[None] == (2, 1, 1, 2, 2, 3, 2, 0, "image_pair")
    kept = features.training_set(m, ["confidence", "live"], ["live"], {"confidence": 0.0}).collect()
    assert sorted(r["match_id"] for r in kept) == [1, 3, 8] and {r["match_id"]: r["confidence"] for r in kept}[3] == 0.0
