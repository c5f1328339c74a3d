"""Operators against hand-computed values and invariants."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiegrid.operators import catalog, features, fit, jobs, patches, points, quality, solvers
from tiegrid.plans.graph import connected_components
from tiegrid.sources import readers
from tiegrid.streaming import jobs as streams

MATCH = "pair_id bigint, match_id bigint, source_x double, source_y double, target_x double, target_y double"


def made(spark, pair, h, n, noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        x, y = rng.uniform(0, 500, 2)
        p = np.array(h).reshape(3, 3) @ [x, y, 1]
        u, v = p[:2] / p[2] + rng.normal(0, noise, 2)
        out.append((pair, k, float(x), float(y), float(u), float(v)))
    return out


AFFINE = [1.1, -0.2, 5, 0.1, 0.9, -3, 0, 0, 1]
PROJECTIVE = [1.05, 0.02, 4.0, -0.01, 0.98, 7.0, 1e-4, -5e-5, 1.0]


def test_affine_and_homography_recover_a_known_warp(spark):
    m = spark.createDataFrame(made(spark, 1, AFFINE, 30) + made(spark, 2, [*AFFINE[:6], 0, 0, 1], 2), MATCH)
    found = fit.fit_affine(m).collect()
    assert len(found) == 1 and np.allclose(found[0]["h"], AFFINE, atol=1e-9)
    h = solvers.fit_homography(spark.createDataFrame(made(spark, 1, PROJECTIVE, 40), MATCH)).first()["h"]
    assert np.allclose(h, PROJECTIVE, atol=1e-5)


def test_point_behind_the_plane_has_infinite_error(spark):
    df = spark.createDataFrame([(1, 1, -2e4, 0.0, 0.0, 0.0, PROJECTIVE)], MATCH + ", h array<double>")
    row = points.project(df).first()
    assert row["error"] == float("inf") and row["px"] is None


def test_leave_one_out_equals_refits(spark):
    rows = made(spark, 1, AFFINE, 7, 0.8)
    errors = []
    for k in range(7):
        rest = np.array([r[2:] for i, r in enumerate(rows) if i != k])
        a = np.c_[rest[:, :2], np.ones(6)]
        p = [np.linalg.lstsq(a, rest[:, c], rcond=None)[0] for c in (2, 3)]
        q = np.array([rows[k][2], rows[k][3], 1])
        errors.append(np.hypot(p[0] @ q - rows[k][4], p[1] @ q - rows[k][5]))
    found = fit.leave_one_out(spark.createDataFrame(rows, MATCH)).first()
    assert np.isclose(found["rmse"], np.sqrt(np.mean(np.square(errors)))) and np.isclose(found["median"], np.median(errors))


def test_consensus_survives_outliers(spark):
    rows = made(spark, 1, AFFINE, 60, 0.2) + [(1, 100 + k, float(7 * k), float(5 * k % 90), float(300 - k), float(11 * k % 400)) for k in range(25)]
    found = fit.consensus_fit(spark.createDataFrame(rows, MATCH), 2.0, 64).first()
    assert found["inliers"] >= 58 and np.allclose(found["h"][:2], AFFINE[:2], atol=0.01)


def test_gls_lowers_the_objective(spark):
    m = spark.createDataFrame([(*r, 0.2 + r[1] % 5, 0.1 + r[1] % 3 / 10, float(r[1] * 10)) for r in made(spark, 1, AFFINE, 60, 0.5)], MATCH + ", sigma_major double, sigma_minor double, angle double")
    start = fit.fit_affine(m)
    best = solvers.refine_gls(m, start)
    assert best.first()["status"] in ("converged", "max_rounds")
    assert best.first()["objective"] <= solvers.gls_objective(m, start).first()["objective"] + 1e-9


def test_network_closes(spark):
    rows = []
    for k, (src, ref) in enumerate([(2, 1), (3, 1), (3, 2)]):
        turned = [1, 0, 10.0 * (src - ref), 0, 1, 0, 0, 0, 1]
        rows += [(src, ref, *r[2:]) for r in made(spark, 1, turned, 40, 0.1, k)]
    poses, report = solvers.adjust_network(spark.createDataFrame(rows, "src bigint, ref bigint, source_x double, source_y double, target_x double, target_y double"))
    at = {r["image_id"]: r["h"][2] for r in poses.collect()}
    assert abs(at[2] - 10) < 0.5 and abs(at[3] - 20) < 0.5
    assert report.first()["rmse_after"] <= report.first()["rmse_before"]


def test_gate_and_lights(spark):
    t = spark.createDataFrame([(k, [float(v) for v in h]) for k, h in ((1, [1, 0, 0, 0, 1, 0, 0, 0, 1]), (2, [1, 0, 0, 0, 1e-6, 0, 0, 0, 1]), (3, [1, 0, 0, 0, 1, 0, 0.1, 0, 1]))], "pair_id bigint, h array<double>")
    assert {r["pair_id"]: r["is_valid"] for r in quality.transform_gate(t).collect()} == {1: True, 2: False, 3: False}
    m = spark.createDataFrame([(1, 0.9, 30, 0.5, 0.9, 0.5), (2, 0.2, 30, 0.5, 0.9, 0.5), (3, 0.6, 30, 3.5, 0.9, 0.5), (4, 0.6, 30, None, None, None), (5, 0.6, 25, 2.7, 0.9, 1.8)],
                              "pair_id bigint, inlier_ratio double, inliers int, held_out double, ssim double, fit_rmse double")
    lights = {r["pair_id"]: r for r in quality.traffic_light(m).collect()}
    assert [lights[k]["color"] for k in range(1, 6)] == ["GREEN", "RED", "RED", "YELLOW", "RED"]
    assert 90 <= lights[1]["light_score"] <= 100 and 60 <= lights[4]["light_score"] <= 89 and lights[2]["light_score"] <= 59


def test_polygon_clip(spark):
    square = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 2d, 'y', 0d), named_struct('x', 2d, 'y', 2d), named_struct('x', 0d, 'y', 2d))"
    diamond = "array(named_struct('x', 1d, 'y', -1d), named_struct('x', 3d, 'y', 1d), named_struct('x', 1d, 'y', 3d), named_struct('x', -1d, 'y', 1d))"
    far = "array(named_struct('x', 9d, 'y', 9d), named_struct('x', 10d, 'y', 9d), named_struct('x', 10d, 'y', 10d), named_struct('x', 9d, 'y', 10d))"
    area = lambda a, b: spark.range(1).select(catalog.shoelace(catalog.clip_ring(F.expr(a), F.expr(b)))).first()[0]
    assert area(square, diamond) == pytest.approx(4.0) and area(diamond, square) == pytest.approx(4.0) and area(square, far) == pytest.approx(0.0)
    half = square.replace("2d, 'y', 0d", "1d, 'y', 0d").replace("2d, 'y', 2d", "1d, 'y', 2d")
    assert area(square, half) == pytest.approx(2.0)


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(found[k] == 0 for k in range(51)) and all(found[k] == 100 for k in range(100, 160))
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_disjoint_groups(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "g string"), spark.createDataFrame([("y",), ("z",)], "g string")
    catalog.assert_disjoint(a, b.filter("g = 'z'"), "g")
    with pytest.raises(ValueError, match="both sides"):
        catalog.assert_disjoint(a, b, "g")
    with pytest.raises(ValueError, match="one class"):
        features.train_verifier(a.selectExpr("1d AS x", "true AS truth"), ["x"])


def test_pca_finds_the_main_axis(spark):
    rng = np.random.default_rng(0)
    rows = [(1, [float(v) for v in rng.normal(0, 5) * np.array([3.0, 4.0, 0.0]) / 5 + rng.normal(0, 0.1, 3)]) for _ in range(400)]
    first = solvers.band_pca(spark.createDataFrame(rows, "image_id bigint, bands array<double>"), 1).first()
    assert np.allclose(first["loadings"], [0.6, 0.8, 0.0], atol=0.02) and first["explained"] > 0.99


def test_relief_is_off_without_angles(spark):
    p = spark.createDataFrame([(1, 1, 1, 0.0, 0.0)], "pair_id bigint, match_id bigint, image_id bigint, px double, py double")
    assert [patches.relief_shift(p, None, e, a, 5.0).first()["reason"] for e, a in ((0.2, 10.0), (None, 10.0), (5.0, None))] == ["near_nadir", "emission_missing", "azimuth_missing"]


def test_register_pairs_names_each_failure(spark):
    good = made(spark, 1, AFFINE, 60, 0.2)
    few = made(spark, 2, AFFINE, 3)
    line = [(3, k, float(k), float(k), float(k), float(k)) for k in range(20)]
    m = spark.createDataFrame([(*r, 0.5) for r in good + few + line], MATCH + ", confidence double")
    found = {r["pair_id"]: r for r in jobs.register_pairs(m, 512.0, 512.0).collect()}
    assert [found[k]["status"] for k in (1, 2, 3)] == ["registered", "insufficient_correspondences", "geometric_verification_failed"]
    assert found[2]["h"] is None and found[1]["quality_tier"] == "HIGH_CONFIDENCE"


XML = """<a:Product xmlns:a="http://x"><a:logical_identifier>{id}</a:logical_identifier><a:instrument>{s}</a:instrument><a:pixel_resolution>5.0</a:pixel_resolution>
<a:incidence_angle>30</a:incidence_angle><a:west_bounding_coordinate>10</a:west_bounding_coordinate><a:east_bounding_coordinate>12</a:east_bounding_coordinate>
<a:south_bounding_coordinate>-1</a:south_bounding_coordinate>{north}<a:start_date_time>2020-01-02T03:04:05Z</a:start_date_time></a:Product>"""


def test_xml_labels(spark, tmp_path):
    north = "<a:north_bounding_coordinate>1</a:north_bounding_coordinate>"
    for name, text in {"a": XML.format(id="p1", s="OHRC", north=north), "b": XML.format(id="p1", s="OHRC", north=north), "c": "<broken", "d": XML.format(id="p2", s="camera", north=north), "e": XML.format(id="p3", s="TMC-2", north="")}.items():
        (tmp_path / f"{name}.xml").write_text(text)
    products, rejected = readers.read_xml_labels(spark, str(tmp_path))
    row = products.collect()
    assert len(row) == 1 and row[0]["sensor"] == "OHRC" and row[0]["sun_elevation"] == 60.0 and row[0]["gsd"] == 5.0 and row[0]["path"].endswith("a.xml")
    assert sorted(r["reason"] for r in rejected.collect()) == ["malformed", "no_footprint", "no_sensor"]


def test_keyvalue_labels(spark, tmp_path):
    (tmp_path / "x.lbl").write_text('A = 1 <deg> /* note */\nOBJECT = IMAGE\n  LINES = 512\n  OBJECT = SUB\n    NAME = "two\n    words"\n  END_OBJECT = SUB\nEND_OBJECT\nB = last\nEND\nC = never\n')
    found = {(r["object_path"], r["key"]): r["value"] for r in readers.read_keyvalue_labels(spark, str(tmp_path)).collect()}
    assert found == {("", "A"): "1", ("IMAGE", "LINES"): "512", ("IMAGE/SUB", "NAME"): "two words", ("", "B"): "last"}


def test_match_files_manifests_and_responses(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1/a_matches.json").write_text(json.dumps([{"image1_x": 1, "image1_y": 2, "image2_x": 3, "image2_y": 4, "confidence": 0.5}]))
    (tmp_path / "r1/b_matches.json").write_text(json.dumps({"all_matches": [{"source_x": 5.0, "source_y": 6.0, "target_x": 7.0, "target_y": 8.0, "score": 0.25, "is_inlier": True}]}))
    (tmp_path / "r1/c_matches.json").write_text("{broken")
    found = sorted(tuple(r)[2:8] for r in readers.read_match_files(spark, str(tmp_path)).collect())
    assert found == [(1.0, 2.0, 3.0, 4.0, 0.5, None), (5.0, 6.0, 7.0, 8.0, 0.25, True)]
    (tmp_path / "r1/manifest.json").write_text(json.dumps({"ohrc_product_id": "o", "bounds": {"west_lon": 1, "east_lon": 2, "south_lat": 3, "north_lat": 4}}))
    m = readers.read_manifests(spark, str(tmp_path)).first()
    assert m["region_id"] == "r1" and m["bounds"]["north_lat"] == 4.0
    body = json.dumps({"ODEResults": {"Products": {"Product": [{"pdsid": "P", "Incidence_angle": "40.5", "Westernmost_longitude": 1.5}, {"LabelURL": "u"}]}}})
    rows = readers.parse_candidate_responses(spark.createDataFrame([(body,), ("nonsense",)], "json string")).collect()
    assert [(r["product_id"], r["incidence"], r["west_lon"]) for r in rows] == [("P", 40.5, 1.5), ("UNKNOWN_PRODUCT", None, None)]


def test_tile_catalog_writes_flat_columns(spark, tmp_path):
    t = spark.createDataFrame([("t1", [1.0, 2.0], {"image": "a.tif"}), ("t2", [3.0, 4.0], {"mask": "m.tif"})], "tile_id string, bbox array<double>, files map<string,string>")
    t = t.withColumn("footprint", F.array(F.struct(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))))
    readers.write_tile_catalog(t, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out/csv"))
    assert back.columns == ["bbox", "file_image", "file_mask", "footprint", "tile_id"] and back.filter("tile_id = 't1'").first()["bbox"] == "1.0 2.0"


def events(spark, folder):
    rows = [(j, k * 10 + j, f"2024-01-01 00:{k:02d}:{j:02d}", "Stage 2/7" if k == 1 else "failure" if k % 2 else "x", k % 2 == 1, k == 6) for j in range(4) for k in range(12)]
    df = spark.createDataFrame(rows, "job_id bigint, event_id bigint, t string, line string, is_failure boolean, is_success boolean")
    df = df.withColumn("ts", F.to_timestamp("t")).drop("t")
    for k, part in enumerate(("event_id < 60", "event_id >= 60")):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(folder), spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def run_stream(df, name, mode, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_their_twins(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    progress = run_stream(streams.job_progress(stream), "progress", "complete", spark, tmp_path)
    assert sorted(map(tuple, progress.collect())) == sorted(map(tuple, streams.job_progress(batch).collect()))
    twin = {tuple(r) for r in streams.log_ring(batch, 5).collect()}
    ring = [tuple(r) for r in run_stream(streams.log_ring_stream(stream, 5), "ring", "update", spark, tmp_path).collect()]
    assert twin <= set(ring)
    lock = {tuple(r) for r in run_stream(streams.failure_lockout_stream(stream, 2, 300), "lock", "update", spark, tmp_path).collect()}
    assert lock == {tuple(r) for r in streams.failure_lockout(batch, 2, 300).collect()}
    assert [r["n"] for r in streams.logs_after(streams.log_ring(batch, 5), 1, 10).collect()] == [11, 12]


def test_incremental_ingest_adds_each_product_and_triplet_once(spark, tmp_path):
    rows = [(1, "OHRC", 10.0, 11.0, 0.0, 1.0), (2, "TMC", 9.0, 12.0, -1.0, 2.0), (3, "IIRS", 5.0, 15.0, -5.0, 5.0), (4, "OHRC", 10.2, 10.8, 0.2, 0.8), (1, "OHRC", 10.0, 11.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "product_id bigint, sensor string, west_lon double, east_lon double, south_lat double, north_lat double").withColumn("acquired", F.lit(None).cast("timestamp"))
    for k, part in enumerate(("product_id < 4", "product_id IN (1, 4)")):
        df.filter(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    places = [str(tmp_path / n) for n in ("catalog", "manifest", "checkpoint")]
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.incremental_ingest(stream, *places).awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(places[0]).select("product_id").collect()) == [1, 2, 3, 4]
    assert sorted(map(tuple, spark.read.parquet(places[1]).select("ohrc_id", "tmc_id", "iirs_id").collect())) == [(1, 2, 3), (4, 2, 3)]


def test_ingest_reads_only_tiles_near(spark, tmp_path):
    """Files of tiles far away can't even be read, and the next batch doesn't notice."""
    names = "product_id bigint, sensor string, west_lon double, east_lon double, south_lat double, north_lat double"
    far = [(k, ("OHRC", "TMC", "IIRS")[k % 3], 100.0 + k, 100.5 + k, 40.0, 40.5) for k in range(20, 60)]
    first = [(1, "OHRC", 10.0, 11.0, 0.0, 1.0), (3, "IIRS", -35.0, 15.0, -40.0, 40.0), *far]
    second = [(2, "TMC", 9.0, 12.0, -1.0, 2.0), (4, "OHRC", 10.2, 10.8, 0.2, 0.8), (1, "OHRC", 10.0, 11.0, 0.0, 1.0), (5, "TMC", None, 12.0, 0.0, 1.0), (4, "OHRC", 10.2, 10.8, 0.2, 0.9)]
    places = [str(tmp_path / n) for n in ("catalog", "manifest", "checkpoint")]

    def ingest():
        stream = spark.readStream.schema(names + ", acquired timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.incremental_ingest(stream, *places).awaitTermination(240)

    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, names).withColumn("acquired", F.lit(None).cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        ingest()
        if k == 0:
            spoiled = [f for f in (tmp_path / "catalog").glob("tile=0_*_8/run=*/*.parquet")]
            assert len(spoiled) >= 5
            for f in spoiled:
                f.write_bytes(b"not a table")
                (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert sorted(map(tuple, spark.read.parquet(places[1]).select("ohrc_id", "tmc_id", "iirs_id").collect())) == [(1, 2, 3), (4, 2, 3)]
    tiles = {p.parent.parent.name for p in (tmp_path / "catalog").glob("tile=*/run=*/*.parquet")}
    assert "tile=none" in tiles and "tile=4_-1_-1" in tiles


def test_home_tiles_hold_their_boxes(spark):
    import math
    import random

    pick = random.Random(3)
    boxes = []
    for k in range(60):
        w, s, size = pick.uniform(-180, 170), pick.uniform(-90, 80), pick.choice([0.1, 3.0, 5.0, 7.0, 33.0, 170.0])
        boxes.append((k, w, w + size, s, s + size * pick.random()))
    df = spark.createDataFrame(boxes, "product_id bigint, west_lon double, east_lon double, south_lat double, north_lat double")
    homes = {r["product_id"]: r["t"] for r in df.select("product_id", streams.home_tile(*(F.col(c) for c in ("west_lon", "east_lon", "south_lat", "north_lat"))).alias("t")).collect()}
    for k, w, e, s, n in boxes[:12]:
        near = set(streams.tiles_near(df.filter(F.col("product_id") == k)))
        for j, w2, e2, s2, n2 in boxes:
            if w2 <= e and e2 >= w and s2 <= n and n2 >= s:
                assert homes[j] in near
    level, x, y = map(int, homes[0].split("_"))
    size = 5 * 2**level
    assert x == math.floor(boxes[0][1] / size) and y == math.floor(boxes[0][3] / size)
