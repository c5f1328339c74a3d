"""Queries and operators on tables of other sizes and shapes than the given ones: larger ids, many rows in a group, regular tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tiegrid.operators import catalog
from tiegrid.plans.views import view


def write_images(spark, folder, ids):
    """``embeddings`` that hold the 64 x 64 images of these numbers."""
    rows = [(64 * i + y, [((x * 7 + y * 13 + i) % 41) / 20 - 1 for x in range(64)], 0) for i in ids for y in range(64)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")


def both(spark, folder, name):
    """The rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    return sorted(tuple(r) for r in df.select(columns).collect()), sorted(found.fetchall())


def test_hapke_of_a_sun_below_the_horizon(spark, tmp_path):
    write_images(spark, tmp_path, [0, 3, 11, 12])  # incidences 20, 41, 97, 104
    got, want = both(spark, tmp_path, "photometric_hapke")
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-3, rel=1e-9)


def test_elevations_of_parallel_lines_of_sight(spark, tmp_path):
    write_images(spark, tmp_path, [0, 3, 500])  # 520 and -20 degrees have one tangent
    got, want = both(spark, tmp_path, "disparity_to_dem")
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], nan_ok=True)
    assert any(r[0] == 500 and r[3] == float("inf") for r in got)


def test_elevations_of_nearly_parallel_lines_of_sight(spark, tmp_path):
    write_images(spark, tmp_path, [140, 320, 1760, 90500])  # the tangents differ in their last bits; of the last image Java's tangent is another
    got, want = both(spark, tmp_path, "disparity_to_dem")
    assert got == want and max(abs(r[3]) for r in got) > 1e15


def plan(df, mode="extended"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_paired_tiles_join_nothing(spark):
    df = __spark_entry__.queries()["paired_tiles"](spark, "/root/testdata/sf0.001")
    scans = plan(df, "simple")
    assert scans.count("customer.parquet") == 1


def test_exploded_patches_are_not_broadcast(spark):
    df = __spark_entry__.queries()["orientation_agreement"](spark, "/root/testdata/sf0.001")
    df.collect()
    final = plan(df, "simple").split("Initial Plan")[0]
    assert final.count("SortMergeJoin [image_id") >= 3  # two of patches and pixels, one of both patches' gradients


def test_draws_are_the_earliest_of_all_matches(spark, monkeypatch):
    from tiegrid.operators import consensus

    sizes = {1: 2, 2: 5, 3: 40, 4: 3000}
    rows = [(p, k, float(1 + (k * 7 + p) % 5)) for p, n in sizes.items() for k in range(n)]
    m = spark.createDataFrame(rows, "pair_id bigint, match_id bigint, _w double")
    wait = "-ln(((xxhash64(pair_id, match_id, hyp) & 9007199254740991) + 0.5D) / 9007199254740992D) / _w"
    every = m.crossJoin(spark.range(8).toDF("hyp")).selectExpr("*", f"row_number() OVER (PARTITION BY pair_id, hyp ORDER BY {wait}, match_id) AS k").filter("k <= 4")
    want = sorted(tuple(r) for r in every.select("pair_id", "hyp", "match_id").collect())
    for expected in (20, 3):  # with 3 many hypotheses have to be drawn again
        monkeypatch.setattr(consensus, "EXPECTED", expected)
        got = consensus.weighted_draws(m, 8, 4)
        assert sorted(tuple(r) for r in got.select("pair_id", "hyp", "match_id").collect()) == want
    sorts = plan(consensus.weighted_draws(m, 8, 4), "simple")
    assert "draws" in sorts  # written once


@pytest.mark.parametrize("pieces", [2, 7, 256])
def test_exact_percentiles_without_a_group_in_one_task(spark, pieces):
    from tiegrid.plans.work import exact_percentiles

    rows = [("a", float(k * 37 % 101)) for k in range(400)] + [("b", float(k // 50)) for k in range(301)] + [("c", 4.5), ("d", None), ("e", 1.0), ("e", 3.0), ("f", float("nan")), ("f", 2.0), ("f", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    want = df.filter("v IS NOT NULL").groupBy("g").agg(F.count("v").alias("n"), *(F.percentile("v", F.lit(s)).alias(f"p{k}") for k, s in enumerate(shares)))
    key = lambda df: sorted([repr(tuple(r)) for r in df.collect()])
    assert key(exact_percentiles(df, "g", "v", shares, pieces)) == key(want)


@pytest.mark.parametrize("name", ["benchmark_breakdown", "calibration_report", "compare_arms"])
def test_no_percentile_gathers_a_table(spark, name):
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert "percentile(" not in plan(df, "simple")


def test_resampling_by_lists_equals_resampling_by_tables(spark, monkeypatch):
    from tiegrid.operators import experiments, fit

    rows = [(p, k, float(k * 7919 % 512), float(k * 104729 % 509), float(k * 31 % 97), float(k * k % 89)) for p, n in {1: 5, 2: 80, 900: 400}.items() for k in range(n)]
    m = spark.createDataFrame(rows, "pair_id bigint, match_id bigint, source_x double, source_y double, target_x double, target_y double")
    found = []
    for most in (20_000, 100, 0):  # all by lists, both ways, all by tables
        monkeypatch.setattr(experiments, "LISTED", most)
        monkeypatch.setattr(fit, "LISTED", most)
        ci = sorted(tuple(r) for r in experiments.bootstrap_ci(m, "target_x", 12).collect())
        maps = sorted(tuple(r) for r in fit.bootstrap_transform(m, 12, gsd=5.0).drop("covariance").collect())
        found.append((ci, maps))
    for ci, maps in found[:2]:
        for got, want in ((ci, found[2][0]), (maps, found[2][1])):
            assert len(got) == len(want) == 3
            for a, b in zip(got, want, strict=True):
                assert [x for x in a if isinstance(x, str)] == [x for x in b if isinstance(x, str)]
                numbers = lambda r: [-1.0 if x is None else x for x in r if not isinstance(x, str)]
                assert numbers(a) == pytest.approx(numbers(b), rel=1e-7)


@pytest.mark.parametrize("name", ["bootstrap_ci", "bootstrap_transform"])
def test_resampling_makes_no_row_for_a_draw(spark, name):
    assert "slot" not in plan(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"), "simple")


def test_points_are_not_shuffled_by_image(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large
    try:
        text = plan(__spark_entry__.queries()["slope_residual_corr"](spark, "/root/testdata/sf0.001"), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin [image_id" in text


def boxes(spark, n, first=0, side=1.0):
    rows = [(k, 10.0, 10.0 + side, 10.0, 10.0 + side, None) for k in range(first, first + n)]
    return spark.createDataFrame(rows, "product_id bigint, west_lon double, east_lon double, south_lat double, north_lat double, incidence double")


def test_pairs_of_one_crowded_cell_are_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PAIRS_AT_ONCE", 1000)
    found = catalog.footprint_join(boxes(spark, 100), boxes(spark, 50, 1000), 0.5)
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 5000 and len(sizes) >= 3 and max(sizes) < 4000


def test_boxes_wider_than_a_cell_meet(spark):
    wide = boxes(spark, 1, 1, 170.0).unionByName(boxes(spark, 1, 2, 5.0)).unionByName(boxes(spark, 1, 3, 0.0))
    small = spark.range(0, 360).selectExpr("id AS product_id", "id - 5e0 AS west_lon", "id - 4.5e0 AS east_lon", "id - 5e0 AS south_lat", "id - 4.5e0 AS north_lat")
    found = sorted((r[0], r[1]) for r in catalog.overlapping(wide, small, "product_id", "product_id").select("product_id", "b_product_id").collect())
    reach = {1: 170.0, 2: 5.0, 3: 0.0}
    assert found == [(k, i) for k, w in reach.items() for i in range(360) if i - 5.0 <= 10 + w and i - 4.5 >= 10.0]


def test_ranks_shuffle_no_pairs(spark):
    df = catalog.rank_candidates(boxes(spark, 10), boxes(spark, 10, 1000))
    physical = plan(df, "simple")
    assert "Exchange" not in physical[physical.index("Window") : physical.index("SortMergeJoin")]


def test_areas_of_rings_are_computed_once(spark):
    df = __spark_entry__.queries()["polygon_join"](spark, "/root/testdata/sf0.001")
    physical = plan(df, "simple")
    assert physical.count("ArrowEvalPython") == 1


def test_rings_that_only_touch_share_nothing(spark):
    ring = lambda *p: "array(" + ", ".join(f"named_struct('x', {x}e0, 'y', {y}e0)" for x, y in p) + ")"
    notch = ring((0.1, 0.1), (3.1, 0.1), (3.1, 1.6), (1.6, 1.6), (1.6, 3.1), (0.1, 3.1))
    inside, across = ring((1.6, 1.6), (3.1, 1.6), (3.1, 3.1), (1.6, 3.1)), ring((1.1, 1.1), (2.1, 1.1), (2.1, 2.1), (1.1, 2.1))
    got = spark.range(1).select(*(catalog.shared_rings(F.expr(a), F.expr(b)) for a, b in ((notch, inside), (notch, across), (notch, "CAST(NULL AS array<struct<x:double,y:double>>)")))).first()
    assert got[0] == 0.0 and got[1] == pytest.approx(0.75) and got[2] is None


def test_no_pair_of_neighbours_is_shuffled(spark, monkeypatch):
    from tiegrid.operators import features

    rows = [(p, k, float(k * 7919 % 512), float(k * 104729 % 509), float(k), 0.0) for p, n in {1: 1, 2: 4, 3: 60, 4: 700}.items() for k in range(n)]
    rows += [(5, k, float(k // 30 * 500), 0.0, 1.0, float(k)) for k in range(60)]  # two places
    m = spark.createDataFrame(rows, "pair_id bigint, match_id bigint, source_x double, source_y double, target_x double, target_y double")
    plans, write = [], features.materialize
    monkeypatch.setattr(features, "materialize", lambda df, name: (plans.append(plan(df, "simple")), write(df, name))[1])
    got = sorted((r["pair_id"], r["match_id"], r["rank"], r["o_match_id"], r["o_target_x"]) for r in features.nearest(m, 5).collect())
    want = []
    for p, i, x, y, *_ in rows:
        near = sorted(((x - r[2]) ** 2 + (y - r[3]) ** 2, r[1], r[4]) for r in rows if r[0] == p and r[1] != i)[:5]
        want += [(p, i, k + 1, j, t) for k, (_, j, t) in enumerate(near)]
    assert got == sorted(want)
    assert len(plans) >= 2 and not any("Window" in text for text in plans)


def test_a_sampled_point_is_shuffled_once(spark):
    from tiegrid.operators import raster

    value = lambda x, y: (x * 7 + y * 13) % 11 / 4
    pixels = [(1, x, y, value(x, y)) for x in range(5) for y in range(4) if (x, y) != (2, 2)]
    mean = sum(p[3] for p in pixels) / len(pixels)
    places = [(x / 3 - 1, y / 3 - 1) for x in range(20) for y in range(17)]
    points = spark.createDataFrame([(k, 1, *p) for k, p in enumerate(places)], "k bigint, image_id bigint, px double, py double")
    df = raster.sample_raster(points, spark.createDataFrame(pixels, "image_id bigint, x bigint, y bigint, v double"), True)
    got = {r["k"]: r["value"] for r in df.collect()}
    for k, (px, py) in enumerate(places):
        qx, qy = min(max(px, 0), 4), min(max(py, 0), 3)
        x, y, want = int(qx), int(qy), 0.0
        for dx, dy in ((0, 0), (0, 1), (1, 0), (1, 1)):
            at = (min(x + dx, 4), min(y + dy, 3))
            want += (qx - x if dx else 1 - qx + x) * (qy - y if dy else 1 - qy + y) * (mean if at == (2, 2) else value(*at))
        assert got[k] == pytest.approx(want)
    tail = plan(df, "simple")
    assert tail.index("Join") < tail.index("Exchange") and "Generate" not in tail[: tail.index("Exchange")]


def test_backfill_reads_its_tables_once(spark):
    df = __spark_entry__.queries()["backfill_features"](spark, "/root/testdata/sf0.001")
    assert plan(df, "simple").count("lineitem.parquet") == 0
    filled = {r["filled_by"]: r["count"] for r in df.groupBy("filled_by").count().collect()}
    assert sum(filled.values()) == view(spark, "/root/testdata/sf0.001", "v_matches").count() and filled[None] > 0 and filled["exact"] > 0


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(shuffled_rows(children.apply(k)) for k in range(children.size()))


def displacements(spark, monkeypatch, multimodal):
    """The table of displacements of an image, and the rows of the result, of a target with a hole and an unknown value."""
    import numpy as np

    from tiegrid.operators import patches

    seen = []
    monkeypatch.setattr(patches, "materialize", lambda df, name: seen.append(df) or df)
    v = np.random.default_rng(4).normal(size=(64, 64))
    rows = [(1, x, y, float(v[y, x])) for y in range(64) for x in range(64)]
    names = "image_id bigint, x bigint, y bigint, v double"
    source = spark.createDataFrame(rows, names)
    target = spark.createDataFrame([(1, x + 3, y - 2, None if (x, y) == (44, 47) else 2 * w) for _, x, y, w in rows if (x, y) != (10, 15)], names)
    k = spark.createDataFrame([(1, 64 * x + y, x, y) for x in (15, 31, 47) for y in (15, 31, 47)], "image_id bigint, kp_id bigint, kx bigint, ky bigint")
    found = patches.search_displacement(source, target, k, 4, 4, multimodal=multimodal)
    return seen[0], {r["kp_id"]: r for r in found.collect()}


def test_displacements_shuffle_pixels_not_pairs(spark, monkeypatch):
    scored, found = displacements(spark, monkeypatch, False)
    assert len(found) == 9 and all((r["dx"], r["dy"]) == (3, -2) and r["ncc"] == pytest.approx(1) for k, r in found.items() if k != 64 * 15 + 15)
    rows = scored.groupBy("kp_id").count().collect()
    assert {r["kp_id"]: r["count"] for r in rows}[64 * 31 + 31] == 81 and {r["kp_id"]: r["count"] for r in rows}[64 * 15 + 15] < 81
    scored.collect()
    assert shuffled_rows(scored._jdf.queryExecution().executedPlan()) < 4 * 64 * 64


def test_multimodal_displacements_shuffle_pixels_not_pairs(spark, monkeypatch):
    scored, found = displacements(spark, monkeypatch, True)
    assert len(found) == 9 and all((r["dx"], r["dy"]) == (3, -2) for k, r in found.items() if k != 64 * 15 + 15)
    kept = scored.filter("kp_id = 64 * 47 + 47 AND dx = 3 AND dy = -2").first()
    assert kept["rank"] <= 5 and len(kept["a"]) == len(kept["b"]) == 81 and kept["b"].count(None) == 1
    scored.collect()
    assert shuffled_rows(scored._jdf.queryExecution().executedPlan()) < 10 * 64 * 64


def test_profiles_shuffle_lines_not_pixels(spark):
    import numpy as np

    from tiegrid.operators import raster

    v = np.random.default_rng(5).normal(size=(64, 66)).cumsum(0).cumsum(1)
    a, b = (spark.createDataFrame([(1, x, y, float(c[y, x])) for y in range(64) for x in range(64)], "image_id bigint, x bigint, y bigint, v double") for c in (v[:, 2:], v[:, :64]))
    found = raster.profile_shift(a, b, 6)
    assert {r["axis"]: r["shift"] for r in found.collect()}["x"] == 2
    assert shuffled_rows(found._jdf.queryExecution().executedPlan()) < 2 * 64 * 64


def test_replicates_are_the_references_number():
    assert "range(1000) AS g(r)" in __spark_entry__.oracle_sql()["bootstrap_ci"]


def test_drawn_means_are_rounded_once():
    import math

    import numpy as np

    from tiegrid.functions import draws

    rng = np.random.default_rng(5)
    for values in (np.round(rng.uniform(size=613) * 50) / 50, rng.normal(size=70) * 10.0 ** rng.integers(-12, 12, 70), np.zeros(4), np.array([1e-308, 1.0, -1e305]), np.array([2.5])):
        plain = [math.fsum(values[draws.drawn_places(31, len(values), r)].tolist()) / len(values) for r in range(300)]
        assert draws.drawn_means(31, values, 300) == plain


def test_neighbours_as_a_whole_and_by_cells(spark, monkeypatch):
    import random

    from tiegrid.operators import features

    draw = random.Random(3)
    rows = [(p, k, *((None,) * 2 if k % 17 == 16 else (float(draw.randrange(12)), float(draw.randrange(12)))), draw.random(), draw.random()) for p, n in ((1, 90), (2, 5), (3, 1), (4, 2)) for k in range(n)]
    m = spark.createDataFrame(rows, "pair_id bigint, match_id bigint, source_x double, source_y double, target_x double, target_y double")
    whole = sorted(tuple(r) for r in features.nearest(m, 4).collect())
    monkeypatch.setattr(features, "WHOLE", 3)
    assert sorted(tuple(r) for r in features.nearest(m, 4).collect()) == whole and len(whole) > 300


@pytest.mark.parametrize("name", ["neighborhood_consistency", "relief_strain"])
def test_neighbours_are_not_shuffled(spark, name):
    """Matches are dealt out by pair, once; beside them only a row for each pair is."""
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    text = plan(df, "simple")
    assert "FlatMapGroupsInArrow" in text and "match_id" not in "".join(x for x in text.splitlines() if "Exchange hashpartitioning" in x)


def test_the_verifier_reads_written_matches(spark):
    df = __spark_entry__.queries()["verifier"](spark, "/root/testdata/sf0.001")
    scans = plan(df, "simple")
    assert "verifier-matches" in scans and "lineitem.parquet" not in scans and "Join" not in scans
