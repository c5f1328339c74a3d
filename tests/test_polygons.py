"""Overlaps of rings of any sense, concave ones included, against areas by slabs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiegrid.operators import catalog

PRODUCT = "product_id bigint, sensor string, west_lon double, east_lon double, south_lat double, north_lat double, acquired timestamp, ring array<struct<lon:double,lat:double>>, confidence string"


def spans(ring, x):
    """Where a vertical line is inside a ring, by even and odd crossings."""
    ys = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if min(x0, x1) < x < max(x0, x1):
            ys.append(y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    ys.sort()
    return list(zip(ys[::2], ys[1::2], strict=True))


def slab_area(*rings):
    """The area that rings share: between neighbouring corners and crossings lengths change evenly."""
    cuts = {x for r in rings for x, _ in r}
    edges = [e for r in rings for e in zip(r, r[1:] + r[:1], strict=True)]
    for (ax, ay), (bx, by) in edges:
        for (cx, cy), (dx, dy) in edges:
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if abs(det) > 1e-15:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
                if 0 <= t <= 1:
                    cuts.add(ax + t * (bx - ax))
    xs, total = sorted(cuts), 0.0
    for x0, x1 in zip(xs, xs[1:], strict=False):
        if x1 - x0 < 1e-12:
            continue
        inside = [(-math.inf, math.inf)]
        for r in rings:
            inside = [(max(a, c), min(b, d)) for a, b in inside for c, d in spans(r, (x0 + x1) / 2) if max(a, c) < min(b, d)]
        total += (x1 - x0) * sum(b - a for a, b in inside)
    return total


def star(pick, x, y, size):
    """A simple ring around a centre, concave in places, of either sense; some are closed by their first point again."""
    n = pick.randrange(3, 9)
    turn = sorted(pick.uniform(0, 2 * math.pi) for _ in range(n))
    if max((b - a) % (2 * math.pi) for a, b in zip(turn, turn[1:] + turn[:1], strict=True)) > 3:  # the centre has to be inside
        turn = [2 * math.pi * k / n for k in range(n)]
    away = [size * pick.uniform(0.3, 1) for _ in turn]
    ring = [(x + r * math.cos(a), y + r * math.sin(a)) for r, a in zip(away, turn, strict=True)]
    return ring[::-1] if pick.random() < 0.5 else ring


def product(i, sensor, ring, closed=False, confidence=None):
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    points = [{"lon": x, "lat": y} for x, y in ring + ring[:closed]]
    return (i, sensor, min(xs), max(xs), min(ys), max(ys), None, points, confidence)


def test_join_of_any_rings(spark):
    pick = random.Random(4)
    a = {k: star(pick, pick.uniform(0, 12), pick.uniform(-6, 6), 4) for k in range(40)}
    b = {k: star(pick, pick.uniform(0, 12), pick.uniform(-6, 6), 5) for k in range(40)}
    one, two = (spark.createDataFrame([product(k, "", r, k % 3 == 0) for k, r in rings.items()], PRODUCT) for rings in (a, b))
    found = {(r["product_id"], r["b_product_id"]): r["overlap"] for r in catalog.footprint_join(one, two, 0.05).collect()}
    want = {(i, j): slab_area(p, q) / slab_area(p) for i, p in a.items() for j, q in b.items()}
    assert {k for k, v in want.items() if v >= 0.0501} <= found.keys() <= {k for k, v in want.items() if v >= 0.0499}
    assert len(found) > 100 and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in found)


def test_join_of_odd_rings(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [product(1, "", square), product(2, "", square[::-1]), product(3, "", [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (*product(4, "", square)[:7], None, None), (5, "", None, None, None, None, None, None, None)]
    rows.append((*product(6, "", square)[:7], [{"lon": 0.0, "lat": 0.0}, None, {"lon": None, "lat": 1.0}, {"lon": 2.0, "lat": 0.0}, {"lon": 2.0, "lat": 2.0}, {"lon": 0.0, "lat": 2.0}], None))
    p = spark.createDataFrame(rows, PRODUCT)
    found = {(r["product_id"], r["b_product_id"]): r["overlap"] for r in catalog.footprint_join(p, p, 0.0).collect()}
    whole = {1, 2, 4, 6}  # either sense, a box for a missing ring, missing points left out
    assert {k for k, v in found.items() if v == pytest.approx(1)} == {(i, j) for i in whole for j in whole}
    assert all(v == 0 for (i, j), v in found.items() if 3 in (i, j)) and not any(5 in k for k in found)


def plane(ring, lon, lat, polar):
    """Kilometres about a mean point."""
    out = []
    for x, y in ring:
        east = math.radians((x - lon + 180) % 360 - 180)
        if polar:
            side = -1 if lat < 0 else 1
            rho = 2 * 1737.4 * math.tan(math.pi / 4 - math.radians(side * y) / 2)
            out.append((rho * math.sin(east), -side * rho * math.cos(east)))
        else:
            out.append((1737.4 * east * math.cos(math.radians(lat)), 1737.4 * math.radians(y)))
    return out


@pytest.mark.parametrize("lat", [10.0, -72.0, 84.0])
@pytest.mark.parametrize("lon", [100.0, 179.5])
def test_overlap_in_the_plane_of_a_pair(spark, lat, lon):
    pick = random.Random(int(lat + lon))
    wrap = lambda ring: [((x + 180) % 360 - 180, y) for x, y in ring]
    pairs = [(star(pick, lon, lat, 3), star(pick, lon + 1, lat - 1, 3)) for _ in range(10)]
    if lon > 179:
        pairs = [(wrap(a), wrap(b)) for a, b in pairs if abs(np.mean([p[0] for p in wrap(a) + wrap(b)])) > 90] or pairs[:1]
    rows = [(k, [{"lon": x, "lat": y} for x, y in a], [{"lon": x, "lat": y} for x, y in b], *(None,) * 8) for k, (a, b) in enumerate(pairs)]
    box = ", ".join(f"{p}{c} double" for p in ("", "b_") for c in catalog.BOUNDS)
    ring = "array<struct<lon:double,lat:double>>"
    found = {r["id"]: r for r in catalog.footprint_overlap(spark.createDataFrame(rows, f"id bigint, ring {ring}, b_ring {ring}, {box}")).collect()}
    for k, (a, b) in enumerate(pairs):
        every = a + b
        mean = np.mean([p[0] for p in every]), np.mean([p[1] for p in every])
        polar = abs(mean[1]) >= 65 or max(abs(p[1]) for p in every) >= 80
        p, q = plane(a, *mean, polar), plane(b, *mean, polar)
        r, both = found[k], slab_area(p, q)
        assert r["projection"] == ("equirectangular" if not polar else "south_polar_stereographic" if mean[1] < 0 else "north_polar_stereographic")
        assert r["area1"] == pytest.approx(slab_area(p), rel=1e-6) and r["area2"] == pytest.approx(slab_area(q), rel=1e-6) and r["intersection"] == pytest.approx(both, rel=1e-6, abs=1e-6)
        assert r["pct1"] == pytest.approx(100 * both / slab_area(p), rel=1e-6, abs=1e-6) and r["iou"] == pytest.approx(both / (slab_area(p) + slab_area(q) - both), rel=1e-6, abs=1e-6)
        assert r["confidence"] == "polygon_exact"


def test_confidence_is_the_worse_one(spark):
    square = [{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]
    box, none = (0.0, 2.0, 0.0, 2.0), (None,) * 4
    rows = [(1, square, square, *none, *none, None, None), (2, square, None, *none, *box, None, None), (3, None, None, *box, *none, None, None), (4, square, square, *box, *box, "approximate", None), (5, square, None, *none, *box, None, "polygon_exact")]
    names = ", ".join(f"{p}{c} double" for p in ("", "b_") for c in catalog.BOUNDS)
    ring = "array<struct<lon:double,lat:double>>"
    pairs = spark.createDataFrame(rows, f"id bigint, ring {ring}, b_ring {ring}, {names}, confidence string, b_confidence string")
    by_id = {r["id"]: r for r in catalog.footprint_overlap(pairs).collect()}
    assert [by_id[k]["confidence"] for k in range(1, 6)] == ["polygon_exact", "bbox_only", "unavailable", "approximate", "polygon_exact"]
    assert by_id[3]["intersection"] == by_id[3]["area1"] == by_id[3]["pct1"] == by_id[3]["iou"] == 0 and by_id[3]["projection"] is None
    assert by_id[2]["iou"] == pytest.approx(1) and by_id[1]["pct1"] == pytest.approx(100)


def test_triplets_of_rings(spark):
    pick = random.Random(9)
    kinds = ("OHRC", "TMC", "IIRS")
    rings = {k: star(pick, pick.uniform(0, 5), pick.uniform(0, 5), (2, 4, 6)[k % 3]) for k in range(36)}
    p = spark.createDataFrame([product(k, kinds[k % 3], r) for k, r in rings.items()], PRODUCT)
    found = {(r["ohrc_id"], r["tmc_id"], r["iirs_id"]): r["fraction"] for r in catalog.build_triplets(p, 0.2).collect()}
    of = lambda k: [i for i in rings if i % 3 == k]
    share = lambda o, *others: slab_area(rings[o], *(rings[t] for t in others)) / slab_area(rings[o])
    want = {(o, t, i): share(o, t, i) for o in of(0) for t in of(1) if share(o, t) >= 0.2 for i in of(2) if share(o, i) >= 0.2}
    want = {k: v for k, v in want.items() if v >= 0.2}
    assert len(want) > 20 and found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_axis_alignment(spark):
    corners = {1: [(0, 0), (2, 0), (2, 1), (0, 1)], 2: [(1, 0), (2, 1), (1, 2), (0, 1)], 3: [(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)], 4: [(0, 0), (2, 0), (3, 1), (1, 1)], 5: [(1, 1)] * 4}
    rows = [(k, [{"lon": float(x), "lat": float(y)} for x, y in v]) for k, v in corners.items()]
    found = {r["id"]: r for r in catalog.axis_alignment(spark.createDataFrame(rows, "id bigint, ring array<struct<lon:double,lat:double>>")).collect()}
    assert [found[k]["is_axis_aligned"] for k in range(1, 6)] == [True, False, False, False, False]
    assert found[4]["lat_paired"] and not found[4]["lon_paired"] and found[4]["relative_diff"] == pytest.approx(1 / 3)
    assert found[2]["relative_diff"] == pytest.approx(0.5) and found[5]["relative_diff"] == 0


def test_margins_of_all_sides(spark):
    names = "id bigint, west_lon double, east_lon double, south_lat double, north_lat double"
    regions = spark.createDataFrame([(1, 1.0, 2.0, 1.0, 3.0), (2, 9.0, 11.0, 0.0, 1.0)], names)
    dems = spark.createDataFrame([(7, 0.0, 10.0, 0.0, 10.0, 0.5, 0.0), (8, 0.5, 3.0, 0.5, 3.5, 0.1, 0.1)], names + ", res_x_deg double, res_y_deg double")
    covered = catalog.coverage_check(regions, dems)
    r = {x["id"]: x for x in covered.collect()}
    assert r[1]["dem_id"] == 7 and (r[1]["margin_west"], r[1]["margin_east"], r[1]["margin_south"], r[1]["margin_north"]) == (2, 16, None, None) and r[1]["margin_deg"] == 1
    assert not r[2]["contained"] and r[2]["dem_id"] is None and [x["id"] for x in catalog.missing_regions(covered).collect()] == [2]
    assert catalog.coverage_check(regions, dems.drop("res_x_deg", "res_y_deg")).filter(F.col("margin_west").isNotNull()).isEmpty()


def test_products_of_one_footprint_meet_once(spark, monkeypatch):
    import datetime

    monkeypatch.setattr(catalog, "HELD", 4)
    day = lambda k: None if k % 6 == 5 else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=k % 5)
    where = {"OHRC": [(0, 1, 0, 1), (5, 6, 0, 1)], "TMC": [(-1, 2, -1, 2), (0, 1, 0, 0.6), (5, 6, 0, 1)], "IIRS": [(-3, 0.75, -3, 3), (4, 8, -2, 4)]}
    rows, k = [], 0
    for sensor, boxes in where.items():
        for box in boxes:
            for _ in range(7):
                k += 1
                rows.append((k, sensor, *map(float, box), day(k)))
    p = spark.createDataFrame(rows, "product_id bigint, sensor string, west_lon double, east_lon double, south_lat double, north_lat double, acquired timestamp")
    assert catalog.by_footprint(p.drop("sensor"), list(catalog.BOUNDS)).count() == 2 * 6 + 2  # boxes that two sensors share hold 14 products

    def shared(*boxes):
        return max(0.0, min(b[1] for b in boxes) - max(b[0] for b in boxes)) * max(0.0, min(b[3] for b in boxes) - max(b[2] for b in boxes))

    of = lambda s: [(r[0], r[2:6], r[6]) for r in rows if r[1] == s]
    near = lambda a, b, loose: loose if a is None or b is None else abs((a - b).days) <= 2
    for strict, least in ((False, 0.5), (True, 0.7)):
        want = {
            (o, t, i): shared(bo, bt, bi) / shared(bo) for o, bo, do in of("OHRC") for t, bt, dt in of("TMC") for i, bi, di in of("IIRS")
            if shared(bo, bt, bi) / shared(bo) >= least and near(do, dt, not strict) and near(do, di, not strict) and near(dt, di, True)
        }
        got = catalog.build_triplets(p, least, 0.0, 2.0, strict).collect()
        assert {(r["ohrc_id"], r["tmc_id"], r["iirs_id"]): r["fraction"] for r in got} == want and len(got) == len(want) > 50
    used = catalog.adaptive_triplets(p, 1.01, 0.0, 2.0).collect()
    every = catalog.adaptive_containment(catalog.build_triplets(p, 0.5, 0.0, 2.0), 1.01).collect()
    assert sorted((r["ohrc_id"], r["tmc_id"], r["iirs_id"], r["used"]) for r in used) == sorted((r["ohrc_id"], r["tmc_id"], r["iirs_id"], r["used"]) for r in every) and used
    found = catalog.footprint_join(p.filter("sensor = 'OHRC'"), p.filter("sensor = 'TMC'"), 0.6)
    want = sorted((o, t, shared(bo, bt) / shared(bo)) for o, bo, _ in of("OHRC") for t, bt, _ in of("TMC") if shared(bo, bt) / shared(bo) >= 0.6)
    assert sorted((r["product_id"], r["b_product_id"], r["overlap"]) for r in found.collect()) == want
    assert found.columns == [*p.columns, *("b_" + c for c in p.columns), "overlap"]
