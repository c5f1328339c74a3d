"""Queries over product catalogs, regions and footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegrid.operators import catalog
from tiegrid.plans.queries_points import matches, rounded
from tiegrid.plans.registry import query
from tiegrid.plans.views import view


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_products")


SENSOR = lambda t: (
    f"CASE WHEN regexp_matches(lower({t}), '(^|[^a-z0-9])iirs?([^a-z0-9]|$)') THEN 'IIRS' WHEN contains(lower({t}), 'ohr') THEN 'OHRC' WHEN contains(lower({t}), 'tmc') THEN 'TMC' END"
)


@query(f"SELECT id, coalesce({SENSOR('text')}, {SENSOR('path')}, 'UNKNOWN') AS sensor FROM {{v_text}}")
def infer_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_text").select("id", catalog.infer_sensor(F.col("text"), F.col("path")).alias("sensor"))


RAW = "CASE product_id % 6 WHEN 0 THEN 'lro-nac' WHEN 1 THEN 'TMC-2' WHEN 2 THEN sensor WHEN 3 THEN 'ohrc' WHEN 4 THEN 'x' ELSE 'IIRS' END"


@query(f"""WITH p AS (SELECT product_id, regexp_replace(upper({RAW}), '[^A-Z0-9]', '', 'g') AS bare FROM {{v_products}}),
    c AS (SELECT product_id, CASE WHEN starts_with(bare, 'OHRC') THEN 'OHRC' WHEN starts_with(bare, 'TMC') THEN 'TMC' WHEN starts_with(bare, 'IIRS') THEN 'IIRS' WHEN starts_with(bare, 'LRONAC') THEN 'LRO_NAC' END AS canonical FROM p)
    SELECT *, CASE canonical WHEN 'OHRC' THEN 0.25e0 WHEN 'TMC' THEN 5e0 WHEN 'IIRS' THEN 70e0 WHEN 'LRO_NAC' THEN 0.9e0 END AS nominal_gsd FROM c""")
def attach_sensor_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).selectExpr("product_id", f"{RAW} AS sensor")
    return catalog.attach_sensor_defaults(p).select("product_id", "canonical", "nominal_gsd")


@query("""SELECT product_id, round(coalesce(sun_elevation, CASE WHEN product_id % 2 = 0 THEN 30e0 END, 45e0), 4) AS sun_elevation,
    CASE WHEN sun_elevation IS NOT NULL THEN 'label' WHEN product_id % 2 = 0 THEN 'request' ELSE 'default' END AS sun_elevation_from,
    round(coalesce(incidence, CASE WHEN product_id % 3 = 0 THEN 60e0 END), 4) AS incidence, CASE WHEN incidence IS NOT NULL THEN 'label' WHEN product_id % 3 = 0 THEN 'request' ELSE 'missing' END AS incidence_from FROM {v_products}""")
def resolve_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    label = p.selectExpr("product_id", "sun_elevation", "incidence", "45e0 AS default_sun_elevation", "CAST(NULL AS DOUBLE) AS default_incidence")
    asked = p.selectExpr("product_id", "CASE WHEN product_id % 2 = 0 THEN 30e0 END AS sun_elevation", "CASE WHEN product_id % 3 = 0 THEN 60e0 END AS incidence")
    done = catalog.resolve_metadata(label, asked, ["sun_elevation", "incidence"])
    return rounded(done.select("product_id", "sun_elevation", F.col("provenance")["sun_elevation"].alias("sun_elevation_from"), "incidence", F.col("provenance")["incidence"].alias("incidence_from")))


@query("""WITH p AS (SELECT sensor, gsd AS native_gsd, 1 + product_id % 3 AS factor, gsd / (1 + product_id % 3) * CASE WHEN product_id % 9 = 0 THEN 1.2 ELSE 1.01 END AS effective_gsd FROM {v_products})
    SELECT sensor, count(*) AS products, count(*) FILTER (abs(effective_gsd - native_gsd / factor) > 0.05 * native_gsd / factor) AS failed FROM p GROUP BY sensor""")
def audit_gsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).selectExpr("sensor", "gsd AS native_gsd", "1 + product_id % 3 AS factor", "gsd / (1 + product_id % 3) * CASE WHEN product_id % 9 = 0 THEN 1.2e0 ELSE 1.01e0 END AS effective_gsd")
    return catalog.audit_gsd(p)


GSDS = "product_id % 4 AS k, CASE WHEN product_id % 3 <> 0 THEN gsd END AS gsd, CASE WHEN product_id % 4 < 2 THEN gsd * 2 END AS native_gsd, CASE WHEN product_id % 5 = 0 THEN gsd * 1.03e0 WHEN product_id % 5 = 1 THEN gsd * 1.4e0 END AS effective_gsd, CASE WHEN product_id % 7 < 3 THEN 2e0 WHEN product_id % 7 = 3 THEN 0e0 END AS resampling_factor"


@query(f"""WITH p AS (SELECT product_id, {GSDS} FROM {{v_products}}), a AS (SELECT product_id, gsd, native_gsd AS n, coalesce(effective_gsd, gsd) AS e, coalesce(resampling_factor, 1) AS f FROM p),
    b AS (SELECT product_id, gsd, e, f, coalesce(n, CASE WHEN abs(f - 1) < 1e-6 THEN e END, gsd) AS n FROM a), c AS (SELECT product_id, n, f, coalesce(e, n / greatest(f, 1e-9)) AS e, gsd FROM b)
    SELECT product_id, round(n, 6) AS native_gsd, round(e, 6) AS effective_gsd, round(coalesce(e, gsd), 6) AS gsd, CASE WHEN n IS NULL OR n <= 0 THEN 'native_gsd' WHEN e IS NULL OR e <= 0 THEN 'effective_gsd' WHEN f <= 0 THEN 'resampling_factor' WHEN abs(e - n / f) > 0.05 * n / f THEN 'inconsistent' END AS gsd_problem FROM c""")
def harmonize_gsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).selectExpr("product_id", *(x.strip() for x in GSDS.split(", ")))
    return rounded(catalog.harmonize_gsd(p).select("product_id", "native_gsd", "effective_gsd", "gsd", "gsd_problem"), 6)


RING = "array(named_struct('lon', west_lon, 'lat', south_lat), named_struct('lon', east_lon, 'lat', south_lat), named_struct('lon', east_lon, 'lat', north_lat), named_struct('lon', west_lon, 'lat', north_lat))"


@query("""WITH r AS (SELECT product_id, west_lon AS w, west_lon + ((((east_lon - west_lon + 180) % 360) + 360) % 360) - 180 AS e, CASE WHEN product_id % 4 = 0 THEN 25 ELSE 0 END AS up, south_lat AS s, north_lat AS n FROM {v_products}),
    m AS (SELECT product_id, w, e, s + up AS s, n + up AS n, (s + n) / 2 + up AS mean FROM r), p AS (SELECT *, CASE WHEN abs(mean) >= 65 OR greatest(abs(s), abs(n)) >= 80 THEN 'polar_stereographic' ELSE 'equirectangular' END AS projection FROM m)
    SELECT product_id, projection, round(CASE WHEN projection = 'equirectangular' THEN (e - w) * cos(radians(mean)) * (n - s) * pow(pi() / 180 * 1737.4, 2)
        ELSE (pow(2 * 1737.4 * tan(pi() / 4 - radians(least(abs(s), abs(n))) / 2), 2) - pow(2 * 1737.4 * tan(pi() / 4 - radians(greatest(abs(s), abs(n))) / 2), 2)) * sin(radians(e - w)) / 2 END, 3) AS km2 FROM p""")
def normalize_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).selectExpr("product_id", "west_lon", "east_lon", *(f"{c} + CASE WHEN product_id % 4 = 0 THEN 25 ELSE 0 END AS {c}" for c in ("south_lat", "north_lat")))
    p = catalog.normalize_footprints(p.withColumn("ring", F.expr(RING)))
    return rounded(p.select("product_id", "projection", (catalog.shoelace(F.col("metric")) / 1e6).alias("km2")), 3)


OV = "greatest(least(a.east_lon, b.east_lon) - greatest(a.west_lon, b.west_lon), 0e0) * greatest(least(a.north_lat, b.north_lat) - greatest(a.south_lat, b.south_lat), 0e0)"
AREA = "((a.east_lon - a.west_lon) * (a.north_lat - a.south_lat))"
TOUCH = "greatest(a.west_lon, b.west_lon) <= least(a.east_lon, b.east_lon) AND greatest(a.south_lat, b.south_lat) <= least(a.north_lat, b.north_lat)"


@query(f"""SELECT a.product_id, b.product_id AS b_product_id, round({OV} / {AREA}, 4) AS overlap FROM {{v_products}} AS a, {{v_products}} AS b
    WHERE a.sensor = 'OHRC' AND b.sensor = 'IIRS' AND {TOUCH} AND {OV} / {AREA} >= 0.5""")
def footprint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    found = catalog.footprint_join(p.filter("sensor = 'OHRC'"), p.filter("sensor = 'IIRS'"), 0.5)
    return rounded(found.select("product_id", "b_product_id", "overlap"))


#: An L, concave, that runs clockwise for odd ids: a box without the part east of its middle and north of it.
L_RING = """CASE WHEN product_id % 2 = 1 THEN reverse(l) ELSE l END"""
CORNERS = ("west_lon, south_lat", "east_lon, south_lat", "east_lon, (south_lat + north_lat) / 2", "(west_lon + east_lon) / 2, (south_lat + north_lat) / 2", "(west_lon + east_lon) / 2, north_lat", "west_lon, north_lat")
L_POINTS = "array(" + ", ".join("named_struct('lon', {}, 'lat', {})".format(*c.split(", ")) for c in CORNERS) + ")"
#: The same L as two boxes.
PARTS = """parts AS (SELECT product_id, sensor, acquired, west_lon AS w, east_lon AS e, south_lat AS s, (south_lat + north_lat) / 2 AS n FROM {v_products}
    UNION ALL SELECT product_id, sensor, acquired, west_lon, (west_lon + east_lon) / 2, (south_lat + north_lat) / 2, north_lat FROM {v_products}),
    whole AS (SELECT product_id, sum((e - w) * (n - s)) AS area, sum((e - w) * (n - s)) / 3 AS unit FROM parts GROUP BY product_id)"""
PART_OV = "greatest(least(a.e, b.e) - greatest(a.w, b.w), 0e0) * greatest(least(a.n, b.n) - greatest(a.s, b.s), 0e0)"


def l_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).withColumn("l", F.expr(L_POINTS)).withColumn("ring", F.expr(L_RING)).drop("l")


@query(f"""WITH {PARTS} SELECT a.product_id, b.product_id AS b_product_id, round(sum({PART_OV}) / any_value(area), 4) AS overlap
    FROM parts AS a JOIN whole ON whole.product_id = a.product_id, parts AS b WHERE a.sensor = 'TMC' AND b.sensor = 'IIRS' GROUP BY 1, 2 HAVING sum({PART_OV}) / any_value(area) >= 0.25""")
def polygon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = l_products(spark, sf_dir)
    found = catalog.footprint_join(p.filter("sensor = 'TMC'"), p.filter("sensor = 'IIRS'"), 0.25, digits=4)
    return found.select("product_id", "b_product_id", "overlap")


#: The mean latitude of all twelve points: two each at the foot, the middle and the top of both footprints.
MEAN_LAT = "((a.s0 * 2 + (a.s0 + a.n0) + a.n0 * 2) + (b.s0 * 2 + (b.s0 + b.n0) + b.n0 * 2)) / 12"


@query(f"""WITH {PARTS}, boxes AS (SELECT product_id, sensor, south_lat AS s0, north_lat AS n0 FROM {{v_products}}),
    o AS (SELECT a.product_id, b.product_id AS b_product_id, sum({PART_OV}) AS shared FROM parts AS a, parts AS b WHERE a.sensor = 'TMC' AND b.sensor = 'OHRC' GROUP BY 1, 2 HAVING sum({PART_OV}) > 0),
    u AS (SELECT o.*, x.area AS a1, y.area AS a2, pow(pi() / 180 * 1737.4, 2) * cos(radians({MEAN_LAT})) AS unit FROM o JOIN boxes AS a ON a.product_id = o.product_id JOIN boxes AS b ON b.product_id = b_product_id
        JOIN whole AS x ON x.product_id = o.product_id JOIN whole AS y ON y.product_id = b_product_id)
    SELECT product_id, b_product_id, round(a1 * unit, 3) AS area1, round(shared * unit, 3) AS intersection, round(100 * shared / a1, 3) AS pct1, round(shared / (a1 + a2 - shared), 4) AS iou,
        'equirectangular' AS projection, CASE WHEN b_product_id % 4 = 0 THEN 'approximate' ELSE 'polygon_exact' END AS confidence FROM u""")
def polygon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = l_products(spark, sf_dir).withColumn("confidence", F.expr("CASE WHEN product_id % 4 = 0 AND sensor = 'OHRC' THEN 'approximate' END"))
    pairs = catalog.overlapping(p.filter("sensor = 'TMC'"), p.filter("sensor = 'OHRC'"), "product_id", "product_id")
    done = catalog.footprint_overlap(pairs).filter("intersection > 1e-9")
    digits = {"area1": 3, "intersection": 3, "pct1": 3, "iou": 4}
    return done.select("product_id", "b_product_id", *((F.round(c, d) + 0.0).alias(c) for c, d in digits.items()), "projection", "confidence")


@query(f"""WITH {PARTS}, r AS (SELECT a.product_id, a.sensor, b.product_id AS other, b.sensor AS kind, sum({PART_OV}) / any_value(area) AS share FROM parts AS a JOIN whole ON whole.product_id = a.product_id, parts AS b
        WHERE a.sensor = 'OHRC' AND b.sensor IN ('TMC', 'IIRS') GROUP BY 1, 2, 3, 4 HAVING sum({PART_OV}) / any_value(area) >= 0.3),
    c AS (SELECT x.product_id AS o, x.other AS t, y.other AS i, x.share AS ot, y.share AS oi FROM r AS x JOIN r AS y ON x.product_id = y.product_id WHERE x.kind = 'TMC' AND y.kind = 'IIRS'),
    f AS (SELECT o, t, i, any_value(ot) AS ot, any_value(oi) AS oi, sum(greatest(least(a.e, b.e, d.e) - greatest(a.w, b.w, d.w), 0e0) * greatest(least(a.n, b.n, d.n) - greatest(a.s, b.s, d.s), 0e0)) / any_value(area) AS fraction
        FROM c JOIN whole ON whole.product_id = o JOIN parts AS a ON a.product_id = o JOIN parts AS b ON b.product_id = t JOIN parts AS d ON d.product_id = i GROUP BY o, t, i)
    SELECT o AS ohrc_id, t AS tmc_id, i AS iirs_id, round(fraction, 4) AS fraction, round(ot * 100, 3) AS pct_ot, round(oi * 100, 3) AS pct_oi FROM f WHERE fraction >= 0.3""")
def polygon_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build_triplets(l_products(spark, sf_dir), 0.3, digits=4)


UNIT = "(pow(pi() / 180 * 1737.4, 2) * cos(radians((a.south_lat + a.north_lat + b.south_lat + b.north_lat) / 4)))"


@query(f"""SELECT a.product_id, b.product_id AS b_product_id, round({AREA} * {UNIT}, 3) AS area1, round({OV} * {UNIT}, 3) AS intersection,
    round({OV} / {AREA} * 100, 3) AS pct1, round({OV} / ({AREA} + (b.east_lon - b.west_lon) * (b.north_lat - b.south_lat) - {OV}), 4) AS iou
    FROM {{v_products}} AS a, {{v_products}} AS b WHERE a.sensor = 'TMC' AND b.sensor = 'OHRC' AND {TOUCH}""")
def footprint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    pairs = catalog.overlapping(p.filter("sensor = 'TMC'"), p.filter("sensor = 'OHRC'"), "product_id", "product_id")
    done = catalog.footprint_overlap(pairs)
    digits = {"area1": 3, "intersection": 3, "pct1": 3, "iou": 4}
    return done.select("product_id", "b_product_id", *((F.round(c, d) + 0.0).alias(c) for c, d in digits.items()))


TRIPLETS = f"""o AS (SELECT * FROM {{v_products}} WHERE sensor = 'OHRC'),
    ot AS (SELECT a.*, b.product_id AS tmc_id, b.acquired AS ta, {OV} / {AREA} AS ot, greatest(a.west_lon, b.west_lon) AS w2, least(a.east_lon, b.east_lon) AS e2, greatest(a.south_lat, b.south_lat) AS s2, least(a.north_lat, b.north_lat) AS n2
        FROM o AS a, {{v_products}} AS b WHERE b.sensor = 'TMC' AND {TOUCH} AND {OV} / {AREA} >= 0.5),
    oi AS (SELECT a.product_id, b.product_id AS iirs_id, b.acquired AS ia, {OV} / {AREA} AS oi, b.west_lon AS bw, b.east_lon AS be, b.south_lat AS bs, b.north_lat AS bn
        FROM o AS a, {{v_products}} AS b WHERE b.sensor = 'IIRS' AND {TOUCH} AND {OV} / {AREA} >= 0.5),
    tr AS (SELECT ot.product_id AS ohrc_id, tmc_id, iirs_id, greatest(least(e2, be) - greatest(w2, bw), 0e0) * greatest(least(n2, bn) - greatest(s2, bs), 0e0) / ((east_lon - west_lon) * (north_lat - south_lat)) AS fraction, ot, oi
        FROM ot JOIN oi ON ot.product_id = oi.product_id WHERE coalesce(abs(epoch(acquired) - epoch(ta)) / 86400 <= 300, true) AND coalesce(abs(epoch(acquired) - epoch(ia)) / 86400 <= 300, true) AND coalesce(abs(epoch(ta) - epoch(ia)) / 86400 <= 300, true))"""


@query(f"WITH {TRIPLETS} SELECT ohrc_id, tmc_id, iirs_id, round(fraction, 4) AS fraction, round(ot * 100, 3) AS pct_ot, round(oi * 100, 3) AS pct_oi FROM tr WHERE fraction >= 0.5")
def build_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build_triplets(products(spark, sf_dir), 0.5, 0.0, 300.0, digits=4)


@query(f"""WITH {TRIPLETS}, t AS (SELECT * FROM tr WHERE fraction >= 0.5), u AS (SELECT max(v) AS used FROM t, (VALUES (1.01e0), (0.75e0), (0.70e0), (0.65e0), (0.60e0), (0.50e0)) AS x(v) WHERE fraction >= v)
    SELECT ohrc_id, tmc_id, iirs_id, used FROM t, u WHERE fraction >= used""")
def adaptive_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # More than a whole footprint can't be shared, so the request falls back.
    return catalog.adaptive_triplets(products(spark, sf_dir), 1.01, 0.0, 300.0).select("ohrc_id", "tmc_id", "iirs_id", "used")


@query(f"""WITH p AS (SELECT a.product_id AS target_id, b.product_id, {OV} / {AREA} AS overlap, abs(a.incidence - b.incidence) AS gap FROM {{v_products}} AS a, {{v_products}} AS b WHERE a.sensor = 'TMC' AND b.sensor = 'IIRS' AND {TOUCH}),
    s AS (SELECT *, coalesce(0.8 * overlap + 0.2 * (1 - gap / 90), overlap) AS score FROM p WHERE overlap >= 0.20)
    SELECT target_id, product_id, round(overlap, 4) AS overlap, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, overlap DESC, gap ASC NULLS LAST, product_id) AS INTEGER) AS rank FROM s""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    return rounded(catalog.rank_candidates(p.filter("sensor = 'TMC'"), p.filter("sensor = 'IIRS'")))


@query("""WITH d AS (SELECT *, CASE WHEN id % 2 = 0 THEN 0.5e0 END AS rx, 0.25e0 * (id - 1) AS ry FROM {v_dem_bounds}),
    m AS (SELECT r.id, d.id AS dem_id, r.west_lon - d.west_lon AS w, d.east_lon - r.east_lon AS e, r.south_lat - d.south_lat AS s, d.north_lat - r.north_lat AS n, rx, CASE WHEN ry > 0 THEN ry END AS ry FROM {v_regions} AS r, d),
    b AS (SELECT * FROM m WHERE least(w, e, s, n) >= -1e-9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY least(w, e, s, n) DESC, dem_id) = 1)
    SELECT r.id, dem_id IS NOT NULL AS contained, dem_id, round(least(w, e, s, n), 4) AS margin_deg, round(w / rx, 4) AS margin_west, round(e / rx, 4) AS margin_east, round(s / ry, 4) AS margin_south, round(n / ry, 4) AS margin_north
    FROM {v_regions} AS r LEFT JOIN b ON r.id = b.id""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    dems = view(spark, sf_dir, "v_dem_bounds").selectExpr("*", "CASE WHEN id % 2 = 0 THEN 0.5e0 END AS res_x_deg", "0.25e0 * (id - 1) AS res_y_deg")
    return rounded(catalog.coverage_check(view(spark, sf_dir, "v_regions"), dems))


@query("""SELECT product_id, sensor, round(coalesce(CASE WHEN product_id % 2 = 0 THEN sun_elevation END, CASE WHEN product_id % 3 <> 0 THEN incidence END), 4) AS sun_elevation,
    round(west_lon, 4) AS west_lon FROM {v_products} WHERE product_id % 2 = 0 OR product_id % 3 <> 0""")
def merge_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    first = p.filter("product_id % 2 = 0").select("product_id", "sensor", "sun_elevation", "west_lon")
    second = p.filter("product_id % 3 <> 0").select("product_id", F.col("sensor"), F.col("incidence").alias("sun_elevation"), "west_lon")
    return rounded(catalog.merge_catalog([first, second], "product_id", ["sun_elevation"], ["west_lon"]))


@query("""SELECT product_id, CASE WHEN product_id % 2 = 0 AND product_id % 4 <> 0 THEN sensor WHEN product_id % 3 = 0 THEN concat('r', CAST(product_id % 5 AS VARCHAR)) END AS region_id,
    CASE WHEN product_id % 2 <> 0 THEN 'added' WHEN product_id % 4 = 0 AND product_id % 3 = 0 THEN 'upgraded' ELSE 'kept' END AS action FROM {v_products} WHERE product_id % 2 = 0 OR product_id % 3 = 0""")
def upsert_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    old = p.filter("product_id % 2 = 0").selectExpr("product_id", "CASE WHEN product_id % 4 <> 0 THEN sensor END AS region_id")
    new = p.filter("product_id % 3 = 0").selectExpr("product_id", "concat('r', CAST(product_id % 5 AS STRING)) AS region_id")
    return catalog.upsert_manifest(old, new, "product_id")


@query("SELECT id % 500 AS k, min_by(path, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END || path) AS path FROM {v_text} GROUP BY 1")
def union_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "v_text").selectExpr("id % 500 AS k", "path", "id % 2 AS o")
    return catalog.union_catalogs([t.filter("o = 0").drop("o"), t.filter("o = 1").drop("o")], "k").select("k", "path")


@query("""WITH s AS (SELECT product_id, sun_azimuth AS a, least(greatest(coalesce(sun_elevation, 90 - incidence, 45e0), 5e0), 85e0) AS e FROM {v_products}),
    g AS (SELECT x.product_id AS pair_id, x.e AS e1, y.e AS e2, abs(x.a - y.a) % 360 AS d FROM s AS x JOIN s AS y ON y.product_id = x.product_id + 1)
    SELECT pair_id, round(CASE WHEN d IS NOT NULL THEN least(d, 360 - d) END, 4) AS azimuth_gap, round(e1, 4) AS elevation_1, round(e2, 4) AS elevation_2,
        CASE WHEN d IS NULL THEN 'unknown' WHEN least(d, 360 - d) < 15 THEN 'small' WHEN least(d, 360 - d) < 45 THEN 'medium' ELSE 'large' END AS bucket FROM g""")
def illumination_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    return rounded(catalog.illumination_gap(p.selectExpr("product_id AS pair_id", "product_id AS product_1", "product_id + 1 AS product_2"), p))


@query("""WITH i AS (SELECT product_id AS image_id, CAST(200 + product_id % 700 AS INTEGER) AS width, CAST(150 + product_id * 7 % 900 AS INTEGER) AS height FROM {v_products})
    SELECT image_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(c * 192 AS INTEGER) AS x0, CAST(r * 192 AS INTEGER) AS y0, CAST(least(c * 192 + 256, width) AS INTEGER) AS x1, CAST(least(r * 192 + 256, height) AS INTEGER) AS y1
    FROM i, range(6) AS a(r), range(6) AS b(c) WHERE r <= greatest(0, ceil((height - 256) / 192e0)) AND c <= greatest(0, ceil((width - 256) / 192e0))""")
def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = products(spark, sf_dir).selectExpr("product_id AS image_id", "CAST(200 + product_id % 700 AS INT) AS width", "CAST(150 + product_id * 7 % 900 AS INT) AS height")
    return catalog.tile_windows(i, 256, 64)


@query("""SELECT m.pair_id, match_id, round(west_lon + source_x / 512 * (east_lon - west_lon), 10) AS lon, round(north_lat - source_y / 512 * (north_lat - south_lat), 10) AS lat,
    round((east_lon - west_lon) * pi() / 180 * 1737400 * cos(radians((south_lat + north_lat) / 2)) / 512, 3) AS metres_per_px FROM {v_matches} AS m LEFT JOIN {v_regions} AS r ON m.pair_id % 30 = r.id""")
def georeference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).selectExpr("*", "pair_id % 30 AS region_id")
    done = catalog.georeference(m, view(spark, sf_dir, "v_regions"), 512.0, 512.0)
    digits = {"lon": 10, "lat": 10, "metres_per_px": 3}
    return done.select("pair_id", "match_id", *((F.round(c, d) + 0.0).alias(c) for c, d in digits.items()))


@query("""WITH e AS (SELECT product_id AS slot, product_id % 50 AS manifest, CASE product_id % 3 WHEN 0 THEN 'pending' ELSE 'validated' END AS status, CASE WHEN product_id % 3 <> 0 OR product_id % 4 = 0 THEN product_id % 50 + CASE WHEN product_id % 10 = 0 THEN 1e0 ELSE 0e0 END END AS rmse FROM {v_products}),
    m AS (SELECT DISTINCT product_id % 50 AS manifest, CAST(product_id % 50 AS DOUBLE) AS r FROM {v_products} WHERE product_id % 50 < 40)
    SELECT slot, array_to_string(list_filter([CASE WHEN status = 'validated' AND r IS NULL THEN 'manifest_missing' END, CASE WHEN status = 'pending' AND rmse IS NOT NULL THEN 'pending_with_numbers' END, CASE WHEN abs(rmse - r) > 1e-9 THEN 'fit_rmse_differs' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM e LEFT JOIN m ON e.manifest = m.manifest""")
def validate_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    e = p.selectExpr("product_id AS slot", "product_id % 50 AS manifest", "CASE product_id % 3 WHEN 0 THEN 'pending' ELSE 'validated' END AS status",
                     "CASE WHEN product_id % 3 <> 0 OR product_id % 4 = 0 THEN product_id % 50 + CASE WHEN product_id % 10 = 0 THEN 1e0 ELSE 0e0 END END AS fit_rmse", "CAST(NULL AS BIGINT) AS inliers")
    m = p.filter("product_id % 50 < 40").selectExpr("product_id % 50 AS manifest", "CAST(product_id % 50 AS DOUBLE) AS fit_rmse", "CAST(1 AS BIGINT) AS inliers").distinct()
    return catalog.validate_registry(e, m).select("slot", F.array_join("problems", ",").alias("problems"))
