"""Queries over pixel, elevation and band tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegrid.operators import raster
from tiegrid.plans.queries_points import rounded
from tiegrid.plans.registry import query
from tiegrid.plans.views import view


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_pixels")


def pixels_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_pixels_b")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("v", F.col("v") * 1000)


def stencil(source: str, mirror: bool = False, name: str = "") -> str:
    """Neighbours (``st``) and gradients (``gr``) of pixels; edges stand in for what lies beyond, or the pixels before them."""
    row, column = "(PARTITION BY image_id, y ORDER BY x)", "(PARTITION BY image_id, x ORDER BY y)"

    def step(c: str, window: str, before: bool) -> str:
        near, other = ("lag", "lead") if before else ("lead", "lag")
        return f"coalesce({near}({c}) OVER {window}, {f'{other}({c}) OVER {window}, ' if mirror else ''}{c})"

    return f"""{name}side AS (SELECT *, {step('v', row, True)} AS w, {step('v', row, False)} AS e FROM {source}),
    {name}st AS (SELECT *, {', '.join(f"{step(c, column, n[0] == 'n')} AS {n}" for n, c in (('n', 'v'), ('s', 'v'), ('nw', 'w'), ('ne', 'e'), ('sw', 'w'), ('se', 'e')))} FROM {name}side),
    {name}gr AS (SELECT *, ne + 2*e + se - nw - 2*w - sw AS sx, sw + 2*s + se - nw - 2*n - ne AS sy, n + s + w + e - 4*v AS lap FROM {name}st)"""


DEM = "(SELECT image_id, x, y, v * 1000 AS v FROM {v_pixels}) AS d"


@query("SELECT image_id, x - 10 AS x, y - 5 AS y, round(v, 6) AS v FROM {v_pixels} WHERE x >= 10 AND x < 20 AND y >= 5 AND y < 25")
def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "embeddings").selectExpr("CAST(floor(vec_id / 64e0) AS BIGINT) AS image_id", "vec_id % 64 AS y", "embedding")
    full = rows.join(rows.groupBy("image_id").count().filter("count = 64").select("image_id"), "image_id", "left_semi")
    return rounded(raster.crop(raster.to_pixels(full, "embedding"), 10, 20, 5, 25), 6)


@query("""SELECT CAST(image_id AS BIGINT) AS image_id, r AS region_id, x - (8 + 4 * r) AS x, y - 10 AS y, round(v, 6) AS v FROM {v_pixels}, range(0, 3) AS g(r) WHERE x >= 8 + 4 * r AND x < 24 + 4 * r AND y >= 10 AND y < 30""")
def crop_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of 16 x 20 pixels, and one that no image holds."""
    images = pixels(spark, sf_dir).select("image_id").distinct().selectExpr("image_id", "100e0 AS west_lon", "132e0 AS east_lon", "-10e0 AS south_lat", "22e0 AS north_lat", "64 AS width", "64 AS height")
    regions = spark.range(4).selectExpr("id", "104e0 + 2 * id + CASE WHEN id = 3 THEN 20 ELSE 0 END AS west_lon", "112e0 + 2 * id + CASE WHEN id = 3 THEN 20 ELSE 0 END AS east_lon", "7e0 AS south_lat", "17e0 AS north_lat")
    return rounded(raster.crop_bounds(pixels(spark, sf_dir), images, regions), 6)


@query(f"WITH {stencil('{v_pixels}')} SELECT image_id, x, y, round(sx, 5) AS sobel_x, round(sy, 5) AS sobel_y, round(lap, 5) AS laplacian FROM gr")
def stencil_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.gradients(pixels(spark, sf_dir)).select("image_id", "x", "y", "sobel_x", "sobel_y", "laplacian"), 5)


@query(f"""WITH {stencil('{v_pixels}', True)} SELECT image_id, round(var_pop(lap), 5) AS laplacian_variance, round(avg(sx*sx + sy*sy), 5) AS tenengrad, round(avg(CASE WHEN v < -0.1 THEN 1e0 ELSE 0 END), 5) AS dark,
    round(avg(CASE WHEN v > 0.2 THEN 1e0 ELSE 0 END), 5) AS saturated, round(min(v), 5) AS min, round(max(v), 5) AS max, round(avg(v), 5) AS mean, round(quantile_cont(v, 0.5), 5) AS median, 1e0 AS finite, true AS ok FROM gr GROUP BY image_id""")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.image_stats(pixels(spark, sf_dir), -0.1, 0.2), 5)


BOTH = "ab AS (SELECT p.image_id, p.v AS a, q.v AS b FROM {v_pixels} AS p JOIN {v_pixels_b} AS q ON p.image_id = q.image_id AND p.x = q.x AND p.y = q.y)"


@query(f"""WITH {BOTH}, s AS (SELECT image_id, count(*) AS n, avg((a-b)*(a-b)) AS mse, max(a) - min(a) AS r, avg(abs(a-b)) AS d, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM ab GROUP BY image_id),
    o AS (SELECT ab.image_id, abs((a - la) / (ha - la) * 255 - (b - lb) / (hb - lb) * 255) AS o FROM ab JOIN s ON ab.image_id = s.image_id), m AS (SELECT image_id, avg(o) AS o, avg(CASE WHEN o < 8 THEN 1e0 ELSE 0 END) AS k FROM o GROUP BY image_id)
    SELECT s.image_id, n, round(mse, 5) AS mse, round(10 * log10(r*r / mse), 5) AS psnr, round(d, 5) AS mean_difference, round(o, 5) AS mean_abs_diff, round(k, 5) AS near_black FROM s JOIN m ON s.image_id = m.image_id""")
def overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.overlap_stats(pixels(spark, sf_dir), pixels_b(spark, sf_dir)), 5)


@query(f"""WITH {BOTH}, l AS (SELECT image_id, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, count(*) AS n FROM ab GROUP BY image_id),
    j AS (SELECT ab.image_id, n, least(31, floor((a - la) / ((ha - la) / 32))) AS i, least(31, floor((b - lb) / ((hb - lb) / 32))) AS j, count(*) AS c FROM ab JOIN l ON ab.image_id = l.image_id GROUP BY ALL),
    h AS (SELECT image_id, n, -sum(c / CAST(n AS DOUBLE) * log2(c / CAST(n AS DOUBLE))) AS hab FROM j GROUP BY image_id, n),
    ha AS (SELECT image_id, -sum(c / n * log2(c / n)) AS ha FROM (SELECT image_id, CAST(n AS DOUBLE) AS n, i, sum(c) AS c FROM j GROUP BY ALL) AS q GROUP BY image_id),
    hb AS (SELECT image_id, -sum(c / n * log2(c / n)) AS hb FROM (SELECT image_id, CAST(n AS DOUBLE) AS n, j, sum(c) AS c FROM j GROUP BY ALL) AS q GROUP BY image_id)
    SELECT h.image_id, n, round(2 * (ha + hb - hab) / (ha + hb), 5) AS nmi, round((ha + hb - hab) / hab, 5) AS mi_ratio FROM h JOIN ha ON h.image_id = ha.image_id JOIN hb ON h.image_id = hb.image_id""")
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.nmi(pixels(spark, sf_dir), pixels_b(spark, sf_dir)), 5)


POINTS = "SELECT pair_id, match_id, pair_id % 5 AS image_id, source_x / 8 AS px, source_y / 8 AS py FROM {v_matches}"


@query(f"""WITH p AS ({POINTS}), q AS (SELECT *, least(greatest(px, 0e0), 63e0) AS qx, least(greatest(py, 0e0), 63e0) AS qy FROM p),
    c AS (SELECT q.*, least(floor(qx) + dx, 63) AS x, least(floor(qy) + dy, 63) AS y, CASE WHEN dx = 1 THEN qx - floor(qx) ELSE 1 - qx + floor(qx) END * CASE WHEN dy = 1 THEN qy - floor(qy) ELSE 1 - qy + floor(qy) END AS w FROM q, range(2) AS a(dx), range(2) AS b(dy))
    SELECT pair_id, match_id, round(sum(w * v), 5) AS value FROM c JOIN {{v_pixels}} AS g ON g.image_id = c.image_id AND g.x = c.x AND g.y = c.y GROUP BY pair_id, match_id""")
def sample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "v_matches").selectExpr("pair_id", "match_id", "pair_id % 5 AS image_id", "source_x / 8 AS px", "source_y / 8 AS py")
    return rounded(raster.sample_raster(points, pixels(spark, sf_dir), True).select("pair_id", "match_id", "value"), 5)


@query(f"""WITH p AS ({POINTS}) SELECT pair_id, match_id, round(v, 5) AS value FROM p JOIN {{v_pixels}} AS g ON g.image_id = p.image_id AND g.x = floor(least(greatest(px, 0e0), 63e0)) AND g.y = floor(least(greatest(py, 0e0), 63e0))""")
def sample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "v_matches").selectExpr("pair_id", "match_id", "pair_id % 5 AS image_id", "source_x / 8 AS px", "source_y / 8 AS py")
    return rounded(raster.sample_raster(points, pixels(spark, sf_dir), False).select("pair_id", "match_id", "value"), 5)


@query("""WITH e AS (SELECT image_id, quantile_cont(v, 0.01) AS l, quantile_cont(v, 0.99) AS h FROM {v_pixels} GROUP BY image_id)
    SELECT p.image_id, x, y, round(least(greatest((v - l) / (h - l), 0e0), 1e0), 5) AS v FROM {v_pixels} AS p JOIN e ON p.image_id = e.image_id""")
def stretch01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.stretch01(pixels(spark, sf_dir)), 5)


@query("""WITH q AS (SELECT image_id, x, y, CASE WHEN (x + y) % 17 = 0 THEN NULL WHEN (x + y) % 17 = 1 THEN 'nan'::DOUBLE ELSE v END AS v FROM {v_pixels}), e AS (SELECT image_id, quantile_cont(v, 0.03) FILTER (NOT isnan(v)) AS c FROM q GROUP BY image_id)
    SELECT q.image_id, x, y, v IS NULL OR isnan(v) OR v <= c OR 20 + q.image_id * 7 % 90 >= 85 AS shadow FROM q JOIN e ON q.image_id = e.image_id""")
def shadow_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = F.when((F.col("x") + F.col("y")) % 17 == 0, None).when((F.col("x") + F.col("y")) % 17 == 1, float("nan")).otherwise(F.col("v"))
    return raster.shadow_mask(pixels(spark, sf_dir).withColumn("v", holes), 0.03, geometry(spark, sf_dir)).select("image_id", "x", "y", "shadow")


@query("""WITH m AS (SELECT image_id, x, quantile_cont(v, 0.5) AS m FROM {v_pixels} GROUP BY image_id, x), g AS (SELECT image_id, quantile_cont(m, 0.5) AS g FROM m GROUP BY image_id)
    SELECT p.image_id, p.x, p.y, round(CASE WHEN m > 0 AND g <> 0 THEN v * g / greatest(m, 1e-6) ELSE v END, 4) AS v FROM {v_pixels} AS p JOIN m ON p.image_id = m.image_id AND p.x = m.x JOIN g ON p.image_id = g.image_id""")
def destripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.destripe(pixels(spark, sf_dir)))


@query("""WITH t AS (SELECT image_id, v, fx.k AS cx, fy.k AS cy, least(x + 1e0, (fx.k + 1) * 2.5) - greatest(x + 0e0, fx.k * 2.5) AS wx, least(y + 1e0, (fy.k + 1) * 2.5) - greatest(y + 0e0, fy.k * 2.5) AS wy
        FROM {v_pixels}, range(26) AS fx(k), range(26) AS fy(k) WHERE fx.k BETWEEN floor(x / 2.5) AND floor((x + 0.999) / 2.5) AND fy.k BETWEEN floor(y / 2.5) AND floor((y + 0.999) / 2.5))
    SELECT image_id, cx AS x, cy AS y, round(sum(v * wx * wy) / sum(wx * wy), 5) AS v FROM t GROUP BY image_id, cx, cy""")
def resample_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.resample_area(pixels(spark, sf_dir), 2.5), 5)


GEOMETRY = "20e0 + image_id * 7 % 90 AS incidence, CASE WHEN image_id % 5 <> 1 THEN 5e0 END AS emission, CASE WHEN image_id % 3 <> 1 THEN 30e0 + image_id % 40 END AS phase"
COSINES = f"""g AS (SELECT image_id, greatest(coalesce(cos(radians(incidence)), 1), 1e-6) AS i, greatest(coalesce(cos(radians(emission)), 1), 1e-6) AS e, coalesce(phase, 0e0) AS phase, cos(radians(coalesce(phase, 0e0))) AS c
    FROM (SELECT DISTINCT image_id, {GEOMETRY} FROM {{v_pixels}}) AS d)"""


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image_id").distinct().selectExpr("image_id", *GEOMETRY.split(", "))


@query(f"""WITH {COSINES} SELECT p.image_id, x, y, round(v / ((1 - exp(-phase / 60)) * 2 * i / (i + e) + exp(-phase / 60) * i), 5) AS v FROM {{v_pixels}} AS p JOIN g ON p.image_id = g.image_id""")
def photometric_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.photometric_correct(pixels(spark, sf_dir), geometry(spark, sf_dir), "lunar_lambert"), 5)


@query(f"""WITH {COSINES}, f AS (SELECT image_id, greatest(0.21 / 4 / pi() * i / (i + e) * ((1 + 0.9 / (1 + tan(radians(phase) / 2) / 0.07)) * (0.3 * (1 - 0.0441) / pow(1 + 0.42 * c + 0.0441, 1.5) + 0.7 * (1 - 0.0441) / pow(1 - 0.42 * c + 0.0441, 1.5)) + 1), 1e-6) AS f FROM g)
    SELECT p.image_id, x, y, round(v / f, 3) AS v FROM {{v_pixels}} AS p JOIN f ON p.image_id = f.image_id""")
def photometric_hapke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.photometric_correct(pixels(spark, sf_dir), geometry(spark, sf_dir), "hapke"), 3)


@query(f"""WITH {stencil(DEM, True)}, sl AS (SELECT *, degrees(atan(sqrt(pow(sx / 8 / 100, 2) + pow(sy / 8 / 100, 2)))) AS slope FROM gr),
    m AS (SELECT image_id, avg(slope) AS ms, max(slope) AS xs, avg(abs(2 * (nw + ne + sw + se) - 8 * v) / 1e4) AS ml, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xz, covar_pop(y, v) AS yz, var_pop(v) AS zz FROM sl GROUP BY image_id)
    SELECT image_id, round(ms, 4) AS mean_slope, round(xs, 4) AS max_slope, round(ml, 4) AS mean_laplacian, round(sqrt(zz - (xz*yy - yz*xy)/(xx*yy - xy*xy)*xz - (yz*xx - xz*xy)/(xx*yy - xy*xy)*yz), 4) AS roughness FROM m""")
def terrain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.terrain_metrics(dem(spark, sf_dir), 100.0))


@query(f"""WITH {stencil(DEM, True)}, ray AS (SELECT s.image_id, s.x, s.y, bool_or(o.v > s.v + tan(radians(40e0)) * 100 * k * sqrt(2)) AS dark
        FROM st AS s, range(1, 5) AS g(k), st AS o WHERE o.image_id = s.image_id AND o.x = s.x - k AND o.y = s.y - k GROUP BY ALL),
    lit AS (SELECT image_id, x, y, atan(sqrt(pow(sx/800, 2) + pow(sy/800, 2))) AS slope, atan2(sx/800, -sy/800) AS aspect FROM gr)
    SELECT lit.image_id, lit.x, lit.y, CASE WHEN coalesce(dark, false) THEN 0e0 ELSE round(least(greatest(sin(radians(40e0)) * cos(slope) + cos(radians(40e0)) * sin(slope) * cos(radians(450e0 - 315e0) - aspect), 0e0), 1e0), 5) END AS shade
    FROM lit LEFT JOIN ray ON ray.image_id = lit.image_id AND ray.x = lit.x AND ray.y = lit.y""")
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.hillshade(dem(spark, sf_dir), 315.0, 40.0, 100.0, shadow_px=6), 5)


@query("""WITH d AS (SELECT image_id, x, y, v * 1000 AS v FROM {v_pixels}) SELECT a.image_id, count(*) FILTER (hit) AS shadowed FROM (SELECT d.image_id, d.x, d.y, coalesce(bool_or(o.v > d.v + tan(radians(45e0)) * 100 * k), false) AS hit
        FROM d LEFT JOIN range(1, 7) AS g(k) ON true LEFT JOIN d AS o ON o.image_id = d.image_id AND o.x = d.x + k AND o.y = d.y GROUP BY ALL) AS a GROUP BY a.image_id""")
def cast_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.cast_shadow(dem(spark, sf_dir), 90.0, 45.0, 100.0, 6).groupBy("image_id").agg(F.count_if("shadow").alias("shadowed"))


STRETCHED = """z AS (SELECT p.image_id, x, y, least(greatest((v - l) / (h - l), 0e0), 1e0) AS v FROM {v_pixels} AS p JOIN (SELECT image_id, quantile_cont(v, 0.01) AS l, quantile_cont(v, 0.99) AS h FROM {v_pixels} GROUP BY image_id) AS q ON p.image_id = q.image_id)"""
BITS = lambda order: " + ".join(f"{1 << k} * ({n} >= v)::INT" for k, n in enumerate(order))


@query(f"""WITH {STRETCHED}, {stencil('z')} SELECT image_id, x, y, CAST({BITS(raster.CENSUS)} AS BIGINT) AS code FROM st""")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.census(pixels(spark, sf_dir))


@query(f"""WITH {STRETCHED}, g AS (SELECT image_id, x, y, floor((v - min(v) OVER (PARTITION BY image_id)) / (max(v) OVER (PARTITION BY image_id) - min(v) OVER (PARTITION BY image_id)) * 255) AS v FROM z), {stencil('g')}
    SELECT image_id, x, y, CAST({BITS(raster.LBP)} AS BIGINT) AS code FROM st""")
def lbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.lbp(pixels(spark, sf_dir)).drop("value")


BLEND = lambda name: f"""{name}h AS (SELECT *, sqrt(sx*sx + sy*sy) AS g FROM {name}gr), {name}w AS (SELECT image_id, avg(v) AS mv, stddev_pop(v) AS sv, avg(g) AS mg, stddev_pop(g) AS sg FROM {name}h GROUP BY image_id),
    {name}z AS (SELECT h.image_id, x, y, 0.6e0 * (v - mv) / sv + 0.4e0 * (g - mg) / sg AS z FROM {name}h AS h JOIN {name}w AS w ON h.image_id = w.image_id),
    {name}p AS (SELECT 'x' AS axis, image_id, x AS k, avg(z) AS p FROM {name}z GROUP BY image_id, x UNION ALL SELECT 'y', image_id, y, avg(z) FROM {name}z GROUP BY image_id, y),
    {name}n AS (SELECT axis, image_id, sqrt(sum(p * p)) AS n FROM {name}p GROUP BY axis, image_id)"""  # noqa: E731


@query(f"""WITH {stencil('{v_pixels}', True, 'a').replace('FROM st', 'FROM ast')}, {stencil('{v_pixels_b}', True, 'b').replace('FROM st', 'FROM bst')}, {BLEND('a')}, {BLEND('b')},
    s AS (SELECT p.axis, p.image_id, CAST(s AS INTEGER) AS shift, sum(p.p * q.p) AS total FROM ap AS p, range(-6, 7) AS g(s), bp AS q WHERE p.axis = q.axis AND p.image_id = q.image_id AND q.k = p.k + s GROUP BY ALL),
    t AS (SELECT s.*, total / (an.n * bn.n + 1e-9) AS score FROM s JOIN an ON an.axis = s.axis AND an.image_id = s.image_id JOIN bn ON bn.axis = s.axis AND bn.image_id = s.image_id)
    SELECT image_id, axis, shift, round(score, 4) AS score FROM t QUALIFY row_number() OVER (PARTITION BY axis, image_id ORDER BY round(score, 9) DESC, abs(shift), shift) = 1""")
def profile_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.profile_shift(pixels(spark, sf_dir), pixels_b(spark, sf_dir), 6))


@query("""WITH b AS (SELECT image_id, x, unnest(range(64)) AS band, unnest(bands) AS v FROM {v_cube}), m AS (SELECT image_id, band, avg(v) AS m FROM b GROUP BY image_id, band)
    SELECT b.image_id, b.x, round(acos(least(greatest(sum(v * m) / (sqrt(sum(v*v)) * sqrt(sum(m*m)) + 1e-8), -1e0), 1e0)), 5) AS angle FROM b JOIN m ON b.image_id = m.image_id AND b.band = m.band GROUP BY b.image_id, b.x""")
def spectral_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.spectral_angle(view(spark, sf_dir, "v_cube")).select("image_id", "x", "angle"), 5)


@query("SELECT image_id, x, y, round(100 + v * 5 / (tan(radians(20e0 + image_id)) - tan(radians(-20e0))), 5) AS z FROM {v_pixels}")
def disparity_to_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = pixels(spark, sf_dir).select("image_id").distinct().selectExpr("image_id", "20e0 + image_id AS fore", "-20e0 AS aft", "5e0 AS gsd")
    found = raster.disparity_to_dem(pixels(spark, sf_dir), views, 100.0)
    # Nearly parallel lines of sight give elevations beyond 1e15, where rounding the decimal digits isn't the SQL's rounding of a multiple.
    return found.select("image_id", "x", "y", (F.round(F.col("z") * 1e5) / 1e5 + 0.0).alias("z"))


ANGLES = """b AS (SELECT image_id, x, unnest(range(64)) AS band, unnest(bands) AS v FROM {v_cube}), m AS (SELECT image_id, band, avg(v) AS m FROM b GROUP BY image_id, band),
    a AS (SELECT b.image_id, b.x, acos(least(greatest(sum(v * m) / (sqrt(sum(v*v)) * sqrt(sum(m*m)) + 1e-8), -1e0), 1e0)) AS angle, var_pop(v) AS s FROM b JOIN m ON b.image_id = m.image_id AND b.band = m.band GROUP BY b.image_id, b.x)"""


@query(f"WITH {ANGLES} SELECT image_id, round(avg(s), 6) AS spectral_variance, round(degrees(avg(angle)), 4) AS spectral_angle_deg FROM a GROUP BY image_id")
def spectral_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = raster.spectral_residuals(view(spark, sf_dir, "v_cube"))
    return done.select("image_id", (F.round("spectral_variance", 6) + 0.0).alias("spectral_variance"), (F.round("spectral_angle_deg", 4) + 0.0).alias("spectral_angle_deg"))


@query(f"""WITH {ANGLES}, o AS (SELECT image_id, x, avg(v) AS v FROM b GROUP BY image_id, x), f AS (SELECT image_id, quantile_cont(v, 0.5) AS fill FROM o GROUP BY image_id)
    SELECT o.image_id, o.x, round(CASE WHEN angle <= 1.4 THEN v ELSE fill END, 5) AS v, angle <= 1.4 AS valid FROM o JOIN f ON o.image_id = f.image_id JOIN a ON a.image_id = o.image_id AND a.x = o.x""")
def sam_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = view(spark, sf_dir, "v_cube")
    overlay = cube.select("image_id", "x", "y", (F.aggregate("bands", F.lit(0.0), lambda s, v: s + v) / F.size("bands")).alias("v"))
    return rounded(raster.sam_gate(overlay, raster.spectral_angle(cube), 1.4).drop("y"), 5)
