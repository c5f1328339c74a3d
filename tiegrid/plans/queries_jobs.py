"""Queries over solvers, patches and composed jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegrid.operators import catalog, consensus, diversity, fit, jobs, patches, points, quality, solvers
from tiegrid.plans.queries_catalog import RING, products
from tiegrid.plans.queries_points import LEGS, inliers, legs, matches, rounded, transforms
from tiegrid.plans.queries_raster import BOTH, DEM, POINTS, dem, pixels, pixels_b, stencil
from tiegrid.plans.registry import query
from tiegrid.plans.views import view


@query("""WITH i AS (SELECT product_id AS pair_id, CAST(200 + product_id % 700 AS INTEGER) AS w, CAST(150 + product_id * 7 % 900 AS INTEGER) AS h, CAST(100 + product_id % 300 AS INTEGER) AS w2, CAST(90 + product_id % 200 AS INTEGER) AS h2 FROM {v_products}),
    t AS (SELECT *, c * 192 AS x0, r * 192 AS y0, least(c * 192 + 256, w) AS x1, least(r * 192 + 256, h) AS y1 FROM i, range(6) AS a(r), range(6) AS b(c) WHERE r <= greatest(0, ceil((h - 256) / 192e0)) AND c <= greatest(0, ceil((w - 256) / 192e0)))
    SELECT pair_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(floor(x0 * (w2 / CAST(w AS DOUBLE))) AS BIGINT) AS u0, CAST(floor(y0 * (h2 / CAST(h AS DOUBLE))) AS BIGINT) AS v0, CAST(least(ceil(x1 * (w2 / CAST(w AS DOUBLE))), w2) AS BIGINT) AS u1 FROM t""")
def paired_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).selectExpr("product_id AS pair_id", "CAST(200 + product_id % 700 AS INT) AS width1", "CAST(150 + product_id * 7 % 900 AS INT) AS height1",
                                     "CAST(100 + product_id % 300 AS INT) AS width2", "CAST(90 + product_id % 200 AS INT) AS height2")
    return catalog.paired_tiles(p, 256, 64).select("pair_id", "row", "col", "u0", "v0", "u1")


@query("""SELECT sensor, count(*) AS products, count(*) FILTER (product_id % 4 = 0) AS rotated, count(*) FILTER (product_id % 4 <> 0) AS lat_paired, count(*) FILTER (product_id % 4 <> 0) AS lon_paired,
    round(max(CASE WHEN product_id % 4 = 0 THEN 0.5e0 ELSE 0e0 END), 4) AS max_relative_diff FROM {v_products} GROUP BY sensor""")
def audit_axis_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = "array(named_struct('lon', (west_lon + east_lon) / 2, 'lat', south_lat), named_struct('lon', east_lon, 'lat', (south_lat + north_lat) / 2), named_struct('lon', (west_lon + east_lon) / 2, 'lat', north_lat), named_struct('lon', west_lon, 'lat', (south_lat + north_lat) / 2))"
    return rounded(catalog.audit_axis_alignment(products(spark, sf_dir).withColumn("ring", F.expr(f"CASE WHEN product_id % 4 = 0 THEN {turned} ELSE {RING} END"))))


@query("""SELECT pair_id, match_id, round(least(greatest(0.5 * CASE WHEN match_id % 5 = 0 THEN 0.5 ELSE confidence END + 0.35 * CASE WHEN match_id % 7 = 0 THEN 0.35 ELSE least(greatest(exp(-0.75 * sigma_minor * 5), 0.15), 1) END
    + 0.15 * least(greatest(least(source_x, source_y, 512 - source_x, 512 - source_y) / 256, 0.05), 1), 0.05), 1), 10) AS quality FROM {v_matches}""")
def spatial_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = matches(spark, sf_dir).selectExpr("pair_id", "match_id", "CASE WHEN match_id % 5 <> 0 THEN confidence END AS uniqueness", "CASE WHEN match_id % 7 <> 0 THEN sigma_minor * 5 END AS refine_px", "source_x AS kx", "source_y AS ky")
    return rounded(patches.spatial_quality(p, 512.0, 512.0).select("pair_id", "match_id", "quality"), 10)


KEYPOINTS = "SELECT DISTINCT image_id, x * 64 + y AS kp_id, x AS kx, y AS ky FROM {v_pixels} WHERE x % 16 = 15 AND y % 16 = 15 AND x < 50 AND y < 50"


@query(f"""WITH k AS ({KEYPOINTS}), pa AS (SELECT k.image_id, kp_id, p.x, p.y, p.v AS a FROM k JOIN {{v_pixels}} AS p ON p.image_id = k.image_id AND abs(p.x - kx) <= 4 AND abs(p.y - ky) <= 4),
    s AS (SELECT pa.image_id, kp_id, dx, dy, corr(a, q.v) AS ncc FROM pa, range(-4, 5) AS d(dx), range(-4, 5) AS e(dy), {{v_pixels_b}} AS q WHERE q.image_id = pa.image_id AND q.x = pa.x + dx AND q.y = pa.y + dy GROUP BY ALL HAVING count(*) = 81)
    SELECT image_id, kp_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, round(ncc, 4) AS ncc FROM s QUALIFY row_number() OVER (PARTITION BY image_id, kp_id ORDER BY ncc DESC, dx, dy) = 1""")
def search_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = pixels(spark, sf_dir).filter("x % 16 = 15 AND y % 16 = 15 AND x < 50 AND y < 50").selectExpr("image_id", "x * 64 + y AS kp_id", "x AS kx", "y AS ky")
    return rounded(patches.search_displacement(pixels(spark, sf_dir), pixels_b(spark, sf_dir), k, 4, 4).select("image_id", "kp_id", "dx", "dy", "ncc"))


@query(f"""WITH {stencil('{v_pixels}', True, 'a')}, {stencil('{v_pixels_b}', True, 'b')}, k AS ({KEYPOINTS}),
    pp AS (SELECT k.image_id, kp_id, dx, dy, p.v AS a, q.v AS b, (p.sx*p.sx + p.sy*p.sy) * (q.sx*q.sx + q.sy*q.sy) AS z, (p.sx*p.sx - p.sy*p.sy) * (q.sx*q.sx - q.sy*q.sy) + 4*p.sx*p.sy*q.sx*q.sy AS c
        FROM k JOIN agr AS p ON p.image_id = k.image_id AND abs(p.x - kx) <= 4 AND abs(p.y - ky) <= 4 CROSS JOIN range(-4, 5) AS d(dx) CROSS JOIN range(-4, 5) AS e(dy) JOIN bgr AS q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy),
    s AS (SELECT image_id, kp_id, dx, dy, corr(a, b) AS ncc, sum(sqrt(z) * 0.5 * (c / (z + 1e-8) + 1)) / sum(sqrt(z)) AS goa, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM pp GROUP BY ALL HAVING count(*) = 81),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY image_id, kp_id ORDER BY goa DESC, dx, dy) <= 5),
    j AS (SELECT t.image_id, t.kp_id, t.dx, t.dy, least(31, floor((a - la) / ((ha - la + 1e-6) / 32))) AS i, least(31, floor((b - lb) / ((hb - lb + 1e-6) / 32))) AS j, count(*) / 81e0 AS p FROM t JOIN pp ON pp.image_id = t.image_id AND pp.kp_id = t.kp_id AND pp.dx = t.dx AND pp.dy = t.dy GROUP BY ALL),
    m AS (SELECT *, sum(p) OVER (PARTITION BY image_id, kp_id, dx, dy, i) AS pi, sum(p) OVER (PARTITION BY image_id, kp_id, dx, dy, j) AS pj FROM j),
    n AS (SELECT image_id, kp_id, dx, dy, sum(p * ln((p + 1e-12) / (pi * pj + 1e-12))) / -sum(p * ln(p + 1e-12)) AS mi FROM m GROUP BY ALL)
    SELECT image_id, kp_id, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, round(0.6 * mi + 0.4 * greatest(ncc, 0), 4) AS score, round(ncc, 4) AS ncc FROM t JOIN n USING (image_id, kp_id, dx, dy)
    QUALIFY row_number() OVER (PARTITION BY image_id, kp_id ORDER BY 0.6 * mi + 0.4 * greatest(ncc, 0) DESC, goa DESC, dx, dy) = 1""")
def search_displacement_multimodal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patches.search_displacement(pixels(spark, sf_dir), pixels_b(spark, sf_dir), keypoints(spark, sf_dir), 4, 4, multimodal=True)
    return rounded(found.drop("uniqueness"))


def patch_sobel(name: str, source: str, points: str, half: int) -> str:
    """Gradients within patches of ``points`` (image_id, kp_id, kx, ky), mirrored at the patches' edges, as the view ``name``."""
    row, column = "(PARTITION BY image_id, kp_id, oy ORDER BY ox)", "(PARTITION BY image_id, kp_id, ox ORDER BY oy)"
    step = lambda c, w, f, g: f"coalesce({f}({c}) OVER {w}, {g}({c}) OVER {w}, {c})"
    down = lambda c: (step(c, column, "lag", "lead"), step(c, column, "lead", "lag"))
    return f"""{name}p AS (SELECT k.image_id, kp_id, x - kx AS ox, y - ky AS oy, v FROM {points} AS k JOIN {source} AS p ON p.image_id = k.image_id AND x - kx BETWEEN -{half} AND {half - 1} AND y - ky BETWEEN -{half} AND {half - 1}),
    {name}s AS (SELECT *, {step("v", row, "lag", "lead")} AS w, {step("v", row, "lead", "lag")} AS e FROM {name}p),
    {name}n AS (SELECT *, {", ".join(f"{expr} AS {n}" for c, names in (("v", ("n", "s")), ("w", ("nw", "sw")), ("e", ("ne", "se"))) for n, expr in zip(names, down(c), strict=True))} FROM {name}s),
    {name} AS (SELECT image_id, kp_id, ox, oy, ne + 2*e + se - nw - 2*w - sw AS gx, sw + 2*s + se - nw - 2*n - ne AS gy FROM {name}n)"""


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).filter("x % 16 = 15 AND y % 16 = 15 AND x < 50 AND y < 50").selectExpr("image_id", "x * 64 + y AS kp_id", "x AS kx", "y AS ky")


@query(f"""WITH k AS ({KEYPOINTS}), {patch_sobel('g', '{v_pixels}', 'k', 8)},
    b AS (SELECT image_id, kp_id, CASE WHEN oy >= 0 THEN 2 ELSE 0 END + CASE WHEN ox >= 0 THEN 1 ELSE 0 END AS c, CAST(least(7, greatest(0, floor((atan2(gy, gx) + pi()) / (2 * pi()) * 8))) AS INTEGER) AS b, sqrt(gx*gx + gy*gy) AS m FROM g),
    h AS (SELECT image_id, kp_id, c * 8 + b AS i, sum(m) AS m FROM b GROUP BY ALL), n AS (SELECT image_id, kp_id, sqrt(sum(m*m)) AS n FROM h GROUP BY ALL)
    SELECT h.image_id, h.kp_id, i, round(m / n, 4) AS v FROM h JOIN n ON h.image_id = n.image_id AND h.kp_id = n.kp_id WHERE round(m / n, 4) > 0""")
def orientation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = patches.orientation_histogram(pixels(spark, sf_dir), keypoints(spark, sf_dir), 8, 8)
    return rounded(d.select("image_id", "kp_id", F.posexplode("desc").alias("i", "v"))).filter("v > 0")


@query(f"""WITH k AS ({KEYPOINTS}), k2 AS (SELECT image_id, kp_id, kx + 3 AS kx, ky - 2 AS ky FROM k), {patch_sobel('ga', '{v_pixels}', 'k', 8)}, {patch_sobel('gb', '{v_pixels_b}', 'k2', 8)},
    j AS (SELECT a.image_id, a.kp_id, (a.gx*a.gx + a.gy*a.gy) * (b.gx*b.gx + b.gy*b.gy) AS w2, (a.gx*a.gx - a.gy*a.gy) * (b.gx*b.gx - b.gy*b.gy) + 4*a.gx*a.gy*b.gx*b.gy AS c FROM ga AS a JOIN gb AS b ON a.image_id = b.image_id AND a.kp_id = b.kp_id AND a.ox = b.ox AND a.oy = b.oy),
    s AS (SELECT image_id, kp_id, count(*) AS n, sum(sqrt(w2)) AS w, sum(sqrt(w2) * 0.5 * (c / (w2 + 1e-8) + 1)) AS s FROM j GROUP BY ALL)
    SELECT k.image_id, k.kp_id, round(coalesce(CASE WHEN n = 256 AND w >= 1e-8 THEN s / w END, 0.5), 4) AS agreement FROM k LEFT JOIN s ON k.image_id = s.image_id AND k.kp_id = s.kp_id""")
def orientation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keypoints(spark, sf_dir).selectExpr("image_id", "kp_id", "kx AS x1", "ky AS y1", "kx + 3 AS x2", "ky - 2 AS y2")
    return rounded(patches.orientation_agreement(pixels(spark, sf_dir), pixels_b(spark, sf_dir), pairs))


def taps(column: str, window: str) -> str:
    total = sum(math.exp(-k * k / 4.5) for k in range(-3, 4))
    name = lambda k: column if k == 0 else f"{'lag' if k < 0 else 'lead'}({column}, {abs(k)}) OVER {window}"
    return " + ".join(f"{math.exp(-k * k / 4.5) / total!r} * {name(k)}" for k in range(-3, 4))


def blurred(source: str, line: str, along: str) -> str:
    w = f"(PARTITION BY image_id, {line} ORDER BY {along})"
    columns = ", ".join(f"{taps(f's{k}', w)} AS s{k}" for k in range(5))
    return f"SELECT * FROM (SELECT image_id, x, y, lead({along}, 3) OVER {w} - lag({along}, 3) OVER {w} = 6 AS ok, {columns} FROM {source}) AS q WHERE ok"


@query(f"""WITH {BOTH.replace('p.v AS a', 'p.x, p.y, p.v AS a')}, s AS (SELECT image_id, x, y, a AS s0, b AS s1, a*a AS s2, b*b AS s3, a*b AS s4 FROM ab), r AS ({blurred('s', 'y', 'x')}), c AS ({blurred('r', 'x', 'y')})
    SELECT image_id, count(*) AS n, round(avg((2*s0*s1 + 0.0001) * (2*(s4 - s0*s1) + 0.0009) / ((s0*s0 + s1*s1 + 0.0001) * (s2 - s0*s0 + s3 - s1*s1 + 0.0009))), 5) AS ssim FROM c GROUP BY image_id""")
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patches.ssim(pixels(spark, sf_dir), pixels_b(spark, sf_dir), 1.0), 5)


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_residuals").selectExpr("pair_id", "match_id", "pair_id % 5 AS image_id", "source_x / 8 AS px", "source_y / 8 AS py", "error")


@query(f"""WITH p AS ({POINTS}), q AS (SELECT *, least(greatest(px, 0e0), 63e0) AS qx, least(greatest(py, 0e0), 63e0) AS qy FROM p),
    c AS (SELECT q.*, least(floor(qx) + dx, 63) AS x, least(floor(qy) + dy, 63) AS y, CASE WHEN dx = 1 THEN qx - floor(qx) ELSE 1 - qx + floor(qx) END * CASE WHEN dy = 1 THEN qy - floor(qy) ELSE 1 - qy + floor(qy) END AS w FROM q, range(2) AS a(dx), range(2) AS b(dy)),
    z AS (SELECT pair_id, match_id, sum(w * v * 1000) AS z FROM c JOIN {{v_pixels}} AS g ON g.image_id = c.image_id AND g.x = c.x AND g.y = c.y GROUP BY pair_id, match_id), d AS (SELECT *, z - avg(z) OVER (PARTITION BY pair_id) AS dz FROM z)
    SELECT pair_id, match_id, round(dz * tan(radians(10e0)) / 5 * sin(radians(60e0)), 4) AS shift_x, round(-dz * tan(radians(10e0)) / 5 * cos(radians(60e0)), 4) AS shift_y FROM d""")
def relief_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patches.relief_shift(sampled(spark, sf_dir).drop("error"), dem(spark, sf_dir), 10.0, 60.0, 5.0).drop("reason"))


@query(f"""WITH {stencil(DEM)}, sl AS (SELECT image_id, x, y, sqrt(pow((e - w) / CASE WHEN x IN (0, 63) THEN 100 ELSE 200 END, 2) + pow((s - n) / CASE WHEN y IN (0, 63) THEN 100 ELSE 200 END, 2)) AS slope FROM gr), r AS (SELECT pair_id, pair_id % 5 AS image_id, source_x / 8 AS px, source_y / 8 AS py, error FROM {{v_residuals}})
    SELECT pair_id, count(*) AS n, round(corr(error, slope), 4) AS correlation FROM r JOIN sl ON sl.image_id = r.image_id AND x = least(greatest(round_even(px, 0), 0e0), 63e0) AND y = least(greatest(round_even(py, 0), 0e0), 63e0) GROUP BY pair_id""")
def slope_residual_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patches.slope_residual_corr(sampled(spark, sf_dir), dem(spark, sf_dir), 100.0))


@query(None)
def fit_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    return rounded(solvers.fit_homography(inliers(spark, sf_dir)).select("pair_id", "n", *(h[k].alias(f"h{k}") for k in range(9))))


@query(None)
def fit_homography_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    return rounded(solvers.fit_homography(inliers(spark, sf_dir), mode="whitened").select("pair_id", "n", *(h[k].alias(f"h{k}") for k in range(9))))


@query(f"""WITH ab AS (SELECT image_id, x, y, v AS a, v * 1.1 + 0.02 * ((x * 7 + y * 3) % 11) AS b FROM {{v_pixels}}), s AS (SELECT image_id, x, y, a AS s0, b AS s1, a*a AS s2, b*b AS s3, a*b AS s4 FROM ab), r AS ({blurred('s', 'y', 'x')}), c AS ({blurred('r', 'x', 'y')})
    SELECT image_id, count(*) AS n, round(least(greatest(avg((2*s0*s1 + 0.0001) * (2*(s4 - s0*s1) + 0.0009) / ((s0*s0 + s1*s1 + 0.0001) * (s2 - s0*s0 + s3 - s1*s1 + 0.0009))), 0), 1), 5) AS ssim FROM c WHERE x + y >= 25 AND 7 * y >= 6 * (x - 25) AND x + y <= 90 AND 6 * (y - 25) <= 7 * x GROUP BY image_id""")
def ssim_within_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = "array(named_struct('px', -5e0, 'py', 25e0), named_struct('px', 25e0, 'py', -5e0), named_struct('px', 60e0, 'py', 30e0), named_struct('px', 30e0, 'py', 60e0), named_struct('px', 30e0, 'py', 30e0))"
    inside = pixels(spark, sf_dir).select("image_id").distinct().select("image_id", F.explode(F.expr(corners)).alias("p")).select("image_id", "p.px", "p.py")
    # Two corners lie outside and are clamped to the frame.
    other = pixels(spark, sf_dir).withColumn("v", F.col("v") * 1.1 + 0.02 * ((F.col("x") * 7 + F.col("y") * 3) % 11))
    return rounded(patches.ssim_within_inliers(pixels(spark, sf_dir), other, inside, 64, 64, 1.0), 5)


@query(None)
def refine_gls(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    done = solvers.refine_gls(inliers(spark, sf_dir), transforms(spark, sf_dir))
    return rounded(done.select("pair_id", h[0].alias("a"), h[2].alias("c"), h[5].alias("f"), "objective", "status"))


@query(None)
def adjust_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = inliers(spark, sf_dir).selectExpr("pair_id AS src", "CAST(floor(pair_id / 2e0) AS BIGINT) AS ref", "source_x", "source_y", "target_x", "target_y").filter("ref > 0")
    poses, _ = solvers.adjust_network(edges, 200)  # the reference's most; most networks end before
    return rounded(poses.select("image_id", F.col("h")[2].alias("c"), F.col("h")[5].alias("f")))


@query(None)
def band_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(solvers.band_pca(view(spark, sf_dir, "v_cube"), 3).select("image_id", "component", "explained"))


@query(None)
def canonical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).withColumn("inlier", F.col("label"))
    return rounded(jobs.canonical_metrics(m, transforms(spark, sf_dir), 512.0, 512.0).withColumn("reasons", F.array_join("reasons", ",")))


@query("""WITH c AS (SELECT m.pair_id, sqrt(pow(t.a * source_x + t.b * source_y + t.c - target_x, 2) + pow(t.d * source_x + t.e * source_y + t.f - target_y, 2)) AS e FROM {v_matches} AS m JOIN {v_transforms} AS t ON t.pair_id = m.pair_id
        WHERE NOT label AND m.pair_id % 2 = 0), h AS (SELECT pair_id, sqrt(avg(e * e)) AS held, quantile_cont(e, 0.5) AS median, count(*) AS n FROM c GROUP BY pair_id)
    SELECT pair_id, 'checkpoints' AS validation, n AS checkpoints, round(held, 4) AS held_out, round(median, 4) AS held_out_median, 0.7e0 AS ssim, 0.4e0 AS nmi FROM h""")
def checkpoint_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected matches of every second pair serve as its independent checkpoints."""
    m = matches(spark, sf_dir).withColumn("inlier", F.col("label"))
    checks = matches(spark, sf_dir).filter("NOT label AND pair_id % 2 = 0")
    images = m.select("pair_id").distinct().selectExpr("pair_id", "0.7e0 AS ssim", "0.4e0 AS nmi")
    found = jobs.canonical_metrics(m, transforms(spark, sf_dir), 512.0, 512.0, checkpoints=checks, images=images).filter("validation = 'checkpoints'")
    return rounded(found.select("pair_id", "validation", "checkpoints", "held_out", "held_out_median", "ssim", "nmi"))


@query(None)
def refine_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homographies of all pairs by damped steps on whitened residuals."""
    found = solvers.refine_homography(inliers(spark, sf_dir), rounds=8)
    return rounded(found.select("pair_id", "n", "objective", "initial_objective", "status", *(F.col("h")[k].alias(f"h{k}") for k in range(9))))


@query(None)
def consensus_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homographies of all pairs by draws that favour confident matches."""
    found = consensus.consensus_homography(matches(spark, sf_dir), 5.0, 64, weight="confidence")
    h = F.col("h")
    return found.select("pair_id", "hyp", "n", "inliers", "method", F.round("rmse", 4).alias("rmse"), *(F.round(h[k], 8 if k in (6, 7) else 4).alias(f"h{k}") for k in range(9)))


STATUS = ["pair_id", "status", "candidates", "inliers", "near_share", "fit_rmse", "held_out", "quality_tier", "color", "verdict"]


@query(None)
def register_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.register_pairs(matches(spark, sf_dir), 512.0, 512.0, hypotheses=32).select(STATUS))


@query(None)
def register_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.register_tiled(matches(spark, sf_dir), 512.0, 512.0).select(STATUS))


@query(f"""WITH {LEGS} SELECT n.triplet_id, CASE WHEN have = 3 THEN 'measured' WHEN have = 2 THEN 'composed' ELSE 'cycle_not_computable' END AS completion, round(rmse, 4) AS rmse, rmse < 5 AS is_closed, status AS network_status FROM n LEFT JOIN r USING (triplet_id)
    LEFT JOIN (SELECT CAST(floor(pair_id / 3e0) AS BIGINT) AS triplet_id, CASE WHEN count(DISTINCT pair_id) < 2 THEN 'failed' ELSE 'ok' END AS status FROM {{v_matches}} WHERE label GROUP BY 1) AS w USING (triplet_id)""")
def evaluate_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = inliers(spark, sf_dir).selectExpr("CAST(floor(pair_id / 3e0) AS BIGINT) AS triplet_id", "pair_id * 10 AS src", "CAST(floor(pair_id / 3e0) AS BIGINT) * 30 + 7 AS ref", "source_x", "source_y", "target_x", "target_y")
    found = jobs.evaluate_triplets(legs(spark, sf_dir), 512.0, 512.0, m)
    return rounded(found.select("triplet_id", "completion", "rmse", "is_closed", "network_status"))


METHODS = """e AS (SELECT pair_id, 'labelled' AS method, error FROM {v_residuals} WHERE label UNION ALL SELECT m.pair_id, 'all', sqrt(pow(a*source_x + b*source_y + c - target_x, 2) + pow(d*source_x + e*source_y + f - target_y, 2))
        FROM {v_matches} AS m JOIN (SELECT pair_id, a, b, mu - a*mx - b*my AS c, d, e, mv - d*mx - e*my AS f FROM (SELECT *, (xu*yy - yu*xy)/(xx*yy - xy*xy) AS a, (yu*xx - xu*xy)/(xx*yy - xy*xy) AS b, (xv*yy - yv*xy)/(xx*yy - xy*xy) AS d, (yv*xx - xv*xy)/(xx*yy - xy*xy) AS e
            FROM (SELECT pair_id, avg(source_x) AS mx, avg(source_y) AS my, avg(target_x) AS mu, avg(target_y) AS mv, var_pop(source_x) AS xx, var_pop(source_y) AS yy, covar_pop(source_x, source_y) AS xy, covar_pop(source_x, target_x) AS xu, covar_pop(source_y, target_x) AS yu,
                covar_pop(source_x, target_y) AS xv, covar_pop(source_y, target_y) AS yv FROM {v_matches} GROUP BY pair_id) AS s) AS q) AS t ON m.pair_id = t.pair_id),
    q AS (SELECT method, pair_id, sqrt(avg(error*error)) AS rmse, avg(CASE WHEN error < 0.75 THEN 1e0 ELSE 0 END) AS near FROM e GROUP BY method, pair_id), o AS (SELECT *, near >= 0.55 AS success, CASE WHEN rmse > 5 THEN 'rmse_over_gate' ELSE 'unknown' END AS "primary" FROM q)"""


@query(f"""WITH {METHODS}, c AS (SELECT method, "primary" FROM o WHERE NOT success GROUP BY method, "primary" QUALIFY row_number() OVER (PARTITION BY method ORDER BY count(*) DESC, "primary" DESC) = 1),
    p AS (SELECT 'all' AS method, count(*) FILTER (x.success AND NOT y.success) AS b, count(*) FILTER (NOT x.success AND y.success) AS c FROM o AS x JOIN o AS y ON x.pair_id = y.pair_id AND x.method = 'all' AND y.method = 'labelled'),
    v AS (SELECT method, b, c, CASE WHEN b + c = 0 THEN 1e0 ELSE least(1e0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) FROM range(0, 1000000) AS g(k) WHERE k <= least(b, c))) END AS p FROM p)
    SELECT o.method, count(*) AS pairs, count(*) FILTER (success) AS successes, round(avg(CASE WHEN success THEN 1e0 ELSE 0 END), 4) AS success_rate, round(avg(CASE WHEN success THEN rmse END), 4) AS mean_rmse, round(quantile_cont(CASE WHEN success THEN rmse END, 0.5), 4) AS median_rmse,
        max(c."primary") AS top_cause, max(v.b) AS b, max(v.c) AS c, round(max(v.p), 4) AS p_value FROM o LEFT JOIN c ON o.method = c.method LEFT JOIN v ON o.method = v.method GROUP BY o.method""")
def compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps fitted to all candidates against maps fitted to the labelled ones; a pair succeeds if over half its residuals are small."""
    outcome = lambda m, t, name: points.project(m.join(t.select("pair_id", "h"), "pair_id")).groupBy("pair_id").agg(
        F.lit(name).alias("method"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg((F.col("error") < 0.75).cast("double")).alias("near")
    )
    every = matches(spark, sf_dir)
    runs = outcome(every, fit.fit_affine(every), "all").unionByName(outcome(inliers(spark, sf_dir), transforms(spark, sf_dir), "labelled"))
    none = {c: F.lit(None).cast("double") for c in ("texture", "sun_gap", "scale", "dark", "saturated")}
    judged = quality.failure_causes(runs.withColumns({"success": F.col("near") >= 0.55, "gate_px": F.lit(5.0), **none}))
    return rounded(jobs.compare_methods(judged, "labelled"))


@query(None)
def diverse_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    return diversity.diverse_triplets(catalog.first_triplets(p, 0.5, 3), p, 0.8, 5.0, 3)


@query(None)
def build_catalog_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    old = p.filter("product_id % 50 = 0").selectExpr("concat('old-', product_id) AS triplet_id", "CASE WHEN product_id % 100 = 0 THEN 'region_x' END AS region_id")
    return jobs.build_catalog_job(p, old)


@query("""WITH m AS (SELECT m.pair_id % 30 AS region_id, round(north_lat - source_y / 512 * (north_lat - south_lat), 9) AS lat FROM {v_matches} AS m LEFT JOIN {v_regions} AS r ON m.pair_id % 30 = r.id), c AS (SELECT region_id, count(*) AS n, avg(lat) AS lat FROM m GROUP BY region_id)
    SELECT r.id AS region_id, coalesce(n, 0) AS matches, round(lat, 4) AS mean_lat, round(CASE WHEN r.id % 2 = 0 THEN r.id / 10e0 WHEN r.id % 3 = 0 THEN r.id / 5e0 END, 4) AS rmse, CASE WHEN r.id % 2 = 0 THEN 'benchmark' WHEN r.id % 3 = 0 THEN 'registration' END AS source,
        CASE WHEN r.id % 2 <> 0 AND r.id % 3 <> 0 THEN 'no metrics for this region' END AS note FROM {v_regions} AS r LEFT JOIN c ON r.id = c.region_id""")
def serve_region_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "v_regions")
    b, p = r.filter("id % 2 = 0").selectExpr("id AS region_id", "id / 10e0 AS rmse"), r.filter("id % 3 = 0").selectExpr("id AS region_id", "id / 5e0 AS rmse")
    done = jobs.serve_region_view(r, matches(spark, sf_dir).selectExpr("*", "pair_id % 30 AS region_id"), b, p, 512.0, 512.0)
    return rounded(done.drop("mean_lon"))
