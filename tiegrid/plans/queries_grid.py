"""Queries over grids, gates, selections and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegrid.operators import experiments, points, quality, selection
from tiegrid.plans.queries_points import inliers, matches, rounded, transforms
from tiegrid.plans.registry import query
from tiegrid.plans.views import view

CELLS = """c AS (SELECT pair_id, least(7, greatest(0, CAST(floor(source_x / 64e0) AS INTEGER))) AS gx, least(7, greatest(0, CAST(floor(source_y / 64e0) AS INTEGER))) AS gy, count(*) AS c
    FROM {v_matches} WHERE label GROUP BY ALL)"""


@query(f"""WITH {CELLS}, s AS (SELECT pair_id, CAST(sum(c) AS BIGINT) AS n, sum(c*c) / 64e0 AS q, count(*) / 64e0 AS share, sum(c) / 64e0 AS m, sum(c * log2(c)) AS cl FROM c GROUP BY pair_id)
    SELECT pair_id, n, round(share, 4) AS coverage, round(m, 4) AS mean, round(sqrt(greatest(q - m*m, 0e0)), 4) AS std, round((log2(n) - cl / n) / 6, 4) AS entropy,
        round(share * exp(-0.3 * sqrt(greatest(q - m*m, 0e0)) / m), 4) AS uniformity, round(1 - sqrt(greatest(q - m*m, 0e0)) / sqrt(n*n/64e0 - m*m), 4) AS balance FROM s""")
def spatial_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.spatial_distribution(inliers(spark, sf_dir), 512.0, 512.0, 8))


@query("""WITH m AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS n FROM {v_matches} WHERE label), g AS (SELECT *, CAST(ceil(sqrt(n)) AS INTEGER) AS g FROM m)
    SELECT pair_id, n, g, round(count(*) / (CAST(g AS DOUBLE) * g), 4) AS coverage FROM (SELECT DISTINCT pair_id, n, g, least(g - 1, greatest(0, CAST(floor(source_x / (512e0 / g)) AS INTEGER))) AS gx,
        least(g - 1, greatest(0, CAST(floor(source_y / (512e0 / g)) AS INTEGER))) AS gy FROM g) AS q GROUP BY pair_id, n, g""")
def adaptive_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.adaptive_distribution(inliers(spark, sf_dir), 512.0, 512.0))


@query(f"""WITH {CELLS} SELECT pair_id, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 6, 4) AS entropy FROM c GROUP BY pair_id""")
def entropy_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.spatial_distribution(inliers(spark, sf_dir), 512.0, 512.0, 8).select("pair_id", "entropy"))


@query(f"""WITH {CELLS}, s AS (SELECT pair_id, sum(c) AS n, sum(c*c) / 64e0 AS q, sum(c) / 64e0 AS m FROM c GROUP BY pair_id)
    SELECT pair_id, round(1 - sqrt(greatest(q - m*m, 0e0)) / sqrt(n*n/64e0 - m*m), 4) AS balance FROM s""")
def balance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.spatial_distribution(inliers(spark, sf_dir), 512.0, 512.0, 8).select("pair_id", "balance"))


@query("""WITH c AS (SELECT pair_id, least(3, greatest(0, floor(source_x / 128e0))) AS gx, least(3, greatest(0, floor(source_y / 128e0))) AS gy, count(*) AS c FROM {v_matches}
        WHERE label AND (pair_id % 4 <> 0 OR source_x < 120) AND (pair_id % 9 <> 0 OR source_y < 130 AND source_x < 130) GROUP BY ALL),
    s AS (SELECT pair_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS cells, max(c) / CAST(sum(c) AS DOUBLE) AS share FROM c GROUP BY pair_id),
    r AS (SELECT *, CASE WHEN n < 4 THEN 'too_few_inliers' WHEN cells < 3 THEN 'too_few_cells' WHEN share > 0.60 THEN 'concentrated' ELSE 'ok' END AS reason FROM s)
    SELECT pair_id, n, cells, round(share, 4) AS max_share, reason = 'ok' AS accepted, reason FROM r""")
def support_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = inliers(spark, sf_dir).filter("(pair_id % 4 <> 0 OR source_x < 120) AND (pair_id % 9 <> 0 OR source_y < 130 AND source_x < 130)")
    return rounded(quality.support_gate(m, 512.0, 512.0))


@query("""WITH m AS (SELECT *, least(3, greatest(0, CAST(floor(source_x / 128e0) AS INTEGER))) AS gx, least(3, greatest(0, CAST(floor(source_y / 128e0) AS INTEGER))) AS gy,
        radians(angle) * 2 AS t2 FROM {v_matches} WHERE sigma_major - sigma_minor > 0.001 AND abs(sigma_major / greatest(sigma_minor, 1e-3) - 2) > 1e-9)
    SELECT pair_id, gx, gy, count(*) AS n, round(avg(sigma_major), 9) AS major, round(avg(sigma_minor), 9) AS minor, round(avg(sigma_major*sigma_major + sigma_minor*sigma_minor), 9) AS trace,
        round(avg(cos(t2)), 3) AS c, count(*) FILTER (sigma_major / greatest(sigma_minor, 1e-3) >= 2 AND sigma_minor <= 0.6) AS elongated, count(*) FILTER (sigma_major / greatest(sigma_minor, 1e-3) < 2 AND sigma_major <= 1.2) AS isotropic, round(avg(confidence), 6) AS mean_confidence FROM m GROUP BY GROUPING SETS ((pair_id, gx, gy), (pair_id))""")
def cell_covariance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Where the axes are equal the angle, and at a ratio of exactly 2 the kind, hangs on the last digit.
    m = matches(spark, sf_dir).filter("sigma_major - sigma_minor > 0.001 AND abs(sigma_major / greatest(sigma_minor, 1e-3) - 2) > 1e-9")
    found = quality.cell_covariance_stats(m, 512.0, 512.0, 4)
    again = points.covariance_axes(m).withColumns({"gx": quality.cell(F.col("source_x"), 128.0, 4), "gy": quality.cell(F.col("source_y"), 128.0, 4)})
    cosine = again.groupingSets([[F.col("pair_id"), F.col("gx"), F.col("gy")], [F.col("pair_id")]], F.col("pair_id"), F.col("gx"), F.col("gy")).agg(
        F.round(F.avg(F.cos(F.radians("axis_angle") * 2)), 3).alias("c")
    )
    joined = found.join(cosine, (found.pair_id == cosine.pair_id) & found.gx.eqNullSafe(cosine.gx) & found.gy.eqNullSafe(cosine.gy))
    return rounded(joined.select(found.pair_id, found.gx, found.gy, "n", "major", "minor", "trace", "c", "elongated", "isotropic", F.round("mean_confidence", 6).alias("mean_confidence")), 9).withColumn("c", F.col("c") + 0.0)


METRICS = """SELECT pair_id, count(*) AS k, count(*) FILTER (label) AS good FROM {v_matches} GROUP BY pair_id"""
LIGHT = f"""q AS (SELECT pair_id, CASE WHEN pair_id % 13 = 0 THEN 0e0 ELSE (pair_id * 37 % 100) / 100e0 END AS inlier_ratio, CAST(CASE WHEN pair_id % 13 = 0 THEN 0 WHEN pair_id % 11 = 0 THEN 3 ELSE good END AS BIGINT) AS inliers,
    CASE WHEN pair_id % 7 = 0 THEN NULL ELSE (pair_id * 53 % 400) / 100e0 END AS held_out, CASE WHEN pair_id % 5 = 0 THEN NULL ELSE (pair_id * 29 % 110) / 100e0 END AS ssim, (pair_id * 17 % 300) / 100e0 AS fit_rmse
    FROM ({METRICS}) AS m)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).groupBy("pair_id").agg(F.count_if("label").alias("good"))
    return m.selectExpr(
        "pair_id", "CASE WHEN pair_id % 13 = 0 THEN 0e0 ELSE (pair_id * 37 % 100) / 100e0 END AS inlier_ratio",
        "CAST(CASE WHEN pair_id % 13 = 0 THEN 0 WHEN pair_id % 11 = 0 THEN 3 ELSE good END AS BIGINT) AS inliers",
        "CASE WHEN pair_id % 7 = 0 THEN NULL ELSE (pair_id * 53 % 400) / 100e0 END AS held_out",
        "CASE WHEN pair_id % 5 = 0 THEN NULL ELSE (pair_id * 29 % 110) / 100e0 END AS ssim", "(pair_id * 17 % 300) / 100e0 AS fit_rmse",
    )


COLOR = """r AS (SELECT *, least(greatest(coalesce(ssim, 0), 0), 1) AS s, list_filter([CASE WHEN inliers > 0 AND inliers < 4 THEN 'few_inliers' END, CASE WHEN inliers = 0 AND inlier_ratio <= 0 THEN 'no_inliers' END,
        CASE WHEN inlier_ratio < 0.3 THEN 'weak_consensus' END, CASE WHEN held_out > 3 THEN 'held_out_over_3' END,
        CASE WHEN held_out <= 3 AND held_out > 2.5 AND fit_rmse > 1.5 AND inliers >= 20 THEN 'held_out_over_2_5' END], lambda x: x IS NOT NULL) AS reasons FROM q),
    l AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'RED' WHEN held_out < 1.5 AND s > 0.65 AND inlier_ratio > 0.5 THEN 'GREEN' ELSE 'YELLOW' END AS color FROM r)"""


@query(f"WITH {LIGHT}, {COLOR} SELECT pair_id, color, array_to_string(reasons, ',') AS reasons FROM l")
def traffic_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.traffic_light(metrics(spark, sf_dir)).select("pair_id", "color", F.array_join("reasons", ",").alias("reasons"))


TIERS = "CASE WHEN inliers < 4 THEN 'FAILED' WHEN inliers >= 15 AND inlier_ratio >= 0.15 AND held_out < 2 THEN 'HIGH_CONFIDENCE' WHEN inliers >= 10 AND inlier_ratio >= 0.10 THEN 'ACCEPTED' ELSE 'LOW_CONFIDENCE' END"


@query(f"""WITH {LIGHT}, {COLOR}, t AS (SELECT *, {TIERS} AS tier FROM l), f AS (SELECT *, CASE WHEN color = 'GREEN' AND tier <> 'FAILED' THEN 'PASS' WHEN color = 'RED' OR tier = 'FAILED' THEN 'FAIL' ELSE 'REVIEW' END AS v FROM t)
    SELECT pair_id, tier, CASE WHEN inliers < 4 THEN 'FAIL' WHEN inliers < 8 AND v <> 'FAIL' THEN 'REVIEW' ELSE v END AS verdict FROM f""")
def quality_tier_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = quality.traffic_light(metrics(spark, sf_dir))
    tier = quality.quality_tier(F.col("inliers"), F.col("inlier_ratio"), F.col("held_out"), F.lit(True))
    lit = lit.withColumn("tier", tier)
    return lit.select("pair_id", "tier", quality.verdict(F.col("color"), F.col("tier"), F.col("inliers"), F.lit(False)).alias("verdict"))


@query(f"""WITH {LIGHT} SELECT pair_id, round(least(greatest(CASE WHEN ssim IS NOT NULL OR held_out IS NOT NULL
    THEN 0.25 * (inlier_ratio + exp(-fit_rmse / 2) + inlier_ratio + 0.6 * coalesce(held_out / 4, 0) + 0.4 * greatest(coalesce(ssim, 0), 0))
    ELSE (inlier_ratio + exp(-fit_rmse / 2) + inlier_ratio) / 3 END, 0), 1), 4) AS composite FROM q""")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = quality.composite_score(F.col("inlier_ratio"), F.col("fit_rmse"), F.col("inlier_ratio"), F.col("held_out") / 4, F.col("ssim"))
    return rounded(metrics(spark, sf_dir).select("pair_id", score.alias("composite")))


@query(f"""WITH {LIGHT}, c AS (SELECT pair_id, list_filter([CASE WHEN inliers < 15 THEN 'low_texture' END, CASE WHEN held_out * 30 > 45 THEN 'illumination_gap' END, CASE WHEN ssim * 12 > 10 THEN 'scale_gap' END,
    CASE WHEN inlier_ratio > 0.4 THEN 'shadow' END, CASE WHEN ssim > 0.3 THEN 'saturation' END, CASE WHEN fit_rmse > 2 THEN 'rmse_over_gate' END], lambda x: x IS NOT NULL) AS causes FROM q)
    SELECT pair_id, array_to_string(causes, ',') AS causes, coalesce(causes[1], 'unknown') AS "primary" FROM c""")
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir).selectExpr("pair_id", "inliers AS texture", "held_out * 30 AS sun_gap", "ssim * 12 AS scale", "inlier_ratio AS dark", "ssim AS saturated", "fit_rmse AS rmse", "2e0 AS gate_px")
    return quality.failure_causes(m).select("pair_id", F.array_join("causes", ",").alias("causes"), "primary")


@query("""WITH h AS (SELECT pair_id, n, a * CASE WHEN pair_id % 5 = 0 THEN 1e-6 ELSE 1 END AS a, b, c, d, e * CASE WHEN pair_id % 7 = 0 THEN 30 ELSE 1 END AS e, f, CASE WHEN pair_id % 3 = 0 THEN 0.06e0 ELSE 1e-4 END AS g, 2e-5 AS k FROM {v_transforms}),
    m AS (SELECT *, a*a + d*d + g*g AS xx, a*b + d*e + g*k AS xy, a*c + d*f + g AS xz, b*b + e*e + k*k AS yy, b*c + e*f + k AS yz, c*c + f*f + 1 AS zz, a*(e - f*k) - b*(d - f*g) + c*(d*k - e*g) AS det, a*a + b*b + d*d + e*e AS s, abs(a*e - b*d) AS t FROM h),
    q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m), p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q),
    r AS (SELECT *, acos(least(greatest(((xx - q) * ((yy - q) * (zz - q) - yz*yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p*p*p), -1), 1)) / 3 AS phi FROM p),
    l AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM r),
    o AS (SELECT pair_id, n, det, l1 * sqrt(greatest(3*q - l1 - l3, 0)) / abs(det) AS cond, sqrt((s + sqrt(greatest(s*s - 4*t*t, 0))) / 2) / greatest(sqrt(greatest((s - sqrt(greatest(s*s - 4*t*t, 0))) / 2, 0)), 1e-9) AS ratio, sqrt(g*g + k*k) AS pr FROM l)
    SELECT pair_id, n, round(det, 4) AS determinant, round(log10(cond), 4) AS log_condition, round(log10(ratio), 4) AS log_scale_ratio, round(pr, 4) AS projectivity, cond < 1e7 AND det > 1e-4 AND ratio < 20 AND pr < 0.05 AS is_valid FROM o""")
def transform_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted maps, some of them flattened, stretched or bent so that each limit is met and missed."""
    h = F.col("h")
    off = {0: F.when(F.col("pair_id") % 5 == 0, 1e-6).otherwise(1.0), 4: F.when(F.col("pair_id") % 7 == 0, 30.0).otherwise(1.0)}
    bent = F.array(*(h[k] * off[k] if k in off else h[k] for k in range(6)), F.when(F.col("pair_id") % 3 == 0, 0.06).otherwise(1e-4), F.lit(2e-5), F.lit(1.0))
    found = quality.transform_gate(transforms(spark, sf_dir).withColumn("h", bent))
    found = found.select("pair_id", "n", "determinant", F.log10("condition").alias("log_condition"), F.log10("scale_ratio").alias("log_scale_ratio"), "projectivity", "is_valid")
    return rounded(found)


GRID8 = "least(7, greatest(0, CAST(floor(source_x / 64e0) AS INTEGER)))"


@query("""SELECT pair_id, match_id, gx, gy, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, gx, gy ORDER BY confidence DESC, match_id) AS k FROM (SELECT *,
        least(7, greatest(0, CAST(floor(source_x / 64e0) AS INTEGER))) AS gx, least(7, greatest(0, CAST(floor(source_y / 64e0) AS INTEGER))) AS gy FROM {v_matches} WHERE confidence >= 0.1) AS c) AS r WHERE k <= 2""")
def grid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.grid_topk(matches(spark, sf_dir), 512.0, 512.0, 8, 2, 0.1).select("pair_id", "match_id", "gx", "gy", "k")


SCORE = "confidence / (1 + 0.5 * pow(sigma_major, 0.7) * pow(greatest(sigma_minor, 1e-3), 0.5)) * (1 + 0.6 / (1 + 2 * greatest(sigma_minor, 1e-3)))"
BUDGET = f"""b AS (SELECT pair_id, match_id, angle, {SCORE} AS s, least(7, greatest(0, CAST(floor(source_x / 64e0) AS INTEGER))) AS gx, least(7, greatest(0, CAST(floor(source_y / 64e0) AS INTEGER))) AS gy FROM {{v_matches}}),
    r0 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY pair_id, gx, gy ORDER BY s DESC, match_id) = 1),
    c1 AS (SELECT b.*, abs(b.angle - r0.angle) % 180 AS d FROM b JOIN r0 ON b.pair_id = r0.pair_id AND b.gx = r0.gx AND b.gy = r0.gy AND b.match_id <> r0.match_id),
    r1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY pair_id, gx, gy ORDER BY s * (1 + 0.25 * sin(2 * radians(least(d, 180 - d)))) DESC, match_id) = 1),
    u AS (SELECT pair_id, match_id, 0 AS round, gx, gy FROM r0 UNION ALL SELECT pair_id, match_id, 1, gx, gy FROM r1)"""


@query(f"WITH {BUDGET} SELECT pair_id, match_id, round, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY round, gx, gy) AS INTEGER) AS slot FROM u QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round, gx, gy) <= 100")
def density_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.density_budget(matches(spark, sf_dir), 512.0, 512.0, 8, 2, 100).select("pair_id", "match_id", "round", "slot")


@query("""WITH p AS (SELECT pair_id, match_id, source_x AS x, source_y AS y, confidence AS s, row_number() OVER (PARTITION BY pair_id ORDER BY confidence DESC, match_id) AS r FROM {v_matches} QUALIFY r <= 80),
    d AS (SELECT a.pair_id, a.match_id, min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d2 FROM p AS a LEFT JOIN p AS b ON a.pair_id = b.pair_id AND b.r < a.r AND b.s > 0.9e0 * a.s GROUP BY ALL)
    SELECT pair_id, match_id, round(sqrt(d2), 4) AS radius, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(d2, 1e30) DESC, match_id) AS INTEGER) AS k FROM d QUALIFY k <= 20""")
def anms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.anms(matches(spark, sf_dir), 20, 0.9).select("pair_id", "match_id", "radius", "k"))


def covering_steps(n: int, steps: int = 10) -> str:
    """The halving search over squares of all sides, step by step: s0, s1, ... (pair_id, low, high, side)."""
    out = [f"s0 AS (SELECT pair_id, 1 AS low, 512 AS high, -1 AS side FROM sizes WHERE n > {n})"]
    for k in range(steps):
        out.append(f"""t{k} AS (SELECT *, (low + high) // 2 AS r, low < high AND (low + high) // 2 <> side AS going FROM s{k}),
    s{k + 1} AS (SELECT t.pair_id, CASE WHEN going AND c.n > {n} * 1.1 THEN t.r + 1 ELSE low END AS low, CASE WHEN NOT going OR c.n > {n} * 1.1 THEN high WHEN c.n < {n} * 0.9 THEN t.r - 1 ELSE -1 END AS high,
        CASE WHEN going THEN t.r ELSE side END AS side FROM t{k} AS t LEFT JOIN c ON c.pair_id = t.pair_id AND c.r = t.r)""")
    return ", ".join(out)


@query(f"""WITH sizes AS (SELECT pair_id, count(*) AS n FROM {{v_matches}} GROUP BY pair_id),
    c AS (SELECT pair_id, r, count(*) AS n FROM (SELECT DISTINCT pair_id, r, least(ceil(512 / r) - 1, floor(source_x / r)) AS gx, least(ceil(512 / r) - 1, floor(source_y / r)) AS gy FROM {{v_matches}}, range(1, 513) AS g(r)) AS q GROUP BY pair_id, r),
    {covering_steps(20)}, m AS (SELECT v.*, side FROM {{v_matches}} AS v JOIN s10 ON s10.pair_id = v.pair_id),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY pair_id, least(ceil(512 / side) - 1, floor(source_x / side)), least(ceil(512 / side) - 1, floor(source_y / side)) ORDER BY confidence DESC, match_id) = 1)
    SELECT pair_id, match_id, side AS cell_size FROM b QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY confidence DESC, match_id) <= 20
    UNION ALL SELECT v.pair_id, match_id, NULL FROM {{v_matches}} AS v JOIN sizes ON sizes.pair_id = v.pair_id WHERE n <= 20""")
def square_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.square_covering(matches(spark, sf_dir), 20, 512, 512).select("pair_id", "match_id", "cell_size")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY confidence DESC, match_id) AS r1, row_number() OVER (PARTITION BY pair_id ORDER BY sigma_major, match_id) AS r2 FROM {v_matches}),
    p AS (SELECT pair_id, CAST(k AS INTEGER) AS k, avg(CASE WHEN label THEN 1e0 ELSE 0 END) FILTER (r1 <= k) AS p1, avg(CASE WHEN label THEN 1e0 ELSE 0 END) FILTER (r2 <= k) AS p2 FROM r, (VALUES (5), (10), (20), (50)) AS ks(k) GROUP BY pair_id, k)
    SELECT k, round(avg(p1), 4) AS precision_a, round(avg(p2), 4) AS precision_b, count(*) AS groups FROM p GROUP BY k""")
def topk_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.topk_precision(matches(spark, sf_dir), F.col("confidence").desc(), F.col("sigma_major").asc(), [5, 10, 20, 50]))


@query("""WITH q AS (SELECT pair_id, CASE WHEN count(*) > 4 THEN quantile_cont(confidence, 0.25) ELSE 0.3 END AS cut FROM {v_matches} GROUP BY pair_id)
    SELECT m.pair_id, match_id FROM {v_matches} AS m JOIN q ON m.pair_id = q.pair_id WHERE confidence >= cut""")
def baseline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.baseline_filter(matches(spark, sf_dir)).select("pair_id", "match_id")


@query("""SELECT pair_id, match_id FROM {v_matches} QUALIFY row_number() OVER (PARTITION BY pair_id, round(confidence, 1), label, round(source_x / 50), round(source_y / 50) ORDER BY match_id) = 1""")
def dedup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("pair_id"), F.round("confidence", 1), F.col("label"), F.round(F.col("source_x") / 50), F.round(F.col("source_y") / 50)]
    return selection.keep_first(matches(spark, sf_dir), keys, ["match_id"]).select("pair_id", "match_id")


@query("""SELECT pair_id, match_id FROM {v_matches} QUALIFY row_number() OVER (PARTITION BY pair_id, round_even(source_x / 3, 0), round_even(source_y / 3, 0) ORDER BY match_id) = 1""")
def stitch_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stitch_tiles(matches(spark, sf_dir)).select("pair_id", "match_id")


BELOW = ", ".join(f"round(avg(CASE WHEN e < {t} THEN 1e0 ELSE 0 END), 4) AS below_{n}" for t, n in ((0.1, "010"), (0.2, "020"), (0.25, "025"), (0.5, "050"), (1, "1")))
ERRORS = """e AS (SELECT trial_id, direction, magnitude, error_x, error_y, sqrt(error_x*error_x + error_y*error_y) AS e FROM {v_trials} WHERE is_valid)"""


@query(f"""WITH {ERRORS} SELECT direction, magnitude, count(*) AS n, round(avg(e), 4) AS mean, round(quantile_cont(e, 0.5), 4) AS median, round(sqrt(avg(e*e)), 4) AS rmse, round(quantile_cont(e, 0.95), 4) AS p95,
    round(max(e), 4) AS max, round(avg(error_x), 4) AS bias_x, round(avg(error_y), 4) AS bias_y, {BELOW}
    FROM e GROUP BY GROUPING SETS ((), (direction), (magnitude))""")
def benchmark_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.benchmark_breakdown(view(spark, sf_dir, "v_trials").filter("is_valid")))


@query("""WITH a AS (SELECT *, sqrt(error_x*error_x + error_y*error_y) AS e, (cyy*error_x*error_x - 2*cxy*error_x*error_y + cxx*error_y*error_y) / (cxx*cyy - cxy*cxy) AS d2 FROM {v_trials}), t AS (SELECT * FROM a WHERE is_valid),
    r AS (SELECT level, round(avg(CASE WHEN d2 <= -2 * ln(1 - level) THEN 1e0 ELSE 0 END), 4) AS observed FROM t, (VALUES (0.1e0), (0.2e0), (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.7e0), (0.8e0), (0.9e0), (0.95e0)) AS l(level) GROUP BY level),
    g AS (SELECT avg(abs(observed - level)) AS ece, max(abs(observed - level)) AS mce, sqrt(avg(pow(observed - level, 2))) AS rmsce FROM r),
    q AS (SELECT avg(CASE WHEN sqrt(d2) <= 1 THEN 1e0 ELSE 0 END) AS i1, avg(CASE WHEN sqrt(d2) <= 2 THEN 1e0 ELSE 0 END) AS i2, avg(CASE WHEN sqrt(d2) <= 3 THEN 1e0 ELSE 0 END) AS i3, avg(CASE WHEN sqrt(d2) <= 1.5152 THEN 1e0 ELSE 0 END) AS p68,
        avg(CASE WHEN sqrt(d2) <= 2.4860 THEN 1e0 ELSE 0 END) AS p95, avg(CASE WHEN sqrt(d2) <= 3.4393 THEN 1e0 ELSE 0 END) AS p99, quantile_cont(d2, 0.5) / (2 * ln(2)) AS s, sqrt(avg(e*e)) AS rmse, avg(e) AS e FROM t),
    n AS (SELECT count(*) AS trials, count(*) FILTER (is_valid) AS n_valid, count(*) FILTER (status = 'flat_peak') AS n_flat, count(*) FILTER (status = 'multimodal') AS n_multimodal, count(*) FILTER (status = 'failed') AS n_failed,
        avg(e) FILTER (status = 'flat_peak') AS fe, avg(e) FILTER (status = 'multimodal') AS me FROM a)
    SELECT trials, n_valid, n_flat, n_multimodal, n_failed, round(n_valid / CAST(trials AS DOUBLE), 4) AS valid_rate, round(n_flat / CAST(trials AS DOUBLE), 4) AS flat_rate, round(n_multimodal / CAST(trials AS DOUBLE), 4) AS multimodal_rate,
        round(e, 4) AS valid_mean_error, round(rmse, 4) AS valid_rmse, round(fe, 4) AS flat_mean_error, round(me, 4) AS multimodal_mean_error, round(i1, 4) AS inside_1sigma, round(i2, 4) AS inside_2sigma, round(i3, 4) AS inside_3sigma,
        round(p68, 4) AS inside_p68, round(p95, 4) AS inside_p95, round(p99, 4) AS inside_p99, (SELECT array_to_string(list(round(observed * 10000) ORDER BY level), ',') FROM r) AS reliability, round(ece, 7) AS ece, round(mce, 7) AS mce, round(rmsce, 7) AS rmsce, round(s, 4) AS scale_factor,
        CASE WHEN ece <= 0.12 AND abs(p95 - 0.9545) <= 0.15 THEN 'PROBABILISTICALLY_CALIBRATED' WHEN s > 1.40 THEN 'OVERCONFIDENT_UNCALIBRATED' WHEN s < 0.65 THEN 'CONSERVATIVE_BOUNDS' ELSE 'BORDERLINE_CALIBRATED' END AS verdict FROM g, q, n""")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = experiments.calibration_report(view(spark, sf_dir, "v_trials"))
    found = found.withColumn("reliability", F.array_join(F.transform("reliability", lambda r: F.round(r * 10000).cast("double").cast("string")), ","))
    # The gaps are means of 4-digit numbers, so they are kept with more digits.
    digits = {c: 7 if c in ("ece", "mce", "rmsce") else 4 for c, t in found.dtypes if t == "double"}
    return found.withColumns({c: F.round(c, d) + 0.0 for c, d in digits.items()})


@query("""WITH c AS (SELECT r / 10e0 AS min_confidence, s / 2e0 AS max_sigma, count(*) FILTER (label AND confidence >= r / 10e0 AND sigma_major <= s / 2e0) AS tp, count(*) FILTER (NOT label AND confidence >= r / 10e0 AND sigma_major <= s / 2e0) AS fp,
        count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM {v_matches}, range(1, 10) AS a(r), range(1, 4) AS b(s) GROUP BY r, s)
    SELECT min_confidence, max_sigma, tp, fp, p - tp AS fn, n - fp AS tn, round(tp / CAST(p AS DOUBLE), 4) AS tpr, round(fp / CAST(n AS DOUBLE), 4) AS fpr, round(tp / CAST(p AS DOUBLE) - fp / CAST(n AS DOUBLE), 4) AS youden FROM c""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.threshold_sweep(matches(spark, sf_dir), [k / 10 for k in range(1, 10)], [k / 2 for k in range(1, 4)]))


@query("""WITH c AS (SELECT r / 10e0 AS min_confidence, s / 2e0 AS max_sigma, count(*) FILTER (label AND confidence >= r / 10e0 AND sigma_major <= s / 2e0) / CAST(count(*) FILTER (label) AS DOUBLE) AS tpr,
        count(*) FILTER (NOT label AND confidence >= r / 10e0 AND sigma_major <= s / 2e0) / CAST(count(*) FILTER (NOT label) AS DOUBLE) AS fpr FROM {v_matches}, range(1, 10) AS a(r), range(1, 4) AS b(s) GROUP BY r, s)
    SELECT min_confidence, max_sigma, round(tpr, 4) AS tpr, round(fpr, 4) AS fpr FROM c ORDER BY tpr - fpr DESC, tpr DESC, fpr, min_confidence, max_sigma LIMIT 1""")
def best_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = experiments.threshold_sweep(matches(spark, sf_dir), [k / 10 for k in range(1, 10)], [k / 2 for k in range(1, 4)])
    return rounded(experiments.best_point(swept).select("min_confidence", "max_sigma", "tpr", "fpr"))


@query("""WITH c AS (SELECT r, count(*) FILTER (label AND confidence >= r / 10e0) / CAST(count(*) FILTER (label) AS DOUBLE) AS tpr, count(*) FILTER (NOT label AND confidence >= r / 10e0) / CAST(count(*) FILTER (NOT label) AS DOUBLE) AS fpr
        FROM {v_matches}, range(1, 10) AS a(r) GROUP BY r),
    p AS (SELECT DISTINCT round(fpr, 4) AS x, round(tpr, 4) AS y FROM c UNION SELECT 0e0, 0e0 UNION SELECT 1e0, 1e0), l AS (SELECT x, y, lag(x) OVER (ORDER BY x, y) AS px, lag(y) OVER (ORDER BY x, y) AS py FROM p)
    SELECT round(sum((x - px) * (y + py) / 2), 4) AS auc, count(*) AS points FROM l""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.roc_auc(experiments.threshold_sweep(matches(spark, sf_dir), [k / 10 for k in range(1, 10)], [100.0])))


@query("""WITH c AS (SELECT pair_id, count(*) FILTER (confidence > 0.5 AND NOT sigma_major < 0.65) AS b, count(*) FILTER (NOT confidence > 0.5 AND sigma_major < 0.65) AS c FROM {v_matches} GROUP BY pair_id),
    t AS (SELECT pair_id, sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) AS s FROM c, range(0, 100000) AS g(k) WHERE k <= least(b, c) GROUP BY pair_id)
    SELECT c.pair_id, b, c, b + c AS discordant, CASE WHEN b + c = 0 THEN 1e0 ELSE round(least(1e0, 2 * s), 6) END AS p_value FROM c JOIN t ON c.pair_id = t.pair_id""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = matches(spark, sf_dir).selectExpr("pair_id", "confidence > 0.5 AS x", "sigma_major < 0.65 AS y")
    return rounded(experiments.mcnemar(a, "x", "y", "pair_id"), 6)


ARMS = """WITH w AS (SELECT domain, pair_id * 100000 + match_id AS k, confidence > 0.3 AS s1, sigma_minor < 0.3 AS s2, error AS e1, error + CASE domain WHEN 'same' THEN -0.01 ELSE 0.01 END AS e2 FROM {v_residuals}),
    b AS (SELECT domain AS slice, * FROM w UNION ALL SELECT NULL, * FROM w),
    t AS (SELECT slice, count(*) AS n, count(*) FILTER (s1) AS successes_base, count(*) FILTER (s2) AS successes_new, quantile_cont(e1, 0.5) AS m1, quantile_cont(e2, 0.5) AS m2, count(*) FILTER (s1 AND NOT s2) AS b, count(*) FILTER (NOT s1 AND s2) AS c FROM b GROUP BY slice)
    SELECT slice AS domain, n, successes_base, successes_new, round(m1, 4) AS median_error_base, round(m2, 4) AS median_error_new, CASE WHEN m2 < m1 - 1e-9 THEN 'IMPROVED' WHEN m2 > m1 + 1e-9 THEN 'WORSENED' ELSE 'UNCHANGED' END AS verdict_error, b, c, b + c AS discordant FROM t"""


@query(ARMS)
def compare_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "v_residuals")
    base = r.selectExpr("domain", "pair_id * 100000 + match_id AS k", "'base' AS arm", "confidence > 0.3 AS success", "error")
    new = r.selectExpr("domain", "pair_id * 100000 + match_id AS k", "'new' AS arm", "sigma_minor < 0.3 AS success", "error + CASE domain WHEN 'same' THEN -0.01e0 ELSE 0.01e0 END AS error")
    return rounded(experiments.compare_arms(base.union(new), {"error": "lower"}, "domain", "k").drop("p_value"))


@query("""WITH v AS (SELECT confidence AS v, domain, label FROM {v_matches}), c AS (SELECT v, count(*) FILTER (domain = 'same') AS a, count(*) FILTER (domain <> 'same') AS b FROM v GROUP BY v),
    s AS (SELECT sum(a) OVER (ORDER BY v) / CAST(sum(a) OVER () AS DOUBLE) AS f, sum(b) OVER (ORDER BY v) / CAST(sum(b) OVER () AS DOUBLE) AS g FROM c),
    m AS (SELECT count(*) FILTER (domain = 'same') AS n_a, count(*) FILTER (domain <> 'same') AS n_b, avg(v) FILTER (domain = 'same') AS ma, avg(v) FILTER (domain <> 'same') AS mb, stddev_pop(v) FILTER (domain = 'same') AS sa, stddev_pop(v) FILTER (domain <> 'same') AS sb,
        avg(CASE WHEN label THEN 1e0 ELSE 0 END) FILTER (domain = 'same') AS pa, avg(CASE WHEN label THEN 1e0 ELSE 0 END) FILTER (domain <> 'same') AS pb FROM v)
    SELECT round((SELECT max(abs(f - g)) FROM s), 6) AS d, n_a, n_b, round(ma, 6) AS mean_a, round(sa, 6) AS std_a, round(mb, 6) AS mean_b, round(sb, 6) AS std_b, round(pa, 6) AS prevalence_a, round(pb, 6) AS prevalence_b FROM m""")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.ks_two_sample(matches(spark, sf_dir), "confidence", F.col("domain") == "same", "label").drop("p_value"), 6)


@query("""WITH v AS (SELECT pair_id, confidence AS v, row_number() OVER (PARTITION BY pair_id ORDER BY match_id) - 1 AS place, count(*) OVER (PARTITION BY pair_id) AS n FROM {v_matches}),
    r AS (SELECT a.pair_id, r, avg(b.v) AS m FROM v AS a, range(1000) AS g(r), v AS b WHERE a.pair_id = b.pair_id AND b.place = (104729*r + 7919*a.place + 15485863*(((r + 1)*(a.place + 3)) % 10007) + 31*a.pair_id) % a.n GROUP BY a.pair_id, r)
    SELECT pair_id, round(quantile_cont(m, 0.025), 10) AS low, round(quantile_cont(m, 0.975), 10) AS high FROM r GROUP BY pair_id""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.bootstrap_ci(matches(spark, sf_dir), "confidence", 1000).select("pair_id", "low", "high"), 10)


@query("""WITH s AS (SELECT pair_id, rank() OVER (PARTITION BY pair_id ORDER BY confidence DESC) AS r1, rank() OVER (PARTITION BY pair_id ORDER BY sigma_major) AS r2, match_id FROM {v_matches})
    SELECT count(*) AS surfaces, round(quantile_cont(r1, 0.5), 4) AS median_a, round(avg(r1), 4) AS mean_a, round(avg(CASE WHEN r1 <= 10 THEN 1e0 ELSE 0 END), 4) AS recall_10_a,
        round(quantile_cont(r2, 0.5), 4) AS median_b, round(avg(r2), 4) AS mean_b, round(avg(CASE WHEN r2 <= 10 THEN 1e0 ELSE 0 END), 4) AS recall_10_b FROM s WHERE match_id = 7""")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = experiments.rank_metrics(matches(spark, sf_dir), "pair_id", {"a": F.col("confidence").desc(), "b": F.col("sigma_major").asc()}, F.col("match_id") == 7)
    return rounded(found.select("surfaces", "median_a", "mean_a", "recall_10_a", "median_b", "mean_b", "recall_10_b"))


@query("""SELECT domain, count(*) AS keypoints, count(*) FILTER (confidence >= 0.2) AS retained_1, count(*) FILTER (confidence >= 0.2 AND sigma_major <= 0.8) AS retained_2,
    round(avg(CASE WHEN error <= 1 THEN 1e0 ELSE 0 END), 4) AS recall_1, round(avg(CASE WHEN error <= 3 THEN 1e0 ELSE 0 END), 4) AS recall_3,
    round(avg(CASE WHEN error <= 4 THEN 1e0 ELSE 0 END) FILTER (confidence >= 0.2 AND sigma_major <= 0.8), 4) AS precision_4 FROM {v_residuals} GROUP BY domain""")
def candidate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [F.col("confidence") >= 0.2, F.col("sigma_major") <= 0.8]
    found = experiments.candidate_funnel(view(spark, sf_dir, "v_residuals"), stages)
    return rounded(found.select("domain", "keypoints", "retained_1", "retained_2", "recall_1", "recall_3", "precision_4"))


@query(f"""WITH {LIGHT}, {COLOR} SELECT count(*) AS total, count(*) FILTER (inliers >= 4) AS successes, round(avg(CASE WHEN inliers >= 4 THEN 1e0 ELSE 0 END), 4) AS success_rate, round(avg(held_out), 4) AS avg_held_out,
    round(avg(ssim), 4) AS avg_ssim, count(*) FILTER (color = 'GREEN') AS green, count(*) FILTER (color = 'YELLOW') AS yellow, count(*) FILTER (color = 'RED') AS red, count(*) FILTER (color IS NULL) AS unknown FROM l""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.evaluation_summary(quality.traffic_light(metrics(spark, sf_dir))))


@query(f"""WITH {LIGHT}, t AS (SELECT *, pair_id % 8 AS region, {TIERS} AS tier FROM q)
    SELECT region, count(*) AS legs, count(*) FILTER (tier <> 'FAILED') AS successes, round(avg(fit_rmse), 4) AS mean_rmse, round(avg(CASE WHEN pair_id % 5 <> 0 THEN inliers * 0.25e0 END), 4) AS mean_runtime, count(*) FILTER (tier IN ('HIGH_CONFIDENCE', 'ACCEPTED')) AS high_or_accepted,
        round(avg(CASE WHEN tier IN ('HIGH_CONFIDENCE', 'ACCEPTED') THEN 1e0 ELSE 0 END), 4) AS trust_rate, count(DISTINCT CASE WHEN tier IN ('HIGH_CONFIDENCE', 'ACCEPTED') THEN pair_id % 16 END) AS datasets,
        round(min(held_out), 4) AS least_gap, round(max(held_out), 4) AS most_gap FROM t GROUP BY region""")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = quality.quality_tier(F.col("inliers"), F.col("inlier_ratio"), F.col("held_out"), F.lit(True))
    m = metrics(spark, sf_dir).withColumn("tier", tier).selectExpr("*", "pair_id % 8 AS region", "pair_id % 16 AS dataset", "held_out AS sun_gap", "CASE WHEN pair_id % 5 <> 0 THEN inliers * 0.25e0 END AS runtime_s")
    return rounded(experiments.region_rollup(m))
