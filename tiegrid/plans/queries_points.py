"""Queries over matches, transforms and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegrid.functions.algebra import affine
from tiegrid.operators import fit, points, quality
from tiegrid.plans.registry import query
from tiegrid.plans.views import view


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a fixed number of digits, so that the order of a sum doesn't show; -0 becomes 0."""
    return df.select(*(F.round(F.col(c), digits).alias(c) + 0.0 if t == "double" else F.col(c) for c, t in df.dtypes)).toDF(*df.columns)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_matches")


def inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).filter("label")


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.fit_affine(inliers(spark, sf_dir))


SUMMARY = """
    SELECT pair_id, count(*) AS n, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(error), 4) AS mean,
        round(quantile_cont(error, 0.5), 4) AS median, round(max(error), 4) AS max, round(avg(CASE WHEN error < 1 THEN 1e0 ELSE 0e0 END), 4) AS below_1,
        round(avg(CASE WHEN error < 0.5 THEN 1e0 ELSE 0e0 END), 4) AS below_05, round(avg(CASE WHEN error < 0.25 THEN 1e0 ELSE 0e0 END), 4) AS below_025
    FROM {v_residuals} WHERE label GROUP BY pair_id"""
TIER = """CASE WHEN n < 4 THEN 'FAILED' WHEN n >= 15 AND coverage >= 0.15 AND rmse < 2 THEN 'HIGH_CONFIDENCE'
    WHEN n >= 10 AND coverage >= 0.10 THEN 'ACCEPTED' ELSE 'LOW_CONFIDENCE' END"""
COVER = """SELECT pair_id, count(*) / 64e0 AS coverage FROM (SELECT DISTINCT pair_id, least(7, greatest(0, floor(source_x / 64e0))) AS gx,
    least(7, greatest(0, floor(source_y / 64e0))) AS gy FROM {v_matches} WHERE label) AS c GROUP BY pair_id"""


@query(f"WITH s AS ({SUMMARY}), c AS ({COVER}) SELECT s.*, round(coverage, 4) AS coverage, {TIER} AS quality_tier FROM s JOIN c USING (pair_id)")
def residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(points.residual_summary(inliers(spark, sf_dir), transforms(spark, sf_dir)))
    covered = rounded(quality.coverage(inliers(spark, sf_dir), 512.0, 512.0, 8))
    tier = quality.quality_tier(F.col("n"), F.col("coverage"), F.col("rmse"), F.lit(True))
    return found.join(covered, "pair_id").withColumn("quality_tier", tier)


@query("SELECT pair_id, n, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, round(d, 4) AS d, round(e, 4) AS e, round(f, 4) AS f FROM {v_transforms}")
def fit_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    return rounded(transforms(spark, sf_dir).select("pair_id", "n", *(h[k].alias(n) for n, k in zip("abcdef", range(6), strict=True))))


@query("SELECT pair_id, match_id, round(a * source_x + b * source_y + c, 4) AS px, round(d * source_x + e * source_y + f, 4) AS py, round(error, 4) AS error FROM {v_residuals}")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points.project(matches(spark, sf_dir).join(transforms(spark, sf_dir).select("pair_id", "h"), "pair_id"))
    return rounded(found.select("pair_id", "match_id", "px", "py", "error"))


AXES = """SELECT *, radians(angle) AS t, sigma_major * sigma_major AS big, sigma_minor * sigma_minor AS small FROM {v_residuals}"""


@query("""
    SELECT pair_id, match_id, round(big * cos(t) * cos(t) + small * sin(t) * sin(t), 9) AS cxx, round((big - small) * sin(t) * cos(t), 9) AS cxy,
        round(big * sin(t) * sin(t) + small * cos(t) * cos(t), 9) AS cyy, round(sqrt(big), 9) AS axis_major, round(sqrt(small), 9) AS axis_minor,
        round(sqrt(big) / sqrt(small), 9) AS anisotropy, round(big + small, 9) AS trace, sqrt(big) / sqrt(small) >= 2 AND sqrt(small) <= 0.6 AS is_elongated,
        sqrt(big) / sqrt(small) < 2 AND sqrt(big) <= 1.2 AS is_isotropic, sqrt(small) > 0.8 OR (sqrt(big) > 1.8 AND NOT (sqrt(big) / sqrt(small) >= 2 AND sqrt(small) <= 0.6)) AS is_uncertain
    FROM (SELECT pair_id, match_id, radians(angle) AS t, pow(greatest(4 * sigma_major + 0.013, 1e-3), 2) AS big, pow(greatest(least(3 * sigma_minor, 4 * sigma_major + 0.013), 1e-3), 2) AS small FROM {v_matches}) AS m""")
def covariance_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Wider axes than those of the matches, so that every flag occurs.
    m = matches(spark, sf_dir).selectExpr("pair_id", "match_id", "4 * sigma_major + 0.013e0 AS sigma_major", "3 * sigma_minor AS sigma_minor", "angle")
    found = points.covariance_axes(m)
    return rounded(found.drop("sigma_major", "sigma_minor", "angle", "axis_angle"), 9)


@query("""SELECT pair_id, match_id, round(confidence / (1 + 0.5 * pow(sigma_major, 0.7) * pow(greatest(sigma_minor, 1e-3), 0.5)) * (1 + 0.6 / (1 + 2 * greatest(sigma_minor, 1e-3))), 4) AS rank_score
    FROM {v_matches}""")
def score_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.score_covariance(matches(spark, sf_dir)).select("pair_id", "match_id", "rank_score"))


WHITE = f"""
    w1 AS (SELECT *, least(greatest(big, 1e-4), 100e0) AS cb FROM ({AXES}) AS q), w2 AS (SELECT *, greatest(least(greatest(small, 1e-4), 100e0), cb / 1e4) AS cs FROM w1),
    w3 AS (SELECT *, cb * cos(t) * cos(t) + cs * sin(t) * sin(t) AS xx, (cb - cs) * sin(t) * cos(t) AS xy, cb * sin(t) * sin(t) + cs * cos(t) * cos(t) AS yy FROM w2),
    w4 AS (SELECT *, a*a*xx + 2*a*b*xy + b*b*yy + xx AS rxx, a*d*xx + (a*e + b*d)*xy + b*e*yy + xy AS rxy, d*d*xx + 2*d*e*xy + e*e*yy + yy AS ryy,
        a*source_x + b*source_y + c - target_x AS rx, d*source_x + e*source_y + f - target_y AS ry FROM w3),
    w AS (SELECT *, sqrt(greatest((ryy*rx*rx - 2*rxy*rx*ry + rxx*ry*ry) / (rxx*ryy - rxy*rxy), 0e0)) AS distance FROM w4)"""


@query(f"WITH {WHITE} SELECT pair_id, match_id, round(error, 4) AS error, round(distance, 4) AS distance FROM w")
def whiten_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.whiten(matches(spark, sf_dir), transforms(spark, sf_dir)).select("pair_id", "match_id", "error", "distance"))


@query(f"WITH {WHITE} SELECT pair_id, count(*) AS n, round(sqrt(avg(error*error)), 4) AS rmse_px, round(sqrt(avg(distance*distance)), 4) AS rmse_whitened FROM w WHERE label GROUP BY pair_id")
def dual_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.dual_rmse(inliers(spark, sf_dir), transforms(spark, sf_dir)))


@query("""SELECT pair_id, count(*) AS n, round(sqrt(avg(pow((a*source_x + b*source_y + c - target_x) * 5, 2) + pow((d*source_x + e*source_y + f - target_y) * 4.5, 2))), 4) AS rmse_m
    FROM {v_residuals} WHERE label GROUP BY pair_id""")
def absolute_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.absolute_rmse(inliers(spark, sf_dir), transforms(spark, sf_dir), 5.0, 4.5))


@query(f"""WITH {WHITE} SELECT pair_id, count(*) AS n, round(sqrt(avg(error*error)), 4) AS rmse_px, round(avg(error), 4) AS mean_px, round(quantile_cont(error, 0.5), 4) AS median_px,
    round(quantile_cont(error, 0.95), 4) AS p95_px, round(max(error), 4) AS max_px, round(sqrt(avg(error*error)) * 5, 4) AS rmse_m, round(avg(distance), 4) AS mean_distance,
    round(avg(CASE WHEN distance <= 1 THEN 1e0 ELSE 0 END), 4) AS within_1, round(avg(CASE WHEN distance <= 2 THEN 1e0 ELSE 0 END), 4) AS within_2,
    round(avg(CASE WHEN distance <= 3 THEN 1e0 ELSE 0 END), 4) AS within_3, round(avg(CASE WHEN distance <= 2.4477 THEN 1e0 ELSE 0 END), 4) AS within_95
    FROM w WHERE label AND match_id % 5 = 0 GROUP BY pair_id""")
def checkpoint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.checkpoint_metrics(inliers(spark, sf_dir).filter("match_id % 5 = 0"), transforms(spark, sf_dir), 5.0))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = (F.lit(x) for x in (1.01, -0.02, 3.0, 0.015, 0.99, -2.0))
    return transforms(spark, sf_dir).select("pair_id").withColumn("h", affine(*six))


CORNERS = "(VALUES (0e0, 0e0), (512e0, 0e0), (512e0, 512e0), (0e0, 512e0)) AS p(x, y)"


@query(f"""SELECT pair_id, round(avg(sqrt(pow(a*x + b*y + c - (1.01*x - 0.02*y + 3), 2) + pow(d*x + e*y + f - (0.015*x + 0.99*y - 2), 2))), 4) AS corner_error
    FROM {{v_transforms}}, {CORNERS} GROUP BY pair_id""")
def corner_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.corner_error(transforms(spark, sf_dir), truth(spark, sf_dir), 512.0, 512.0))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs 3k, 3k + 1 and 3k + 2 as the legs of triplet k, the third turned back; some legs missing."""
    t = transforms(spark, sf_dir)
    h = F.col("h")
    det = h[0] * h[4] - h[1] * h[3]
    back = affine(h[4] / det, -h[1] / det, (h[1] * h[5] - h[2] * h[4]) / det, -h[3] / det, h[0] / det, (h[2] * h[3] - h[0] * h[5]) / det)
    leg = F.element_at(F.array(F.lit("AB"), F.lit("BC"), F.lit("CA")), (F.col("pair_id") % 3 + 1).cast("int"))
    return t.filter("pair_id % 10 <> 3").select(F.floor(F.col("pair_id") / 3).alias("triplet_id"), leg.alias("leg"), F.when(F.col("pair_id") % 3 == 2, back).otherwise(h).alias("h"))


LEGS = """
    l AS (SELECT CAST(floor(pair_id / 3e0) AS BIGINT) AS triplet_id, pair_id % 3 AS leg, a, b, c, d, e, f, a*e - b*d AS det FROM {v_transforms} WHERE pair_id % 10 <> 3),
    g AS (SELECT triplet_id, leg, CASE WHEN leg = 2 THEN e/det ELSE a END AS a, CASE WHEN leg = 2 THEN -b/det ELSE b END AS b, CASE WHEN leg = 2 THEN (b*f - c*e)/det ELSE c END AS c,
        CASE WHEN leg = 2 THEN -d/det ELSE d END AS d, CASE WHEN leg = 2 THEN a/det ELSE e END AS e, CASE WHEN leg = 2 THEN (c*d - a*f)/det ELSE f END AS f FROM l),
    n AS (SELECT triplet_id, count(*) AS have FROM g GROUP BY triplet_id),
    grid AS (SELECT (0.15 + 0.7 * i / 9e0) * 512 AS x0, (0.15 + 0.7 * j / 9e0) * 512 AS y0 FROM range(10) AS r(i), range(10) AS s(j)),
    loop AS (SELECT n.triplet_id, x0, y0, p.a*x0 + p.b*y0 + p.c AS x1, p.d*x0 + p.e*y0 + p.f AS y1 FROM n JOIN g AS p ON p.triplet_id = n.triplet_id AND p.leg = 0, grid WHERE have = 3),
    loop2 AS (SELECT q.triplet_id, x0, y0, q.a*x1 + q.b*y1 + q.c AS x2, q.d*x1 + q.e*y1 + q.f AS y2 FROM loop JOIN g AS q ON q.triplet_id = loop.triplet_id AND q.leg = 1),
    loop3 AS (SELECT q.triplet_id, sqrt(pow(q.a*x2 + q.b*y2 + q.c - x0, 2) + pow(q.d*x2 + q.e*y2 + q.f - y0, 2)) AS away FROM loop2 JOIN g AS q ON q.triplet_id = loop2.triplet_id AND q.leg = 2),
    r AS (SELECT triplet_id, sqrt(avg(away*away)) AS rmse, avg(away) AS mean FROM loop3 GROUP BY triplet_id)"""


@query(f"""WITH {LEGS} SELECT n.triplet_id, round(rmse, 4) AS rmse, round(mean, 4) AS mean, rmse < 5 AS is_closed,
    CASE WHEN have = 3 THEN 'ok' WHEN have = 2 THEN 'composed' ELSE 'cycle_not_computable' END AS status FROM n LEFT JOIN r USING (triplet_id)""")
def cycle_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points.cycle_consistency(legs(spark, sf_dir), 512.0, 512.0))


@query(f"""WITH {LEGS}, bc AS (SELECT p.triplet_id, p.a*q.a + p.b*q.d AS a, p.a*q.b + p.b*q.e AS b, p.a*q.c + p.b*q.f + p.c AS c, p.d*q.a + p.e*q.d AS d, p.d*q.b + p.e*q.e AS e, p.d*q.c + p.e*q.f + p.f AS f,
        3 - p.leg - q.leg AS missing FROM g AS p JOIN g AS q ON p.triplet_id = q.triplet_id AND p.leg = (q.leg + 1) % 3 JOIN n ON n.triplet_id = p.triplet_id AND have = 2),
    inv AS (SELECT triplet_id, missing, e/(a*e - b*d) AS a, (b*f - c*e)/(a*e - b*d) AS c, a/(a*e - b*d) AS e, (c*d - a*f)/(a*e - b*d) AS f FROM bc),
    every AS (SELECT triplet_id, leg, a, c, e, f FROM g UNION ALL SELECT triplet_id, missing, a, c, e, f FROM inv)
    SELECT n.triplet_id, round(max(CASE WHEN leg = 0 THEN c END), 4) AS ab_c, round(max(CASE WHEN leg = 1 THEN c END), 4) AS bc_c, round(max(CASE WHEN leg = 2 THEN f END), 4) AS ca_f,
        max(CASE WHEN have = 2 THEN CASE missing WHEN 0 THEN 'AB' WHEN 1 THEN 'BC' ELSE 'CA' END END) AS composed,
        max(CASE WHEN have = 3 THEN 'measured' WHEN have = 2 THEN 'composed' ELSE 'cycle_not_computable' END) AS status
    FROM n LEFT JOIN every USING (triplet_id) LEFT JOIN (SELECT triplet_id AS tid, missing FROM inv) AS i ON i.tid = n.triplet_id GROUP BY n.triplet_id""")
def complete_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = points.complete_cycle(legs(spark, sf_dir))
    return rounded(done.select("triplet_id", F.col("ab")[2].alias("ab_c"), F.col("bc")[2].alias("bc_c"), F.col("ca")[5].alias("ca_f"), "composed", "status"))


XYZ = """SELECT pair_id, (1737400 + a1) AS r1, radians(source_y / 10) AS p1, radians(source_x / 10) AS q1, (1737400 + a2) AS r2, radians(source_y / 10 + (target_x - source_x) / 1e5) AS p2,
    radians(source_x / 10 + (target_y - source_y) / 1e5) AS q2, abs(a1 - a2) AS up FROM (SELECT *, confidence * 1000 AS a1, confidence * 1000 + sigma_major * 10 AS a2 FROM {v_matches}) AS m"""


@query(f"""WITH v AS ({XYZ}), d AS (SELECT pair_id, up, sqrt(pow(r1*cos(p1)*cos(q1) - r2*cos(p2)*cos(q2), 2) + pow(r1*cos(p1)*sin(q1) - r2*cos(p2)*sin(q2), 2) + pow(r1*sin(p1) - r2*sin(p2), 2)) AS d FROM v)
    SELECT pair_id, count(d) AS n, CAST(0 AS BIGINT) AS dropped, round(sqrt(avg(d*d)), 3) AS rmse, round(avg(d), 3) AS mean, round(max(d), 3) AS max,
        round(quantile_cont(d, 0.9), 3) AS ce90, round(quantile_cont(up, 0.9), 3) AS le90 FROM d GROUP BY pair_id""")
def intersection_error_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).selectExpr(
        "pair_id", "source_y / 10 AS lat", "source_x / 10 AS lon", "confidence * 1000 AS alt", "source_y / 10 + (target_x - source_x) / 1e5 AS lat2",
        "source_x / 10 + (target_y - source_y) / 1e5 AS lon2", "confidence * 1000 + sigma_major * 10 AS alt2",
    )
    return rounded(points.intersection_error(m), 3)


MOMENTS = """sum(source_x) AS sx, sum(source_y) AS sy, sum(target_x) AS su, sum(target_y) AS sv, sum(source_x*source_x) AS sxx, sum(source_x*source_y) AS sxy, sum(source_y*source_y) AS syy,
    sum(source_x*target_x) AS sxu, sum(source_y*target_x) AS syu, sum(source_x*target_y) AS sxv, sum(source_y*target_y) AS syv"""
SOLVE = """(sxx/w - sx/w*sx/w) AS xx, (sxy/w - sx/w*sy/w) AS xy, (syy/w - sy/w*sy/w) AS yy, (sxu/w - sx/w*su/w) AS xu, (syu/w - sy/w*su/w) AS yu, (sxv/w - sx/w*sv/w) AS xv, (syv/w - sy/w*sv/w) AS yv"""
SIX = "(xu*yy - yu*xy)/(xx*yy - xy*xy) AS a, (yu*xx - xu*xy)/(xx*yy - xy*xy) AS b, (xv*yy - yv*xy)/(xx*yy - xy*xy) AS d, (yv*xx - xv*xy)/(xx*yy - xy*xy) AS e"


@query(f"""WITH m AS (SELECT *, CAST(n AS DOUBLE) AS w FROM (SELECT *, count(*) OVER (PARTITION BY pair_id) AS gn, row_number() OVER (PARTITION BY pair_id ORDER BY (match_id * 7919) % 10007, match_id) AS k,
        count(*) OVER (PARTITION BY pair_id) AS n FROM {{v_matches}} WHERE label) AS q),
    s AS (SELECT *, k <= greatest(1, floor(gn / 5)) AS held FROM m WHERE gn >= 8),
    t AS (SELECT pair_id, count(*) AS n_train, CAST(count(*) AS DOUBLE) AS w, {MOMENTS} FROM s WHERE NOT held GROUP BY pair_id),
    u AS (SELECT *, {SOLVE} FROM t), x AS (SELECT *, {SIX} FROM u),
    y AS (SELECT x.pair_id, n_train, sqrt(pow(a*source_x + b*source_y + su/x.w - a*sx/x.w - b*sy/x.w - target_x, 2) + pow(d*source_x + e*source_y + sv/x.w - d*sx/x.w - e*sy/x.w - target_y, 2)) AS error
        FROM x JOIN s ON x.pair_id = s.pair_id AND held)
    SELECT pair_id, n_train, count(*) AS n_test, round(sqrt(avg(error*error)), 4) AS rmse, round(quantile_cont(error, 0.5), 4) AS median FROM y GROUP BY pair_id, n_train""")
def holdout_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit.holdout_validation(inliers(spark, sf_dir)))


@query(f"""WITH m AS (SELECT pair_id, source_x AS x, source_y AS y, target_x AS u, target_y AS v FROM {{v_matches}} WHERE label),
    t AS (SELECT pair_id, count(*) AS n, sum(x) AS tx, sum(y) AS ty, sum(u) AS tu, sum(v) AS tv, sum(x*x) AS txx, sum(x*y) AS txy, sum(y*y) AS tyy, sum(x*u) AS txu, sum(y*u) AS tyu, sum(x*v) AS txv, sum(y*v) AS tyv
        FROM m GROUP BY pair_id HAVING count(*) >= 4),
    s AS (SELECT m.*, n, n - 1e0 AS w, tx-x AS sx, ty-y AS sy, tu-u AS su, tv-v AS sv, txx-x*x AS sxx, txy-x*y AS sxy, tyy-y*y AS syy, txu-x*u AS sxu, tyu-y*u AS syu, txv-x*v AS sxv, tyv-y*v AS syv FROM m JOIN t USING (pair_id)),
    q AS (SELECT *, {SOLVE} FROM s), r AS (SELECT *, {SIX} FROM q),
    z AS (SELECT pair_id, n, sqrt(pow(a*(x - sx/w) + b*(y - sy/w) + su/w - u, 2) + pow(d*(x - sx/w) + e*(y - sy/w) + sv/w - v, 2)) AS error FROM r)
    SELECT pair_id, n, round(sqrt(avg(error*error)), 4) AS rmse, round(quantile_cont(error, 0.5), 4) AS median, round(quantile_cont(error, 0.95), 4) AS p95, 'ok' AS status FROM z GROUP BY pair_id, n""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit.leave_one_out(inliers(spark, sf_dir)))


@query(f"""WITH m AS (SELECT pair_id, source_x, source_y, target_x, target_y, row_number() OVER (PARTITION BY pair_id ORDER BY match_id) - 1 AS place, count(*) OVER (PARTITION BY pair_id) AS n FROM {{v_matches}} WHERE label),
    dr AS (SELECT pair_id, r, (104729*r + 7919*place + 15485863*(((r + 1)*(place + 3)) % 10007) + 31*pair_id) % n AS place FROM m, range(20) AS g(r)),
    p AS (SELECT dr.pair_id, r, count(*) AS cnt, CAST(count(*) AS DOUBLE) AS w, {MOMENTS} FROM dr JOIN m ON m.pair_id = dr.pair_id AND m.place = dr.place GROUP BY dr.pair_id, r HAVING count(DISTINCT dr.place) >= 3),
    q AS (SELECT *, {SOLVE} FROM p), r0 AS (SELECT *, {SIX} FROM q WHERE xx*yy - xy*xy > 1e-12), h AS (SELECT pair_id, a, b, d, e, su/w - a*sx/w - b*sy/w AS c, sv/w - d*sx/w - e*sy/w AS f FROM r0),
    sc AS (SELECT m.pair_id, m.place, sqrt(var_pop(a * source_x + b * source_y + c) + var_pop(d * source_x + e * source_y + f)) AS s FROM m JOIN h ON h.pair_id = m.pair_id GROUP BY m.pair_id, m.place), sg AS (SELECT pair_id, avg(s) AS sigma FROM sc GROUP BY pair_id)
    SELECT h.pair_id, count(*) AS fits, round(stddev_samp(c), 4) AS sd_c, round(stddev_samp(f), 4) AS sd_f, round(covar_samp(c, f), 4) + 0e0 AS cov_cf, round(any_value(sigma), 4) AS sigma_px, round(any_value(sigma) * 5, 4) AS sigma_m,
        round(covar_samp(a, e) * 1e6, 4) + 0e0 AS cov_ae, 'ok' AS status FROM h JOIN sg ON sg.pair_id = h.pair_id GROUP BY h.pair_id""")
def bootstrap_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit.bootstrap_transform(inliers(spark, sf_dir), 20, gsd=5.0)
    return rounded(found.withColumn("cov_ae", F.col("covariance")[4] * 1e6).drop("covariance"))


CONSENSUS = f"""
    m AS (SELECT *, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY match_id) - 1 AS BIGINT) AS place FROM {{v_matches}}),
    z AS (SELECT pair_id, count(*) AS n FROM m GROUP BY pair_id), b AS (SELECT pair_id, n, hyp, j, ((hyp + 1)*7919 + (j + 1)*104729 + 31*pair_id) % 10007 AS q FROM z, range(32) AS g(hyp), range(3) AS i(j)),
    dr AS (SELECT DISTINCT pair_id, hyp, ((q*q*(hyp + 3) + 15485863*(j + 1)) % 1000003) % n AS place FROM b),
    v AS (SELECT dr.pair_id, hyp, count(*) AS n, avg(source_x) AS mx, avg(source_y) AS my, avg(target_x) AS mu, avg(target_y) AS mv, var_pop(source_x) AS xx, var_pop(source_y) AS yy, covar_pop(source_x, source_y) AS xy,
        covar_pop(source_x, target_x) AS xu, covar_pop(source_y, target_x) AS yu, covar_pop(source_x, target_y) AS xv, covar_pop(source_y, target_y) AS yv
        FROM dr JOIN m ON m.pair_id = dr.pair_id AND m.place = dr.place GROUP BY dr.pair_id, hyp),
    h AS (SELECT pair_id, hyp, a, b, mu - a*mx - b*my AS c, d, e, mv - d*mx - e*my AS f FROM (SELECT *, {SIX} FROM v WHERE n = 3 AND xx*yy - xy*xy > 1e-12) AS q),
    sc AS (SELECT m.*, h.hyp, sqrt(pow(a*source_x + b*source_y + c - target_x, 2) + pow(d*source_x + e*source_y + f - target_y, 2)) <= 5 AS inside FROM m JOIN h ON m.pair_id = h.pair_id),
    ct AS (SELECT pair_id, hyp, count(*) AS n, count(*) FILTER (inside) AS inliers FROM sc GROUP BY pair_id, hyp),
    best AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY inliers DESC, hyp) = 1),
    kept AS (SELECT sc.* FROM sc JOIN best ON sc.pair_id = best.pair_id AND sc.hyp = best.hyp WHERE inside),
    rf AS (SELECT pair_id, avg(source_x) AS mx, avg(source_y) AS my, avg(target_x) AS mu, avg(target_y) AS mv, var_pop(source_x) AS xx, var_pop(source_y) AS yy, covar_pop(source_x, source_y) AS xy,
        covar_pop(source_x, target_x) AS xu, covar_pop(source_y, target_x) AS yu, covar_pop(source_x, target_y) AS xv, covar_pop(source_y, target_y) AS yv FROM kept GROUP BY pair_id),
    fin AS (SELECT pair_id, a, b, mu - a*mx - b*my AS c, d, e, mv - d*mx - e*my AS f FROM (SELECT *, {SIX} FROM rf) AS q)"""


@query(f"WITH {CONSENSUS} SELECT best.pair_id, hyp, n, inliers, round(a, 4) AS a, round(c, 4) AS c, round(e, 4) AS e, round(f, 4) AS f FROM best JOIN fin USING (pair_id)")
def consensus_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit.consensus_fit(matches(spark, sf_dir), 5.0, 32)
    h = F.col("h")
    return rounded(found.select("pair_id", "hyp", "n", "inliers", h[0].alias("a"), h[2].alias("c"), h[4].alias("e"), h[5].alias("f")))
