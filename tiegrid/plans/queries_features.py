"""Queries over feature tables, classifiers and job events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiegrid.operators import features, points
from tiegrid.plans.queries_points import matches, rounded, transforms
from tiegrid.plans.registry import query
from tiegrid.plans.views import view
from tiegrid.plans.work import materialize
from tiegrid.streaming import jobs


def few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir)


@query("""WITH r AS (SELECT pair_id, match_id, CASE match_id % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'outlier' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' ELSE NULL END AS g, CASE match_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'n' END AS h, label AS c FROM {v_matches}),
    t AS (SELECT *, CASE WHEN g IN ('yes', '1') THEN true WHEN g = 'outlier' THEN false END AS gt, CASE h WHEN 'true' THEN true WHEN 'n' THEN false END AS ht FROM r)
    SELECT pair_id, match_id, coalesce(gt, ht, c) AS truth, CASE WHEN gt IS NOT NULL THEN 'synthetic_geometry' WHEN ht IS NOT NULL THEN 'hand' ELSE 'ransac' END AS truth_source FROM t""")
def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).selectExpr(
        "pair_id", "match_id", "CASE match_id % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'outlier' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' ELSE NULL END AS ground_truth_label",
        "CASE match_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'n' END AS human_label", "label",
    )
    return features.label_matches(m, True).select("pair_id", "match_id", "truth", "truth_source")


@query("SELECT pair_id, match_id, error <= 2 AS truth FROM {v_residuals} WHERE error <= 2 OR error >= 5")
def label_by_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points.project(matches(spark, sf_dir).join(transforms(spark, sf_dir).select("pair_id", "h"), "pair_id"))
    return features.label_by_truth(p).select("pair_id", "match_id", "truth")


IMAGES = """SELECT match_id, pair_id, CASE WHEN match_id % 5 <> 0 THEN concat('s', CAST(pair_id AS {T})) END AS source_image, CASE WHEN match_id % 3 <> 0 THEN concat('t', CAST(pair_id AS {T})) END AS target_image,
    CASE WHEN match_id % 2 = 0 THEN concat('r', CAST(pair_id % 9 AS {T})) END AS region"""


@query(f"""WITH i AS ({IMAGES.replace('{T}', 'VARCHAR')} FROM {{v_matches}}) SELECT pair_id, match_id, coalesce(region || ':' || source_image || '::' || target_image, source_image || '::' || target_image, region, source_image) AS group_id,
    CASE WHEN source_image IS NOT NULL AND target_image IS NOT NULL THEN 'image_pair' WHEN region IS NOT NULL THEN 'region' WHEN source_image IS NOT NULL THEN 'source_image' ELSE 'none' END AS group_level FROM i""")
def provenance_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("CASE WHEN match_id % 5 <> 0 THEN concat('s', pair_id) END AS source_image", "CASE WHEN match_id % 3 <> 0 THEN concat('t', pair_id) END AS target_image",
               "CASE WHEN match_id % 2 = 0 THEN concat('r', pair_id % 9) END AS region")
    return features.provenance_group(matches(spark, sf_dir).selectExpr("pair_id", "match_id", *columns)).select("pair_id", "match_id", "group_id", "group_level")


NEAR = """n AS (SELECT a.pair_id, a.match_id, a.source_x AS ax, a.source_y AS ay, a.target_x AS au, a.target_y AS av, b.source_x AS bx, b.source_y AS by_, b.target_x AS bu, b.target_y AS bv, sqrt(pow(a.source_x - b.source_x, 2) + pow(a.source_y - b.source_y, 2)) AS away
    FROM {v_matches} AS a JOIN {v_matches} AS b ON a.pair_id = b.pair_id AND a.match_id <> b.match_id QUALIFY row_number() OVER (PARTITION BY a.pair_id, a.match_id ORDER BY away, b.match_id) <= 5)"""


@query(f"""WITH {NEAR}, e AS (SELECT *, sqrt(pow((bu - bx) - (au - ax), 2) + pow((bv - by_) - (av - ay), 2)) AS e, CASE WHEN away > 1e-3 THEN sqrt(pow(bu - au, 2) + pow(bv - av, 2)) / away END AS r FROM n),
    m AS (SELECT pair_id, match_id, avg(e) AS e, quantile_cont(r, 0.5) AS mid FROM e GROUP BY ALL), s AS (SELECT e.pair_id, e.match_id, avg(abs(r - mid)) AS d FROM e JOIN m ON e.pair_id = m.pair_id AND e.match_id = m.match_id GROUP BY ALL)
    SELECT m.pair_id, m.match_id, round(1 / (1 + e / 20), 5) AS disp_consistency, round(coalesce(1 / (1 + d), 0.5), 5) AS ratio_consistency FROM m JOIN s ON m.pair_id = s.pair_id AND m.match_id = s.match_id""")
def neighborhood_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.neighborhood_consistency(few(spark, sf_dir)), 5)


@query(None)
def relief_strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.relief_strain(matches(spark, sf_dir).filter("label"), transforms(spark, sf_dir)))


@query("""WITH p AS (SELECT s.pair_id, s.kp_id, t.kp_id AS target_id, sqrt(list_sum(list_transform(list_zip(s.bands, t.bands), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM {v_desc} AS s JOIN {v_desc} AS t ON s.pair_id = t.pair_id AND s.side = 'source' AND t.side = 'target'),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY pair_id, kp_id ORDER BY d, target_id) = 1), s AS (SELECT b.pair_id, b.kp_id, b.target_id, b.d, min(p.d) FILTER (p.d > b.d + 1e-6) AS second FROM b JOIN p ON b.pair_id = p.pair_id AND b.kp_id = p.kp_id GROUP BY ALL)
    SELECT pair_id, kp_id, target_id, round(d, 5) AS distance, round(second, 5) AS second, coalesce(d <= 0.8 * second, d <= 1e-8) AS kept FROM s""")
def descriptor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "v_desc")
    return rounded(features.descriptor_match(d.filter("side = 'source'"), d.filter("side = 'target'")), 5)


TOPOLOGY = """f AS (SELECT pair_id, match_id, row_number() OVER (PARTITION BY pair_id ORDER BY match_id) AS i, source_x AS sx, source_y AS sy, target_x AS tx, target_y AS ty FROM {v_matches}),
    p AS (SELECT a.pair_id, a.i, b.i AS j, sqrt(pow(a.sx - b.sx, 2) + pow(a.sy - b.sy, 2)) AS s, sqrt(pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2)) AS t FROM f AS a JOIN f AS b ON a.pair_id = b.pair_id AND a.i < b.i),
    r AS (SELECT pair_id, avg(t / s) AS m, stddev_pop(t / s) AS d FROM p WHERE s > 5 GROUP BY pair_id),
    n AS (SELECT a.pair_id, a.match_id, b.sx - a.sx AS ux, b.sy - a.sy AS uy, b.tx - a.tx AS vx, b.ty - a.ty AS vy, row_number() OVER (PARTITION BY a.pair_id, a.match_id ORDER BY sqrt(pow(a.sx - b.sx, 2) + pow(a.sy - b.sy, 2)), b.match_id) AS k FROM f AS a JOIN f AS b ON a.pair_id = b.pair_id AND a.match_id <> b.match_id QUALIFY k <= 2),
    w AS (SELECT a.pair_id, abs(degrees(acos(least(greatest((a.ux*b.ux + a.uy*b.uy) / (sqrt(a.ux*a.ux + a.uy*a.uy) * sqrt(b.ux*b.ux + b.uy*b.uy) + 1e-6), -1), 1))) - degrees(acos(least(greatest((a.vx*b.vx + a.vy*b.vy) / (sqrt(a.vx*a.vx + a.vy*a.vy) * sqrt(b.vx*b.vx + b.vy*b.vy) + 1e-6), -1), 1)))) AS a
        FROM n AS a JOIN n AS b ON a.pair_id = b.pair_id AND a.match_id = b.match_id AND a.k = 1 AND b.k = 2),
    an AS (SELECT pair_id, avg(a) AS am, quantile_cont(a, 0.5) AS ad FROM w GROUP BY pair_id),
    q AS (SELECT * FROM p WHERE j <= 15), t AS (SELECT x.pair_id, list_sort([x.s, y.s, z.s]) AS s, list_sort([x.t, y.t, z.t]) AS t FROM q AS x JOIN q AS y ON x.pair_id = y.pair_id AND y.i = x.j JOIN q AS z ON z.pair_id = x.pair_id AND z.i = x.i AND z.j = y.j),
    h AS (SELECT *, list_sum(s) AS ps, list_sum(t) AS pt FROM t), h2 AS (SELECT *, sqrt(greatest(0, ps/2 * (ps/2 - s[1]) * (ps/2 - s[2]) * (ps/2 - s[3]))) AS a1, sqrt(greatest(0, pt/2 * (pt/2 - t[1]) * (pt/2 - t[2]) * (pt/2 - t[3]))) AS a2 FROM h WHERE ps > 10 AND pt > 10),
    g AS (SELECT pair_id, avg(abs(s[1]/ps - t[1]/pt) + abs(s[2]/ps - t[2]/pt) + abs(s[3]/ps - t[3]/pt)) AS sm, avg(CASE WHEN a1 > 10 THEN a2 / a1 END) AS ar FROM h2 GROUP BY pair_id), c AS (SELECT pair_id, count(*) AS n FROM f GROUP BY pair_id)"""


@query(f"""WITH {TOPOLOGY} SELECT c.pair_id, n, round(m, 4) AS mean_ratio, round(d, 4) AS std_ratio, round(am, 3) AS angle_mean, round(ad, 3) AS angle_median, round(sm, 4) AS shape_mean, round(ar, 4) AS area_ratio
    FROM c LEFT JOIN r ON r.pair_id = c.pair_id LEFT JOIN an ON an.pair_id = c.pair_id LEFT JOIN g ON g.pair_id = c.pair_id""")
def topology_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.topology_preservation(matches(spark, sf_dir))
    digits = {"mean_ratio": 4, "std_ratio": 4, "angle_mean": 3, "angle_median": 3, "shape_mean": 4, "area_ratio": 4}
    return found.select("pair_id", "n", *((F.round(c, d) + 0.0).alias(c) for c, d in digits.items()))


@query("""WITH k AS (SELECT pair_id, match_id AS kp_id, source_x + 4.5 AS x, source_y - 2.5 AS y FROM {v_matches} WHERE match_id % 3 = 0), m AS (SELECT * FROM {v_matches} WHERE match_id % 3 <> 0),
    f AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pair_id = k.pair_id AND pow(m.source_x - x, 2) + pow(m.source_y - y, 2) < 36)),
    p AS (SELECT f.pair_id, kp_id, a*x + b*y + c AS px, d*x + e*y + t.f AS py FROM f JOIN {v_transforms} AS t ON f.pair_id = t.pair_id)
    SELECT pair_id, kp_id, round(px, 4) AS px, round(py, 4) AS py FROM p WHERE px >= 0 AND px < 512 AND py >= 0 AND py < 512 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY kp_id) <= 80""")
def refill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    k = m.filter("match_id % 3 = 0").selectExpr("pair_id", "match_id AS kp_id", "source_x + 4.5e0 AS source_x", "source_y - 2.5e0 AS source_y")
    return rounded(features.refill_candidates(k, m.filter("match_id % 3 <> 0"), transforms(spark, sf_dir), 512.0, 512.0))


@query("""WITH r AS (SELECT pair_id, match_id, CASE WHEN match_id % 2 = 0 THEN sigma_major END AS f, source_x + CASE match_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0.001e0 ELSE 7e0 END AS x, source_y AS y, target_x + CASE WHEN match_id % 12 = 1 THEN 3 ELSE 0 END AS u, target_y AS v, confidence AS c FROM {v_matches}),
    a AS (SELECT round(source_x, 4) AS x, round(source_y, 4) AS y, round(target_x, 4) AS u, round(target_y, 4) AS v, min(sigma_major) AS s FROM {v_matches} GROUP BY ALL), b AS (SELECT round(source_x, 2) AS x, round(source_y, 2) AS y, round(target_x, 2) AS u, round(target_y, 2) AS v, min(sigma_major) AS s FROM {v_matches} GROUP BY ALL),
    c AS (SELECT round(source_x, 2) AS x, round(source_y, 2) AS y, round(confidence, 6) AS c, min(sigma_major) AS s FROM {v_matches} GROUP BY ALL)
    SELECT pair_id, match_id, CASE WHEN f IS NOT NULL THEN NULL WHEN a.s IS NOT NULL THEN 'exact' WHEN b.s IS NOT NULL THEN 'rough' WHEN c.s IS NOT NULL THEN 'confidence' ELSE 'none' END AS filled_by, round(coalesce(f, a.s, b.s, c.s), 4) AS texture
    FROM r LEFT JOIN a ON round(r.x, 4) = a.x AND round(r.y, 4) = a.y AND round(r.u, 4) = a.u AND round(r.v, 4) = a.v LEFT JOIN b ON round(r.x, 2) = b.x AND round(r.y, 2) = b.y AND round(r.u, 2) = b.u AND round(r.v, 2) = b.v
    LEFT JOIN c ON round(r.x, 2) = c.x AND round(r.y, 2) = c.y AND round(r.c, 6) = c.c""")
def backfill_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    moved = F.col("source_x") + F.when(F.col("match_id") % 3 == 0, 0.0).when(F.col("match_id") % 3 == 1, 0.001).otherwise(7.0)
    away = F.col("target_x") + F.when(F.col("match_id") % 12 == 1, 3).otherwise(0)
    r = m.withColumns({"source_x": moved, "target_x": away, "texture": F.when(F.col("match_id") % 2 == 0, F.col("sigma_major"))}).select("pair_id", "match_id", *features.XY, "confidence", "texture")
    done = features.backfill_features(r, m.select(*features.XY, "confidence", F.col("sigma_major").alias("texture")), ["texture"])
    return rounded(done.select("pair_id", "match_id", "filled_by", "texture"))


@query("""WITH p AS (SELECT domain, label AS t, confidence > 0.5 AS p FROM {v_matches}), s AS (SELECT domain, count(*) AS n, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM p GROUP BY ROLLUP (domain))
    SELECT domain, n, tp, fp, fn, tn, round((tp + tn) / CAST(n AS DOUBLE), 5) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 5) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 5) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 5) AS f1 FROM s""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = matches(spark, sf_dir).selectExpr("domain", "label AS truth", "confidence > 0.5 AS predicted")
    return rounded(features.classification_report(p, "domain"), 5)


@query("""WITH t AS (SELECT confidence AS s, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM {v_matches} GROUP BY confidence), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM t)
    SELECT round(sum(n * (tp - p + p / 2e0)) / (sum(p) * CAST(sum(n) AS DOUBLE)), 6) AS roc_auc, round(sum(p * (tp / CAST(tp + fp AS DOUBLE))) / sum(p), 6) AS average_precision FROM c""")
def ranking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.ranking_report(matches(spark, sf_dir).withColumnRenamed("label", "truth"), "confidence"), 6)


@query("""WITH g AS (SELECT DISTINCT pair_id FROM {v_matches}) SELECT count(*) AS groups, count(*) AS seen_once, true AS both_sides FROM g""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = features.grouped_split(matches(spark, sf_dir), "pair_id", "label", 0.25)
    per_group = split.groupBy("pair_id").agg(F.count_distinct("is_test").alias("sides"), F.max("is_test").alias("t"))
    return per_group.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("sides") == 1).alias("seen_once"), (F.count_distinct("t") == 2).alias("both_sides"))


@query("""WITH m AS (SELECT pair_id, match_id, confidence, sigma_major, source_x, source_y, target_x, target_y, label FROM {v_matches} WHERE sigma_major IS NOT NULL) SELECT label AS truth, count(DISTINCT (round(confidence, 6), round(sigma_major, 6), label,
    round(source_x, 4), round(source_y, 4), round(target_x, 4), round(target_y, 4))) AS n FROM m GROUP BY label""")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).selectExpr("*", "label AS ground_truth_label", "concat('s', pair_id) AS source_image", "concat('t', pair_id) AS target_image", "CAST(NULL AS STRING) AS region")
    return features.training_set(m, ["confidence", "sigma_major"], ["sigma_major"]).groupBy("truth").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT *, CASE WHEN match_id % 11 = 0 THEN NULL ELSE label END AS truth, match_id % 7 = 0 AS bare, pair_id % 3 AS file, 1 + match_id % 2 AS copies FROM {v_matches}),
    t AS (SELECT *, row_number() OVER () AS k FROM m, range(2) AS g(c) WHERE c < copies),
    f AS (SELECT *, CASE WHEN truth IS NULL THEN 'no_label' WHEN bare THEN 'missing' WHEN row_number() OVER (PARTITION BY truth IS NULL OR bare, round(confidence, 6), round(sigma_major, 6), truth, round(source_x, 4), round(source_y, 4), round(target_x, 4), round(target_y, 4)
        ORDER BY match_id * 2 + c, pair_id) = 1 THEN 'kept' ELSE 'duplicate' END AS fate FROM t)
    SELECT file, grouping(file) = 1 AS is_total, count(*) FILTER (fate = 'kept' AND truth) AS inliers, count(*) FILTER (fate = 'kept' AND NOT truth) AS outliers, count(*) FILTER (fate = 'no_label') AS skipped_no_label,
        count(*) FILTER (fate = 'missing') AS skipped_missing_features, count(*) FILTER (fate = 'duplicate') AS duplicates, count(*) FILTER (fate IN ('kept', 'duplicate')) AS synthetic_geometry
    FROM f GROUP BY GROUPING SETS ((file), ())""")
def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).selectExpr("*", "CASE WHEN match_id % 11 = 0 THEN NULL ELSE label END AS ground_truth_label", "CASE WHEN match_id % 7 <> 0 THEN sigma_major END AS live", "pair_id % 3 AS file", "explode(sequence(0, CAST(match_id % 2 AS INT))) AS c",
                                          "concat('s', pair_id) AS source_image", "concat('t', pair_id) AS target_image", "CAST(NULL AS STRING) AS region")
    m = m.withColumn("match_id", F.col("match_id") * 2 + F.col("c")).drop("label", "c")
    return features.training_report(m, ["confidence", "sigma_major"], ["live"]).drop("hand", "ransac", "group_key")


@query(None)
def verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match classifier trained on three quarters of the pairs, its report on the rest."""
    scores = features.neighborhood_consistency(matches(spark, sf_dir), keep=("confidence", "sigma_major", "domain", "label"))
    data = materialize(scores.withColumnRenamed("label", "truth"), "verifier-matches")  # the training reads them many times
    split = features.grouped_split(data, "pair_id", "truth", 0.25)
    model = features.train_verifier(split.filter("NOT is_test"), ["confidence", "sigma_major", "disp_consistency", "ratio_consistency"], trees=20)
    scored = features.score_matches(split.filter("is_test"), model, 0.0).withColumn("predicted", F.col("probability_true") >= 0.5)
    return rounded(features.classification_report(scored, "domain"))


# --- events

MARKED = "CASE WHEN contains(line, 'Stage 2/7') THEN 'parse' WHEN contains(line, 'Stage 4/7') THEN 'crop' WHEN contains(line, 'Stage 7/7') THEN 'summary' END"


@query(f"""WITH e AS (SELECT *, {MARKED} AS stage FROM {{v_job_events}}) SELECT job_id, stage, CASE stage WHEN 'parse' THEN 20e0 WHEN 'crop' THEN 55e0 ELSE 95e0 END AS percent FROM e WHERE stage IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_progress(view(spark, sf_dir, "v_job_events"))


@query("""WITH e AS (SELECT job_id, event_id, line, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY job_id) AS total FROM {v_job_events}) SELECT job_id, CAST(n AS INTEGER) AS n, event_id, line FROM e WHERE n > total - 5""")
def log_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.log_ring(view(spark, sf_dir, "v_job_events"), 5)


@query(f"""WITH e AS (SELECT *, {MARKED} AS stage, CASE WHEN is_failure THEN line END AS error FROM {{v_job_events}}), n AS (SELECT max(ts) AS now FROM e)
    SELECT job_id, max(ts) AS updated, arg_max(stage, (ts, event_id)) FILTER (stage IS NOT NULL) AS stage, arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS error FROM e, n GROUP BY job_id, now HAVING max(ts) >= now - INTERVAL 7 DAY""")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "v_job_events")
    e = e.withColumns({"stage": jobs.stage_of(F.col("line"))["stage"], "error": F.when(F.col("is_failure"), F.col("line"))})
    now = e.agg(F.max("ts")).first()[0]
    return jobs.job_state(e, ["stage", "error"], "7 DAYS", F.lit(now))


@query("""WITH r AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, sum(CASE WHEN is_success THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS run FROM {v_job_events}),
    f AS (SELECT job_id, event_id, s, count(*) OVER w AS failures, min(s) OVER w AS oldest FROM r WHERE is_failure WINDOW w AS (PARTITION BY job_id, run ORDER BY s RANGE BETWEEN 1209600 PRECEDING AND CURRENT ROW))
    SELECT job_id, event_id, failures, failures >= 2 AS locked, CASE WHEN failures >= 2 THEN oldest + 1209600 - s ELSE 0 END AS retry_after_s FROM f""")
def failure_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.failure_lockout(view(spark, sf_dir, "v_job_events"), 2, 14 * 86400)
