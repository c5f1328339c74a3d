"""Composed jobs: registering pairs, evaluating triplets, comparing methods, building and serving catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiegrid.functions.algebra import lit
from tiegrid.operators import catalog, experiments, fit, points, quality, selection
from tiegrid.operators.diversity import diverse_triplets
from tiegrid.operators.solvers import adjust_network
from tiegrid.plans.work import materialize


def canonical_metrics(
    matches: DataFrame, transforms: DataFrame, width: float, height: float, g: int = 8, key: str = "pair_id", checkpoints: DataFrame | None = None, images: DataFrame | None = None
) -> DataFrame:
    """One wide row for each pair of ``matches`` (with ``inlier``): residuals, spread, gates, validation, light, tier and verdict.

    Validation is by independent ``checkpoints`` (key and coordinates) for pairs
    that have any, else leave-one-out for 4 to 7 inliers and a holdout from 8
    on; ``held_out`` and ``held_out_median`` are its figures. ``images`` (key,
    ssim, nmi) brings the similarities of warped images, which the light and the
    composite score use. The fit's residual counts for gate 3, an infinite one
    fails it. Missing figures are NULL, never 0.
    """
    kept = matches.filter("inlier")
    base = matches.groupBy(key).agg(F.count(F.lit(1)).alias("matches"), F.count_if("inlier").alias("inliers"))
    summary = points.residual_summary(kept, transforms, key).select(key, F.col("rmse").alias("fit_rmse"), F.col("median").alias("fit_median"))
    spread = quality.spatial_distribution(kept, width, height, g, key).select(key, "coverage", "entropy", "uniformity")
    gate4 = quality.support_gate(kept, width, height, 4, key).select(key, F.col("accepted").alias("support_ok"))
    fitted = transforms.select(key, "h").join(summary.select(key, F.coalesce("fit_rmse", lit(float("inf"))).alias("_rmse")), key, "left")
    gate3 = quality.transform_gate(fitted, "_rmse").select(key, "determinant", "condition", F.col("is_valid").alias("transform_ok"))
    few = kept.join(base.filter("inliers BETWEEN 4 AND 7").select(key), key, "left_semi")
    loo = fit.leave_one_out(few, key).select(key, F.struct("rmse", "median").alias("loo"))
    hold = fit.holdout_validation(kept, key).select(key, F.struct("rmse", "median").alias("hold"))
    parts = [summary, spread, gate4, gate3, loo, hold]
    if checkpoints is not None:
        checked = points.residual_summary(checkpoints, transforms, key)
        parts.append(checked.select(key, F.col("n").alias("checkpoints"), F.struct("rmse", "median").alias("check")))
    if images is not None:
        parts.append(images.select(key, *(F.col(c).cast("double").alias(c) for c in ("ssim", "nmi"))))
    wide = base
    for part in parts:
        wide = wide.join(part, key, "left")
    n = F.col("inliers")
    given = F.coalesce(F.col("checkpoints") > 0, F.lit(False)) if checkpoints is not None else F.lit(False)
    by = F.when(given, F.col("check") if checkpoints is not None else F.col("hold")).when(n >= 8, F.col("hold")).when(n >= 4, F.col("loo"))
    missing = {c: F.lit(None).cast("double") for c in ("ssim", "nmi") if images is None}
    wide = wide.withColumns({
        "inlier_ratio": F.try_divide(n, F.col("matches")), "held_out": by["rmse"], "held_out_median": by["median"], "checkpoints": F.when(given, F.col("checkpoints")) if checkpoints is not None else F.lit(None).cast("bigint"),
        "validation": F.when(given, "checkpoints").when(n >= 8, "holdout").when(n >= 4, "leave_one_out").otherwise("none"), **missing,
    }).drop("loo", "hold", "check")
    lit_up = quality.traffic_light(wide)
    tier = quality.quality_tier(n, F.coalesce("coverage", lit(0)), F.col("held_out"), F.coalesce("transform_ok", F.lit(False)))
    lit_up = lit_up.withColumn("quality_tier", tier)
    score = quality.composite_score(F.col("inlier_ratio"), F.col("fit_rmse"), F.coalesce("uniformity", lit(0)), F.col("nmi"), F.col("ssim"))
    return lit_up.withColumns({"verdict": quality.verdict(F.col("color"), F.col("quality_tier"), n, F.col("validation") == "checkpoints"), "composite": score})


def match_weights(matches: DataFrame, model=None, key: str = "pair_id") -> DataFrame:
    """Adds ``weight`` in [0, 1]: the classifier's inlier probability, or the confidence without one, over the largest of the pair; 0.5 in a pair of zeros."""
    prior = F.coalesce("confidence", lit(0.5))
    if model is not None:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(matches).withColumn("weight", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    else:
        scored = matches.withColumn("weight", prior.cast("double"))
    largest = F.max("weight").over(Window.partitionBy(key))
    return scored.withColumn("weight", F.when(largest > 0, F.col("weight") / largest).otherwise(lit(0.5)))


def register_pairs(
    candidates: DataFrame, width: float, height: float, threshold: float = 5.0, hypotheses: int = 64, key: str = "pair_id", grid: int = 10, per_cell: int = 4, total: int | None = None, model=None
) -> DataFrame:
    """(key, status, h, candidates, selected, inliers, near_share, metrics): the gates as columns over all pairs at once.

    A density budget first keeps ``per_cell`` candidates of each cell, so that
    crowded cells don't decide a fit. Gate 1 wants 4 of these; gate 2 a
    consensus map, weighted by ``match_weights``, that is sound (gate 3) by
    itself; gate 4 spread support; gate 5 that 30 % of all selected candidates
    lie within 3 px and the held-out error is small. A failed pair has a NULL map.
    """
    defaults = {"sigma_major": 0.5, "sigma_minor": 0.5, "angle": 0.0}
    full = candidates.withColumns({c: lit(v) for c, v in defaults.items() if c not in candidates.columns})
    chosen = quality.density_budget(full, width, height, grid, per_cell, total, key).drop("rank_score", "gx", "gy", "round", "slot")
    chosen = materialize(match_weights(chosen, model, key), "selected")
    sizes = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("candidates")).join(chosen.groupBy(key).agg(F.count(F.lit(1)).alias("selected")), key, "left")
    enough = chosen.join(sizes.filter("selected >= 4").select(key), key, "left_semi")
    fitted = materialize(fit.consensus_fit(enough, threshold, hypotheses, key, weight="weight").select(key, "h"), "registered")
    placed = points.project(enough.join(fitted, key)).withColumn("inlier", F.col("error") <= threshold)
    placed = materialize(placed.drop("h", "px", "py"), "placed")
    near = placed.groupBy(key).agg(F.avg((F.col("error") < 3.0).cast("double")).alias("near_share"))
    metrics = canonical_metrics(placed, fitted, width, height, 8, key)
    wide = sizes.join(fitted, key, "left").join(near, key, "left").join(metrics.drop("matches"), key, "left")
    held_bad = F.coalesce((F.col("inliers") >= 20) & ((F.col("held_out") > 3.0) | ((F.col("held_out") > 2.5) & (F.col("fit_rmse") > 1.5))), F.lit(False))
    status = (
        F.when(F.coalesce("selected", F.lit(0)) < 4, "insufficient_correspondences").when(F.col("h").isNull(), "geometric_verification_failed")
        .when(~F.coalesce("transform_ok", F.lit(False)), "degenerate_transform").when(~F.coalesce("support_ok", F.lit(False)), "insufficient_support")
        .when((F.col("near_share") < 0.3) | held_bad, "registration_failed").otherwise("registered")
    )
    return wide.withColumn("status", status).withColumn("h", F.when(F.col("status") == "registered", F.col("h")))


def register_tiled(matches: DataFrame, width: float, height: float, key: str = "pair_id") -> DataFrame:
    """Swaths that were matched tile by tile: repeats from overlapping tiles go, then pairs are registered."""
    return register_pairs(selection.stitch_tiles(matches, key=key), width, height, key=key)


def evaluate_triplets(legs: DataFrame, width: float, height: float, matches: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """One report row for each triplet: which leg was composed, whether the loop closes, and its error.

    With ``matches`` (triplet_id, src, ref, source_x, ...), image ids being
    unique over triplets, also the RMSE before and after the joint adjustment
    of its images; with ``references`` (triplet_id, fit_rmse, inliers,
    quality_tier) the figures against external reference frames.
    """
    done = points.complete_cycle(legs).select("triplet_id", "composed", F.col("status").alias("completion"))
    found = done.join(points.cycle_consistency(legs, width, height).select("triplet_id", "rmse", "mean", "is_closed"), "triplet_id", "left")
    if matches is not None:
        _, report = adjust_network(matches, network="triplet_id")
        found = found.join(report.select("triplet_id", "rmse_before", "rmse_after", "improvement_pct", F.col("status").alias("network_status")), "triplet_id", "left")
    if references is not None:
        figures = [F.col(c).alias("reference_" + c) for c in ("fit_rmse", "inliers", "quality_tier")]
        found = found.join(references.select("triplet_id", *figures), "triplet_id", "left")
    return found


def compare_methods(results: DataFrame, baseline: str | None = None, key: str = "pair_id") -> DataFrame:
    """(method, pairs, successes, success_rate, mean_rmse, median_rmse, top_cause): an ablation table; the commonest cause among failed pairs.

    With ``baseline`` also b, c and p_value of the paired test of each method
    against that one, over the pairs (``key``) that both have.
    """
    failed = results.filter("NOT success").groupBy("method", "primary").agg(F.count(F.lit(1)).alias("n"))
    cause = failed.groupBy("method").agg(F.max_by("primary", F.struct("n", "primary")).alias("top_cause"))
    good = F.when(F.col("success"), F.col("rmse"))
    table = results.groupBy("method").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("success").alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg(good).alias("mean_rmse"), F.percentile(good, F.lit(0.5)).alias("median_rmse"),
    ).join(cause, "method", "left")
    if baseline is None:
        return table
    base = results.filter(F.col("method") == baseline).select(key, F.col("success").alias("base"))
    tested = experiments.mcnemar(results.filter(F.col("method") != baseline).join(base, key), "success", "base", "method")
    return table.join(tested.select("method", "b", "c", "p_value"), "method", "left")


def build_catalog_job(products: DataFrame, existing: DataFrame, requested: float = 0.75, overlap: float = 0.8, min_sun_gap: float = 5.0, most: int = 3) -> DataFrame:
    """(ohrc_id, tmc_id, iirs_id, action, outcome): products to triplets to distinct ones, upserted into a manifest (triplet_id, region_id)."""
    found = catalog.adaptive_containment(catalog.first_triplets(products, 0.5, most), requested)
    kept = diverse_triplets(found.drop("used"), products, overlap, min_sun_gap, most)
    name = F.concat_ws("-", "ohrc_id", "tmc_id", "iirs_id")
    new = kept.select(name.alias("triplet_id"), F.concat(F.lit("region_"), F.col("ohrc_id")).alias("region_id"))
    done = catalog.upsert_manifest(existing, new, "triplet_id")
    return done.withColumn("outcome", F.when(F.col("region_id").isNotNull(), "PASS").otherwise("FAIL"))


def serve_region_view(regions: DataFrame, matches: DataFrame, benchmark: DataFrame, products: DataFrame, width: float, height: float) -> DataFrame:
    """One row for each region: its matches counted and placed, metrics from the benchmark, else the registration, else NULL with a note."""
    placed = catalog.georeference(matches, regions, width, height)
    counted = placed.groupBy("region_id").agg(F.count(F.lit(1)).alias("matches"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    view = regions.select(F.col("id").alias("region_id")).join(counted, "region_id", "left")
    view = view.join(benchmark.select("region_id", F.col("rmse").alias("b_rmse")), "region_id", "left").join(products.select("region_id", F.col("rmse").alias("p_rmse")), "region_id", "left")
    source = F.when(F.col("b_rmse").isNotNull(), "benchmark").when(F.col("p_rmse").isNotNull(), "registration")
    note = F.when(source.isNull(), "no metrics for this region")
    return view.select("region_id", F.coalesce("matches", F.lit(0)).alias("matches"), "mean_lat", "mean_lon", F.coalesce("b_rmse", "p_rmse").alias("rmse"), source.alias("source"), note.alias("note"))


