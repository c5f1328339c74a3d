"""Gates, tiers, lights and scores of pairs, and how matches spread over an image."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegrid.functions.algebra import cell, clip, det3, let, lit, singular2
from tiegrid.plans.work import materialize

#: Gate 3 limits: fixed values.
MAX_CONDITION, MIN_DETERMINANT, MAX_SCALE_RATIO, MAX_PROJECTIVITY, MAX_RMSE_PX = 1e7, 1e-4, 20.0, 0.05, 5.0


def cells(matches: DataFrame, width: float, height: float, g: int, key: str = "pair_id", x: str = "source_x", y: str = "source_y") -> DataFrame:
    """(key, gx, gy, c): matches in each occupied cell of a g x g grid."""
    gx, gy = cell(F.col(x), width / g, g), cell(F.col(y), height / g, g)
    return matches.groupBy(key, gx.alias("gx"), gy.alias("gy")).agg(F.count(F.lit(1)).alias("c"))


def coverage(matches: DataFrame, width: float, height: float, g: int, key: str = "pair_id") -> DataFrame:
    return cells(matches, width, height, g, key).groupBy(key).agg((F.count(F.lit(1)) / lit(g * g)).alias("coverage"))


def spatial_distribution(matches: DataFrame, width: float, height: float, g: int, key: str = "pair_id") -> DataFrame:
    """(key, n, coverage, mean, std, entropy, uniformity, balance) over all g x g cells, empty ones included.

    Empty cells are never made: mean and deviation follow from the sums over
    occupied ones. uniformity = coverage * exp(-0.3 std / mean); balance is 1
    less the deviation over that of all points in one cell.
    """
    total = g * g
    found = cells(matches, width, height, g, key).groupBy(key).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s2"), F.count(F.lit(1)).alias("occupied"), F.sum(F.col("c") * F.log2("c")).alias("clog")
    )
    mean = F.col("n") / lit(total)
    std = F.sqrt(F.greatest(F.col("s2") / lit(total) - mean * mean, lit(0)))
    full = F.sqrt(F.col("n") * F.col("n") / lit(total) - mean * mean)
    entropy = (F.log2("n") - F.col("clog") / F.col("n")) / F.log2(lit(total))
    share = F.col("occupied") / lit(total)
    return found.select(
        key, "n", share.alias("coverage"), mean.alias("mean"), std.alias("std"), entropy.alias("entropy"),
        (share * F.exp(-0.3 * std / mean)).alias("uniformity"), (1 - std / full).alias("balance"),
    )


def adaptive_distribution(matches: DataFrame, width: float, height: float, key: str = "pair_id") -> DataFrame:
    """(key, n, g, coverage): as above with g = ceil(sqrt(n)) cells a side for each pair."""
    sized = matches.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("g", F.ceil(F.sqrt("n")).cast("int"))
    g = F.col("g")
    gx, gy = cell(F.col("source_x"), lit(width) / g, g), cell(F.col("source_y"), lit(height) / g, g)
    occupied = sized.groupBy(key, "n", "g", gx.alias("gx"), gy.alias("gy")).agg(F.count(F.lit(1)))
    return occupied.groupBy(key, "n", "g").agg(F.count(F.lit(1)).alias("k")).select(key, "n", "g", (F.col("k") / (g * g)).alias("coverage"))


def support_gate(matches: DataFrame, width: float, height: float, g: int = 4, key: str = "pair_id") -> DataFrame:
    """(key, n, cells, max_share, accepted, reason): Gate 4, at least 3 cells and no more than 60 % in one."""
    found = cells(matches, width, height, g, key).groupBy(key).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("cells"), F.max("c").alias("top"))
    share = F.col("top") / F.col("n")
    reason = (
        F.when(F.col("n") < 4, "too_few_inliers").when(F.col("cells") < 3, "too_few_cells").when(share > 0.60, "concentrated").otherwise("ok")
    )
    return found.select(key, "n", "cells", share.alias("max_share"), (reason == "ok").alias("accepted"), reason.alias("reason"))


def cell_covariance_stats(matches: DataFrame, width: float, height: float, g: int, key: str = "pair_id") -> DataFrame:
    """Per cell, and with NULL cells per pair: mean axes, anisotropy and trace, axial mean angle, counts of kinds (which overlap), mean scores."""
    from tiegrid.operators.points import covariance_axes, score_covariance

    axes = covariance_axes(score_covariance(matches)).withColumns({"gx": cell(F.col("source_x"), width / g, g), "gy": cell(F.col("source_y"), height / g, g)})
    t = F.radians("axis_angle") * 2
    angle = F.pmod(F.degrees(F.atan2(F.avg(F.sin(t)), F.avg(F.cos(t)))) / 2, lit(180))
    stats = [
        F.count(F.lit(1)).alias("n"), F.avg("axis_major").alias("major"), F.avg("axis_minor").alias("minor"), F.avg("anisotropy").alias("anisotropy"),
        F.avg("trace").alias("trace"), angle.alias("angle"), *(F.count_if(f"is_{k}").alias(k) for k in ("uncertain", "elongated", "isotropic")),
        F.avg("confidence").alias("mean_confidence"), F.avg("rank_score").alias("mean_rank_score"),
    ]
    return axes.groupingSets([[F.col(key), F.col("gx"), F.col("gy")], [F.col(key)]], F.col(key), F.col("gx"), F.col("gy")).agg(*stats)


def condition3(m: Column) -> Column:
    """The condition number of a 3 x 3 matrix, largest over smallest singular value; NULL for one that is missing, singular or not finite.

    The two larger singular values follow from the eigenvalues of M'M in closed
    form; the smallest is the determinant over their product, which keeps its digits.
    """

    def of(m: Column) -> Column:
        dot = lambda i, j: m[i] * m[j] + m[3 + i] * m[3 + j] + m[6 + i] * m[6 + j]
        xx, yy, zz, xy, xz, yz = dot(0, 0), dot(1, 1), dot(2, 2), dot(0, 1), dot(0, 2), dot(1, 2)
        mean = (xx + yy + zz) / 3
        return F.struct(*(c.alias(n) for n, c in {"q": mean, "xx": xx - mean, "yy": yy - mean, "zz": zz - mean, "xy": xy, "xz": xz, "yz": yz}.items()))

    def larger(s: Column) -> Column:
        p = F.sqrt((s["xx"] * s["xx"] + s["yy"] * s["yy"] + s["zz"] * s["zz"] + 2 * (s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"])) / 6)
        det = s["xx"] * (s["yy"] * s["zz"] - s["yz"] * s["yz"]) - s["xy"] * (s["xy"] * s["zz"] - s["yz"] * s["xz"]) + s["xz"] * (s["xy"] * s["yz"] - s["yy"] * s["xz"])
        turn = F.acos(F.coalesce(clip(F.try_divide(det, 2 * p * p * p), -1, 1), lit(1))) / 3
        first, last = s["q"] + 2 * p * F.cos(turn), s["q"] + 2 * p * F.cos(turn + 2 * math.pi / 3)
        return F.struct(first.alias("first"), F.greatest(3 * s["q"] - first - last, lit(0)).alias("second"))

    sound = (F.size(m) == 9) & F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    values = let(let(m, of), larger)
    found = let(F.struct(values.alias("l"), F.abs(det3(m)).alias("d")), lambda s: F.try_divide(s["l"]["first"] * F.sqrt(s["l"]["second"]), s["d"]))
    return F.when(sound, found)


def transform_gate(transforms: DataFrame, rmse: str | None = None) -> DataFrame:
    """Adds determinant, condition, scale_ratio, projectivity, is_valid and reason: Gate 3."""
    h = F.col("h")
    big, small = singular2(h[0], h[1], h[3], h[4])
    out = transforms.withColumns({
        "determinant": det3(h), "condition": condition3(h), "scale_ratio": big / F.greatest(small, lit(1e-9)), "projectivity": F.sqrt(h[6] * h[6] + h[7] * h[7]),
    })
    sound = (
        F.col("condition").isNotNull() & (F.col("condition") < MAX_CONDITION) & (F.col("determinant") > MIN_DETERMINANT)
        & (F.col("scale_ratio") < MAX_SCALE_RATIO) & (F.col("projectivity") < MAX_PROJECTIVITY)
    )
    close = F.coalesce(F.col(rmse) <= MAX_RMSE_PX, F.lit(True)) if rmse else F.lit(True)
    reason = F.when(~F.coalesce(sound, F.lit(False)), "pathological").when(~close, "excessive_rmse").otherwise("ok")
    return out.withColumns({"is_valid": reason == "ok", "reason": reason})


def quality_tier(inliers: Column, covered: Column, validation_rmse: Column, valid: Column) -> Column:
    return (
        F.when((inliers < 4) | ~valid, "FAILED")
        .when((inliers >= 15) & (covered >= 0.15) & F.coalesce(validation_rmse < 2.0, F.lit(False)), "HIGH_CONFIDENCE")
        .when((inliers >= 10) & (covered >= 0.10), "ACCEPTED")
        .otherwise("LOW_CONFIDENCE")
    )


def verdict(color: Column, tier: Column, inliers: Column, has_checkpoints: Column) -> Column:
    first = F.when((color == "GREEN") & (tier != "FAILED"), "PASS").when((color == "RED") | (tier == "FAILED"), "FAIL").otherwise("REVIEW")
    return F.when(inliers < 4, "FAIL").when((inliers < 8) & ~has_checkpoints & (first != "FAIL"), "REVIEW").otherwise(first)


def traffic_light(metrics: DataFrame) -> DataFrame:
    """Adds color, light_score and reasons from inlier_ratio, inliers, held_out, ssim and fit_rmse; missing ones are NULL."""
    ratio, count = F.coalesce("inlier_ratio", lit(0)), F.coalesce("inliers", F.lit(0))
    held, fit, ssim = F.col("held_out"), F.col("fit_rmse"), F.coalesce(clip(F.col("ssim"), 0, 1), lit(0))
    rules = [
        ((count > 0) & (count < 4), "few_inliers"), ((count == 0) & (ratio <= 0), "no_inliers"), (ratio < 0.3, "weak_consensus"),
        (held > 3.0, "held_out_over_3"), ((held <= 3.0) & (held > 2.5) & (fit > 1.5) & (count >= 20), "held_out_over_2_5"),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))
    red = F.size(reasons) > 0
    green = F.coalesce((held < 1.5) & (ssim > 0.65) & (ratio > 0.5), F.lit(False))
    part = clip((ratio - 0.3) / 0.7, 0, 1)
    mixed = F.when(held.isNull(), 0.55 * part + 0.45 * ssim).otherwise(0.4 * part + 0.3 * ssim + 0.3 * clip(1 - held / 3, 0, 1))
    best = 0.4 * clip((ratio - 0.5) / 0.5, 0, 1) + 0.3 * clip((ssim - 0.65) / 0.35, 0, 1) + 0.3 * clip((1.5 - held) / 1.5, 0, 1)
    score = (
        F.when(red, clip(F.bround(59 * (0.5 * clip(ratio / 0.3, 0, 1) + 0.5 * ssim)), 0, 59))
        .when(green, clip(F.bround(90 + 10 * best), 90, 100))
        .otherwise(clip(F.bround(60 + 29 * clip(mixed, 0, 1)), 60, 89))
    )
    color = F.when(red, "RED").when(green, "GREEN").otherwise("YELLOW")
    return metrics.withColumns({"color": color, "light_score": score.cast("int"), "reasons": reasons})


def composite_score(ratio: Column, rmse: Column, uniformity: Column, nmi: Column, ssim: Column) -> Column:
    """One score in [0, 1]; four terms if an image similarity is known, else three."""
    near = F.when(rmse >= 0, F.exp(-rmse / 2)).otherwise(lit(0))
    terms = clip(ratio, 0, 1) + near + clip(uniformity, 0, 1)
    alike = 0.6 * F.coalesce(nmi, lit(0)) + 0.4 * F.greatest(F.coalesce(ssim, lit(0)), lit(0))
    return clip(F.when(nmi.isNotNull() | ssim.isNotNull(), 0.25 * (terms + alike)).otherwise(terms / 3), 0, 1)


def failure_causes(pairs: DataFrame) -> DataFrame:
    """Adds causes (in a fixed order) and primary from texture, sun_gap, scale, dark, saturated, rmse and gate_px."""
    rules = [
        (F.col("texture") < 15, "low_texture"), (F.col("sun_gap") > 45, "illumination_gap"), (F.col("scale") > 10, "scale_gap"),
        (F.col("dark") > 0.40, "shadow"), (F.col("saturated") > 0.30, "saturation"), (F.col("rmse") > F.col("gate_px"), "rmse_over_gate"),
    ]
    causes = F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))
    return pairs.withColumn("causes", causes).withColumn("primary", F.coalesce(F.get("causes", F.lit(0)), F.lit("unknown")))


def density_budget(matches: DataFrame, width: float, height: float, g: int, per_cell: int, total: int | None, key: str = "pair_id", id_col: str = "match_id") -> DataFrame:
    """Matches kept in rounds: the best of every cell, then the most confident ones whose angle differs, within a budget.

    In a later round a candidate counts confidence * (1 + 0.25 sin(2 d)), d the
    smallest angle to what its cell has chosen. Candidates that can't be chosen in
    any round are left out in the pass that ranks them, so the rounds are windows
    over few rows of a cell, dealt out once. The budget (``total``, or none) cuts by round, then cell.
    """
    from tiegrid.operators.points import score_covariance

    base = score_covariance(matches).withColumns({"gx": cell(F.col("source_x"), width / g, g), "gy": cell(F.col("source_y"), height / g, g)})
    where = [key, "gx", "gy"]
    by_score = Window.partitionBy(*where).orderBy(F.desc("rank_score"), id_col)
    whole = by_score.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The last choice has a value of at least the per_cell-th best score, and a value is at most 1.25 times its score.
    last = F.nth_value("rank_score", per_cell).over(whole)
    reach = F.when(last >= 0, last / 1.2500001).otherwise(last * 1.2500001)
    rest = base.withColumn("round", F.when(F.row_number().over(by_score) == 1, 0)).withColumn("_reach", reach)
    rest = materialize(rest.filter(F.coalesce(F.col("rank_score") >= F.col("_reach"), F.lit(True)) | F.col("round").isNotNull()).drop("_reach"), "budget")
    cells, best = Window.partitionBy(*where), Window.partitionBy(*where).orderBy(F.col("round").isNotNull(), F.desc("value"), id_col)
    for turn in range(1, per_cell):
        had = F.collect_list(F.when(F.col("round").isNotNull(), F.col("angle"))).over(cells)  # at most one for each round
        gap = lambda a: F.least(F.pmod(F.abs(F.col("angle") - a), lit(180)), 180 - F.pmod(F.abs(F.col("angle") - a), lit(180)))
        value = F.col("rank_score") * (1 + 0.25 * F.sin(2 * F.radians(F.array_min(F.transform(had, gap)))))
        placed = rest.withColumn("value", value).withColumn("k", F.row_number().over(best))
        rest = placed.withColumn("round", F.when(F.col("round").isNull() & (F.col("k") == 1), turn).otherwise(F.col("round"))).drop("value", "k")
    kept = rest.filter("round IS NOT NULL")
    budget = Window.partitionBy(key).orderBy("round", "gx", "gy")
    kept = kept.withColumn("slot", F.row_number().over(budget))
    return kept if total is None else kept.filter(F.col("slot") <= total)
