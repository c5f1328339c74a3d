"""Matches under their transforms: projection, residuals, covariances, cycles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiegrid.functions.algebra import clip, eigen2, finite, inverse3, lit, matmul3, normal3

MOON_RADIUS_M = 1_737_400.0


def mapped(h: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(x, y, z) of a point under a 3 x 3 matrix, before the division by z."""
    return h[0] * x + h[1] * y + h[2], h[3] * x + h[4] * y + h[5], h[6] * x + h[7] * y + h[8]


def project(df: DataFrame, h: str = "h", x: str = "source_x", y: str = "source_y", u: str = "target_x", v: str = "target_y") -> DataFrame:
    """Adds px, py and error; a point on or behind the plane has no place and infinite error."""
    px, py, pz = mapped(F.col(h), F.col(x), F.col(y))
    front = pz > 1e-12
    out = df.withColumn("px", F.when(front, px / pz)).withColumn("py", F.when(front, py / pz))
    away = F.sqrt(F.pow(F.col("px") - F.col(u), 2) + F.pow(F.col("py") - F.col(v), 2))
    return out.withColumn("error", F.when(front, away).otherwise(F.lit(float("inf"))))


def residual_summary(matches: DataFrame, transforms: DataFrame, key: str = "pair_id") -> DataFrame:
    """Count, RMSE, mean, median and largest residual of each pair, and the shares below 1, 0.5 and 0.25 px."""
    e = F.col("error")
    found = project(matches.join(transforms.select(key, "h"), key))
    return found.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), finite(F.sqrt(F.avg(e * e))).alias("rmse"), finite(F.avg(e)).alias("mean"),
        finite(F.percentile("error", F.lit(0.5))).alias("median"), finite(F.max(e)).alias("max"),
        *(F.avg((e < t).cast("double")).alias(f"below_{n}") for t, n in ((1.0, "1"), (0.5, "05"), (0.25, "025"))),
    )


def covariance_axes(matches: DataFrame) -> DataFrame:
    """Adds cxx, cxy, cyy, axis_major, axis_minor, axis_angle, anisotropy, trace and three flags.

    Axes come from ``sigma_major``, ``sigma_minor`` and ``angle``, or where one
    of the sigmas is missing from the eigenvalues, within [1e-4, 100], of the
    covariance columns ``cxx``, ``cxy``, ``cyy`` if the table has them; else
    they count as 0.5 px and 0 degrees. The covariance is kept, or made of the
    axes. is_elongated: anisotropy of 2 or more and a minor axis of at most
    0.6; is_isotropic: below 2 and a major axis of at most 1.2; is_uncertain: a
    minor axis over 0.8, or a major one over 1.8 that isn't elongated.
    """
    known = all(c in matches.columns for c in ("cxx", "cxy", "cyy"))
    xx, xy, yy = (F.col(c) if known else F.lit(None).cast("double") for c in ("cxx", "cxy", "cyy"))
    has = finite(xx).isNotNull() & finite(xy).isNotNull() & finite(yy).isNotNull()
    larger, smaller, turned = eigen2(xx, xy, yy)
    asked = has & (F.col("sigma_major").isNull() | F.col("sigma_minor").isNull())
    major = F.greatest(F.coalesce(F.when(asked, F.sqrt(clip(larger, 1e-4, 100))), F.col("sigma_major"), lit(0.5)), lit(1e-3))
    minor = F.coalesce(F.when(asked, F.sqrt(clip(smaller, 1e-4, 100))), F.col("sigma_minor"), lit(0.5))
    angle = F.pmod(F.coalesce(F.col("angle"), F.when(asked, turned), lit(0)), lit(180))
    out = matches.withColumns({"axis_major": major, "axis_minor": minor, "axis_angle": angle, "_has": F.coalesce(has, F.lit(False))})
    out = out.withColumn("axis_minor", F.greatest(F.least("axis_minor", "axis_major"), lit(1e-3)))
    t, big, small = F.radians("axis_angle"), F.pow("axis_major", lit(2)), F.pow("axis_minor", lit(2))
    made = {
        "cxx": big * F.cos(t) * F.cos(t) + small * F.sin(t) * F.sin(t), "cxy": (big - small) * F.sin(t) * F.cos(t),
        "cyy": big * F.sin(t) * F.sin(t) + small * F.cos(t) * F.cos(t),
    }
    out = out.withColumns({c: F.when(F.col("_has"), F.col(c)).otherwise(v) if known else v for c, v in made.items()}).drop("_has")
    ratio = F.col("axis_major") / F.col("axis_minor")
    long = (ratio >= 2) & (F.col("axis_minor") <= 0.6)
    return out.withColumns({
        "anisotropy": ratio, "trace": F.col("cxx") + F.col("cyy"), "is_elongated": long, "is_isotropic": (ratio < 2) & (F.col("axis_major") <= 1.2),
        "is_uncertain": (F.col("axis_minor") > 0.8) | ((F.col("axis_major") > 1.8) & ~long),
    })


def score_covariance(matches: DataFrame, alpha: float = 0.5, beta: float = 0.6) -> DataFrame:
    """Adds ``rank_score``: confidence (1 if missing) damped by the axes, with a bonus for a small minor axis."""
    axes = ["cxx", "cxy", "cyy", "axis_major", "axis_minor", "axis_angle", "anisotropy", "trace", "is_elongated", "is_isotropic", "is_uncertain"]
    placed = covariance_axes(matches)
    damped = F.coalesce("confidence", lit(1)) / (1 + alpha * F.pow("axis_major", lit(0.7)) * F.pow("axis_minor", lit(0.5)))
    scored = placed.withColumn("rank_score", damped * (1 + beta / (1 + 2 * F.col("axis_minor"))))
    return scored.drop(*(c for c in axes if c not in matches.columns))


def conditioned(matches: DataFrame, low: float = 1e-4, high: float = 100.0, cond: float = 1e4) -> DataFrame:
    """``covariance_axes`` with sxx, sxy, syy: the covariance, the given one where there is one, with eigenvalues within [low, high] and a ratio of at most ``cond``."""
    axes = covariance_axes(matches)
    larger, smaller, turned = eigen2(F.col("cxx"), F.col("cxy"), F.col("cyy"))
    big = clip(larger, low, high)
    small = F.greatest(clip(smaller, low, high), big / cond)
    t = F.radians(turned)
    sxx, syy = big * F.cos(t) * F.cos(t) + small * F.sin(t) * F.sin(t), big * F.sin(t) * F.sin(t) + small * F.cos(t) * F.cos(t)
    return axes.withColumns({"sxx": sxx, "sxy": (big - small) * F.sin(t) * F.cos(t), "syy": syy})


def whiten(matches: DataFrame, transforms: DataFrame, key: str = "pair_id", low: float = 1e-4, high: float = 100.0, cond: float = 1e4) -> DataFrame:
    """Adds ``error`` and ``distance``: the residual in units of its covariance J S J' + S.

    S is conditioned first: eigenvalues within [low, high] and their ratio at most ``cond``.
    """
    return whitened(conditioned(matches, low, high, cond).join(transforms.select(key, "h"), key))


def whitened(placed: DataFrame) -> DataFrame:
    """Adds ``error`` and ``distance`` to conditioned matches with their map ``h``."""
    axes = project(placed)
    h, x, y = F.col("h"), F.col("source_x"), F.col("source_y")
    z = h[6] * x + h[7] * y + h[8]
    a, b = (h[0] - F.col("px") * h[6]) / z, (h[1] - F.col("px") * h[7]) / z
    c, d = (h[3] - F.col("py") * h[6]) / z, (h[4] - F.col("py") * h[7]) / z
    xx, xy, yy = F.col("sxx"), F.col("sxy"), F.col("syy")
    rxx = a * a * xx + 2 * a * b * xy + b * b * yy + xx
    rxy = a * c * xx + (a * d + b * c) * xy + b * d * yy + xy
    ryy = c * c * xx + 2 * c * d * xy + d * d * yy + yy
    rx, ry = F.col("px") - F.col("target_x"), F.col("py") - F.col("target_y")
    det = rxx * ryy - rxy * rxy
    squared = (ryy * rx * rx - 2 * rxy * rx * ry + rxx * ry * ry) / det
    return axes.withColumn("distance", F.when(det > 1e-18, F.sqrt(F.greatest(squared, lit(0)))))


def dual_rmse(matches: DataFrame, transforms: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, n, rmse_px, rmse_whitened)."""
    w = whiten(matches, transforms, key)
    return w.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), finite(F.sqrt(F.avg(F.col("error") * F.col("error")))).alias("rmse_px"),
        finite(F.sqrt(F.avg(F.col("distance") * F.col("distance")))).alias("rmse_whitened"),
    )


def absolute_rmse(matches: DataFrame, transforms: DataFrame, gsd_x: float, gsd_y: float, key: str = "pair_id", dem: DataFrame | None = None) -> DataFrame:
    """(key, n, rmse_m): root mean square residual in metres, with a ground distance for each axis.

    With ``dem`` (image_id, x, y, v in metres; ``matches`` then has image_id, the
    target's elevation raster) the height difference between where a match is
    mapped to and its target adds to it, read at the pixels that hold both
    places, or the nearest ones of the raster. Matches that have no place under
    the transform, or whose heights aren't known, don't count.
    """
    columns = [key, "target_x", "target_y", *(["image_id"] if dem is not None else [])]
    p = project(matches.select(*columns, "source_x", "source_y").join(transforms.select(key, "h"), key)).filter("px IS NOT NULL")
    dx, dy = (F.col("px") - F.col("target_x")) * gsd_x, (F.col("py") - F.col("target_y")) * gsd_y
    squared = dx * dx + dy * dy
    if dem is not None:
        ends = dem.groupBy("image_id").agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
        at = lambda c, most: F.least(F.greatest(F.floor(c), F.lit(0)), F.col(most))
        heights = lambda name, x, y: dem.select("image_id", F.col("x").alias(x), F.col("y").alias(y), finite(F.col("v")).alias(name))
        p = p.join(ends, "image_id").withColumns({"_ax": at("px", "_mx"), "_ay": at("py", "_my"), "_bx": at("target_x", "_mx"), "_by": at("target_y", "_my")})
        p = p.join(heights("_z1", "_ax", "_ay"), ["image_id", "_ax", "_ay"], "left").join(heights("_z2", "_bx", "_by"), ["image_id", "_bx", "_by"], "left")
        squared = squared + F.pow(F.col("_z2") - F.col("_z1"), 2)
    return p.groupBy(key).agg(F.count(squared).alias("n"), F.sqrt(F.avg(squared)).alias("rmse_m"))


def checkpoint_metrics(checkpoints: DataFrame, transforms: DataFrame, gsd: float, key: str = "pair_id") -> DataFrame:
    """Errors of independent checkpoints in pixels and metres, and the shares within 1, 2, 3 and 2.4477 whitened units.

    Covariances that come from the fit itself (``covariance_source`` = 'fit') aren't used for the shares.
    """
    w = whiten(checkpoints, transforms, key)
    e, own = F.col("error"), F.lit(True)
    if "covariance_source" in checkpoints.columns:
        own = F.coalesce(F.col("covariance_source") != "fit", F.lit(True))
    d = F.when(own, F.col("distance"))
    rmse = F.sqrt(F.avg(e * e))
    return w.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), finite(rmse).alias("rmse_px"), finite(F.avg(e)).alias("mean_px"),
        finite(F.percentile("error", F.lit(0.5))).alias("median_px"), finite(F.percentile("error", F.lit(0.95))).alias("p95_px"),
        finite(F.max(e)).alias("max_px"), finite(rmse * gsd).alias("rmse_m"), F.avg(d).alias("mean_distance"),
        *(F.avg((d <= t).cast("double")).alias(f"within_{n}") for t, n in ((1.0, "1"), (2.0, "2"), (3.0, "3"), (2.4477, "95"))),
    )


def corner_error(transforms: DataFrame, truth: DataFrame, width: float, height: float, key: str = "pair_id") -> DataFrame:
    """(key, corner_error): mean distance of the four image corners under two transforms; NULL if a corner has no place under one of them."""
    corners = F.array(*(F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((0, 0), (width, 0), (width, height), (0, height))))
    both = transforms.select(key, "h").join(truth.select(key, F.col("h").alias("g")), key).select(key, "h", "g", F.explode(corners).alias("p"))
    (ax, ay, az), (bx, by, bz) = (mapped(F.col(m), F.col("p.x"), F.col("p.y")) for m in ("h", "g"))
    gap = lambda a, b: F.pow(F.try_divide(a, az) - F.try_divide(b, bz), 2)
    away = finite(F.sqrt(gap(ax, bx) + gap(ay, by)))
    return both.groupBy(key).agg(F.when(F.count_if(away.isNull()) == 0, F.avg(away)).alias("corner_error"))


def complete_cycle(legs: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """(triplet_id, ab, bc, ca, composed, status) of legs (triplet_id, leg, h).

    A single missing leg is composed from the others; a loop that is further
    than ``tolerance`` from the identity is rejected; two missing legs can't be
    completed. A given leg that can't be scaled to a last element of 1 is no
    missing one: it stays NULL, and its loop isn't computable.
    """
    both = legs.groupBy("triplet_id").pivot("leg", ["AB", "BC", "CA"]).agg(F.first(normal3(F.col("h"))).alias("h"), F.count("h").alias("given"))
    wide = both.select("triplet_id", *(F.col(f"{k}_h").alias(k) for k in ("AB", "BC", "CA")), *(F.coalesce(f"{k}_given", F.lit(0)).alias(f"{k}_given") for k in ("AB", "BC", "CA")))
    ab, bc, ca = F.col("AB"), F.col("BC"), F.col("CA")
    broken = reduce(or_, ((F.col(f"{k}_given") > 0) & F.col(k).isNull() for k in ("AB", "BC", "CA")))
    have = F.when(broken, 0).otherwise(sum(c.isNotNull().cast("int") for c in (ab, bc, ca)))
    new = {"AB": inverse3(matmul3(ca, bc)), "BC": inverse3(matmul3(ab, ca)), "CA": inverse3(matmul3(bc, ab))}
    composed = F.when(have == 2, F.when(ab.isNull(), "AB").when(bc.isNull(), "BC").otherwise("CA"))
    out = wide.withColumn("have", have).withColumn("composed", composed)
    out = out.select("triplet_id", "have", "composed", *(F.coalesce(F.col(k), F.when(F.col("have") == 2, v)).alias(k) for k, v in new.items()))
    loop = normal3(matmul3(F.col("CA"), matmul3(F.col("BC"), F.col("AB"))))
    one = F.array(*(lit(k % 4 == 0) for k in range(9)))
    off = F.array_max(F.zip_with(loop, one, lambda a, b: F.abs(a - b)))
    status = (
        F.when(F.col("have") < 2, "cycle_not_computable")
        .when(F.col("have") == 2, F.when(F.coalesce(off <= tolerance, F.lit(False)), "composed").otherwise("rejected"))
        .otherwise("measured")
    )
    return out.select("triplet_id", F.col("AB").alias("ab"), F.col("BC").alias("bc"), F.col("CA").alias("ca"), "composed", status.alias("status"))


def cycle_consistency(legs: DataFrame, width: float, height: float, closed: float = 5.0) -> DataFrame:
    """(triplet_id, rmse, mean, is_closed, status): 10 x 10 points over the middle of the frame pushed around the loop.

    NULL, not 0, for a loop with a composed or missing leg, or in which a point has no place.
    """
    full = complete_cycle(legs)
    steps = F.sequence(F.lit(0), F.lit(9))
    grid = full.filter("status = 'measured'").select("triplet_id", "ab", "bc", "ca", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    x, y = (0.15 + 0.7 * F.col("i") / 9) * width, (0.15 + 0.7 * F.col("j") / 9) * height
    grid = grid.withColumns({"x0": x, "y0": y})
    for k, leg in enumerate(("ab", "bc", "ca")):
        px, py, pz = mapped(F.col(leg), F.col(f"x{k}"), F.col(f"y{k}"))
        grid = grid.withColumns({f"x{k + 1}": F.try_divide(px, pz), f"y{k + 1}": F.try_divide(py, pz)})
    away = F.sqrt(F.pow(F.col("x3") - F.col("x0"), 2) + F.pow(F.col("y3") - F.col("y0"), 2))
    whole = F.count_if(F.col("away").isNull()) == 0
    found = grid.withColumn("away", finite(away)).groupBy("triplet_id").agg(
        F.when(whole, F.sqrt(F.avg(F.col("away") * F.col("away")))).alias("rmse"), F.when(whole, F.avg("away")).alias("mean")
    )
    status = F.when(F.col("status") == "measured", "ok").otherwise(F.col("status"))
    return full.join(found, "triplet_id", "left").select("triplet_id", "rmse", "mean", (F.col("rmse") < closed).alias("is_closed"), status.alias("status"))


def intersection_error(points: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, n, dropped, rmse, mean, max, ce90, le90) of point pairs (lat, lon, alt and lat2, lon2, alt2; degrees and metres).

    ce90 is the 90th percentile of the distance in space, le90 that of the height difference.
    """

    def xyz(lat: str, lon: str, alt: str) -> tuple[Column, Column, Column]:
        r, p, q = MOON_RADIUS_M + F.col(alt), F.radians(lat), F.radians(lon)
        return r * F.cos(p) * F.cos(q), r * F.cos(p) * F.sin(q), r * F.sin(p)

    a, b = xyz("lat", "lon", "alt"), xyz("lat2", "lon2", "alt2")
    away = F.sqrt(sum(F.pow(p - q, 2) for p, q in zip(a, b, strict=True)))
    up = F.abs(F.col("alt") - F.col("alt2"))
    out = points.select(key, finite(away).alias("d"), finite(up).alias("up"))
    return out.groupBy(key).agg(
        F.count("d").alias("n"), F.count_if(F.col("d").isNull()).alias("dropped"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"),
        F.avg("d").alias("mean"), F.max("d").alias("max"), F.percentile("d", F.lit(0.9)).alias("ce90"), F.percentile("up", F.lit(0.9)).alias("le90"),
    )
