"""Pixel tables (image_id, x, y, v): stencils, sampling, similarity, terrain.

Windows run within a row or a column of an image, so an image is never gathered
as a whole; joins shift pixel positions and stay equi-joins.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tiegrid.functions.algebra import clip, lit
from tiegrid.plans.work import materialize

PIXEL = ["image_id", "x", "y"]


def to_pixels(images: DataFrame, array_col: str, row_col: str = "y") -> DataFrame:
    """(image_id, x, y, v) of rows of pixel values."""
    return images.select("image_id", F.posexplode(array_col).alias("x", "v"), F.col(row_col).alias("y")).select("image_id", F.col("x").cast("bigint").alias("x"), "y", F.col("v").cast("double").alias("v"))


def crop(pixels: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Pixels of a window, ends exclusive, counted from its corner."""
    inside = pixels.filter(f"x >= {x0} AND x < {x1} AND y >= {y0} AND y < {y1}")
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def crop_bounds(pixels: DataFrame, images: DataFrame, regions: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(region_id, image_id, x, y, v): pixels of each region's window in each image that fully holds it, counted from the window's corner.

    ``images`` has image_id, bounds and width and height in pixels, ``regions``
    id and bounds. Window edges are rounded to whole pixels; a region that an
    image doesn't hold gives none of its pixels (``coverage_check`` lists such).
    """
    from tiegrid.operators.catalog import BOUNDS, overlapping

    held = overlapping(regions.select("id", *BOUNDS), images.select("image_id", *BOUNDS, "width", "height"), "id", "image_id")
    b = {c: F.col("b_" + c) for c in (*BOUNDS, "width", "height")}
    inside = (F.col("west_lon") >= b["west_lon"] - eps) & (F.col("east_lon") <= b["east_lon"] + eps) & (F.col("south_lat") >= b["south_lat"] - eps) & (F.col("north_lat") <= b["north_lat"] + eps)
    dx, dy = (b["east_lon"] - b["west_lon"]) / b["width"], (b["north_lat"] - b["south_lat"]) / b["height"]
    edge = lambda away, step: F.round(away / step).cast("bigint")
    windows = held.filter(inside).select(
        F.col("id").alias("region_id"), F.col("b_image_id").alias("image_id"), edge(F.col("west_lon") - b["west_lon"], dx).alias("x0"), edge(F.col("east_lon") - b["west_lon"], dx).alias("x1"),
        edge(b["north_lat"] - F.col("north_lat"), dy).alias("y0"), edge(b["north_lat"] - F.col("south_lat"), dy).alias("y1"),
    )
    cut = pixels.join(windows, "image_id").filter("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    return cut.select("region_id", "image_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "v")


def neighbours(pixels: DataFrame, value: str = "v", mirror: bool = False) -> DataFrame:
    """Adds the eight neighbours (nw, n, ne, w, e, sw, s, se); beyond an edge the pixel at the edge stands in, or with ``mirror`` the one before it."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")

    def step(c: str, window, before: bool) -> Column:
        near, other = (F.lag, F.lead) if before else (F.lead, F.lag)
        return F.coalesce(near(c).over(window), *((other(c).over(window),) if mirror else ()), F.col(c))

    side = pixels.withColumns({"w": step(value, row, True), "e": step(value, row, False)})
    named = (("n", value), ("s", value), ("nw", "w"), ("ne", "e"), ("sw", "w"), ("se", "e"))
    return side.withColumns({name: step(source, column, name[0] == "n") for name, source in named})


def gradients(pixels: DataFrame, value: str = "v", mirror: bool = False) -> DataFrame:
    """Adds sobel_x, sobel_y and laplacian."""
    c = F.col
    sx = c("ne") + 2 * c("e") + c("se") - c("nw") - 2 * c("w") - c("sw")
    sy = c("sw") + 2 * c("s") + c("se") - c("nw") - 2 * c("n") - c("ne")
    return neighbours(pixels, value, mirror).withColumns({"sobel_x": sx, "sobel_y": sy, "laplacian": c("n") + c("s") + c("w") + c("e") - 4 * c(value)})


def image_stats(pixels: DataFrame, dark: float, bright: float, max_nodata: float = 0.10) -> DataFrame:
    """Per image: Laplacian variance, Tenengrad energy, dark, saturated and finite shares, min, max, mean, median, verdict; edges mirror."""
    g = gradients(pixels, mirror=True)
    known = g.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    total = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))
    v = F.col("v")
    out = known.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("k"), F.var_pop("laplacian").alias("laplacian_variance"), F.avg(F.col("sobel_x") ** 2 + F.col("sobel_y") ** 2).alias("tenengrad"),
        F.avg((v < dark).cast("double")).alias("dark"), F.avg((v > bright).cast("double")).alias("saturated"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"),
    )
    share = F.coalesce(F.col("k") / F.col("total"), lit(0))
    return total.join(out, "image_id", "left").withColumns({"finite": share, "ok": share >= 1 - max_nodata}).drop("k", "total")


def overlap_stats(a: DataFrame, b: DataFrame, least: int = 16) -> DataFrame:
    """(image_id, n, mse, psnr, mean_difference, mean_abs_diff, near_black) over pixels that both images have; the range is that of ``a``.

    mean_abs_diff and near_black are of the difference map: both images brought
    to 0 to 255 by their least and largest shared value (a flat one to 0); the
    mean of the absolute difference and the share of pixels below 8.
    """
    both = a.select(*PIXEL, F.col("v").alias("a")).join(b.select(*PIXEL, F.col("v").alias("b")), PIXEL)
    d = F.col("a") - F.col("b")
    s = both.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("mse"), (F.max("a") - F.min("a")).alias("range"), F.avg(F.abs(d)).alias("mean_difference"),
        *(f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("low", F.min), ("high", F.max))),
    )
    good = (F.col("n") >= least) & (F.col("mse") > 1e-12) & (F.col("range") > 0)
    grey = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}")), lit(0)) * 255
    off = F.abs(grey("a") - grey("b"))
    maps = both.join(s, "image_id").groupBy("image_id").agg(F.avg(off).alias("mean_abs_diff"), F.avg((off < 8).cast("double")).alias("near_black"))
    psnr = F.when(good, 10 * F.log10(F.col("range") * F.col("range") / F.col("mse"))).alias("psnr")
    return s.join(maps, "image_id").select("image_id", "n", "mse", psnr, "mean_difference", "mean_abs_diff", "near_black")


def nmi(a: DataFrame, b: DataFrame, bins: int = 32, least: int = 32) -> DataFrame:
    """(image_id, n, nmi, mi_ratio): 2 I / (Ha + Hb) and I / H(a, b) of joint histograms over shared pixels; NULL below ``least``."""
    both = a.select(*PIXEL, F.col("v").alias("a")).join(b.select(*PIXEL, F.col("v").alias("b")), PIXEL)
    ends = both.groupBy("image_id").agg(*(f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("low", F.min), ("high", F.max))), F.count(F.lit(1)).alias("n"))
    placed = both.join(ends, "image_id")

    def slot(c: str) -> Column:
        width = (F.col(f"high_{c}") - F.col(f"low_{c}")) / bins
        return F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"low_{c}")) / width).cast("int"))).otherwise(0)

    joint = placed.groupBy("image_id", "n", slot("a").alias("i"), slot("b").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.col("n")
    entropy = lambda df, name: df.groupBy("image_id").agg((-F.sum(p * F.log2(p))).alias(name))
    one = lambda k: joint.groupBy("image_id", "n", k).agg(F.sum("c").alias("c"))
    h = entropy(joint, "hab").join(entropy(one("i"), "ha"), "image_id").join(entropy(one("j"), "hb"), "image_id").join(ends.select("image_id", "n"), "image_id")
    shared = F.col("ha") + F.col("hb") - F.col("hab")
    enough = F.col("n") >= least
    return h.select(
        "image_id", "n", F.when(enough, F.try_divide(2 * shared, F.col("ha") + F.col("hb"))).alias("nmi"), F.when(enough, F.try_divide(shared, F.col("hab"))).alias("mi_ratio")
    )


def sample_raster(points: DataFrame, pixels: DataFrame, bilinear: bool) -> DataFrame:
    """Adds ``value`` at points (image_id, px, py): the nearest pixel (cut off and clamped), or the weighted four around; voids take the image's mean."""
    ends = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"), F.avg("v").alias("mean"))
    # One row for each image; points of few images would meet in few tasks if they were shuffled by image.
    placed = points.join(F.broadcast(ends), "image_id").withColumns({"qx": F.least(F.greatest(F.col("px"), lit(0)), F.col("mx")), "qy": F.least(F.greatest(F.col("py"), lit(0)), F.col("my"))})
    placed = placed.withColumns({"x": F.floor("qx"), "y": F.floor("qy")})
    if not bilinear:
        return placed.join(pixels.select(*PIXEL, "v"), PIXEL, "left").select(*points.columns, F.coalesce("v", "mean").alias("value"))
    # The four pixels around come as one row, so a point is shuffled once, not once for each of them.
    sides = [(dx, dy) for dx in (0, 1) for dy in (0, 1)]
    corner = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in sides))).alias("d")
    spread = pixels.select(*PIXEL, "v", corner).select("image_id", (F.col("x") - F.col("d.dx")).alias("x"), (F.col("y") - F.col("d.dy")).alias("y"), "v", "d.dx", "d.dy")
    fours = spread.groupBy(*PIXEL).agg(*(F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("v"))).alias(f"_{dx}{dy}") for dx, dy in sides))
    found = placed.join(fours, PIXEL, "left")
    last = {"x": F.col("x") + 1 > F.col("mx"), "y": F.col("y") + 1 > F.col("my")}

    def value(dx: int, dy: int) -> Column:
        in_row = lambda ky: F.when(last["x"], F.col(f"_0{ky}")).otherwise(F.col(f"_1{ky}")) if dx else F.col(f"_0{ky}")
        return F.coalesce(F.when(last["y"], in_row(0)).otherwise(in_row(1)) if dy else in_row(0), F.col("mean"))

    wx, wy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    weighted = [(wx if dx else 1 - wx) * (wy if dy else 1 - wy) * value(dx, dy) for dx, dy in sides]
    return found.select(*points.columns, reduce(lambda p, q: p + q, weighted).alias("value"))


def known(c: str | Column) -> Column:
    """The value if it is a finite number, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def stretch01(pixels: DataFrame) -> DataFrame:
    """Values brought to [0, 1] between the 1st and 99th percentile of their image's finite ones; 0 for an image without spread, NaN stays."""
    ends = pixels.groupBy("image_id").agg(F.percentile(known("v"), F.lit(0.01)).alias("low"), F.percentile(known("v"), F.lit(0.99)).alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), F.when(F.isnan("v"), F.col("v")).otherwise(clip((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")), 0, 1)))
    return pixels.join(ends, "image_id").select(*PIXEL, F.when(F.col("v").isNotNull(), F.coalesce(scaled, lit(0))).alias("v"))


def shadow_mask(pixels: DataFrame, share: float = 0.03, geometry: DataFrame | None = None, limit: float = 85.0) -> DataFrame:
    """Adds ``shadow``: values at or below a percentile of their image's finite ones, and values that are missing or not finite.

    With ``geometry`` (image_id, incidence), an image whose incidence is at
    least ``limit`` degrees is all shadow. An image without any finite value has none.
    """
    cut = pixels.groupBy("image_id").agg(F.percentile(known("v"), F.lit(share)).alias("cut"))
    both = pixels.join(cut, "image_id")
    low = F.coalesce(known("v") <= F.col("cut"), F.lit(True)) & F.col("cut").isNotNull()
    if geometry is not None:
        both = both.join(geometry.select("image_id", F.col("incidence").alias("_incidence")), "image_id", "left")
        low = low | (F.coalesce(F.col("_incidence") >= limit, F.lit(False)) & F.col("cut").isNotNull())
    return both.select(*PIXEL, "v", low.alias("shadow"))


def destripe(pixels: DataFrame) -> DataFrame:
    """Every column of a positive median scaled so that its median is the median of column medians.

    Other columns stay as they are, and so does an image whose median of medians is 0 or unknown.
    """
    medians = pixels.groupBy("image_id", "x").agg(F.percentile(known("v"), F.lit(0.5)).alias("m"))
    goal = medians.groupBy("image_id").agg(F.percentile("m", F.lit(0.5)).alias("goal"))
    scaled = F.when((F.col("m") > 0) & (F.col("goal") != 0), F.col("v") * F.col("goal") / F.greatest("m", lit(1e-6))).otherwise(F.col("v"))
    return pixels.join(medians, ["image_id", "x"]).join(goal, "image_id").select(*PIXEL, scaled.alias("v"))


def resample_area(pixels: DataFrame, factor: float) -> DataFrame:
    """Area averages on a grid ``factor`` (1 or more) times as coarse; a pixel on an edge counts to both sides by its share."""

    def parts(c: str) -> Column:
        first = F.floor(F.col(c) / factor)
        shares = F.transform(
            F.sequence(first, F.ceil((F.col(c) + 1) / factor) - 1),
            lambda k: F.struct(k.alias("at"), (F.least(F.col(c) + 1.0, (k + 1) * factor) - F.greatest(F.col(c) * 1.0, k * factor)).alias("w")),
        )
        return F.filter(shares, lambda s: s["w"] > 1e-12)

    spread = pixels.withColumn("px", F.explode(parts("x"))).withColumn("py", F.explode(parts("y")))
    w = F.col("px.w") * F.col("py.w")
    return spread.groupBy("image_id", F.col("px.at").alias("x"), F.col("py.at").alias("y")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))


#: Constants of the simplified disk function: single scattering albedo, lobe shape and weight, opposition height and width. Fixed values.
HAPKE = {"w": 0.21, "b": 0.21, "c": 0.7, "B0": 0.9, "h": 0.07}


def disk_function(model: str, incidence: Column, emission: Column, phase: Column) -> Column:
    """What an image's brightness is divided by, of angles in degrees: "hapke", "none", or else lunar_lambert.

    A missing incidence or emission has cosine 1, a missing phase is 0. Cosines and the result are 1e-6 at least.
    """
    least = 1e-6
    cosine = lambda a: F.greatest(F.coalesce(F.cos(F.radians(a)), lit(1)), lit(least))
    i, e = cosine(incidence), cosine(emission)
    if model == "none":
        return lit(1)
    if model != "hapke":
        share = F.exp(-F.abs(F.coalesce(phase, lit(0))) / 60)
        return F.greatest((1 - share) * 2 * i / (i + e) + share * i, lit(least))
    g = F.radians(F.coalesce(phase, lit(0)))
    b, c = HAPKE["b"], HAPKE["c"]
    lobe = lambda sign: (1 - b * b) / F.pow(1 + sign * 2 * b * F.cos(g) + b * b, lit(1.5))
    scatter = (1 - c) * lobe(1) + c * lobe(-1)
    opposition = HAPKE["B0"] / (1 + F.tan(F.abs(g) / 2) / HAPKE["h"])
    return F.greatest(HAPKE["w"] / 4 / math.pi * i / (i + e) * ((1 + opposition) * scatter + 1), lit(least))


def photometric_correct(pixels: DataFrame, geometry: DataFrame, model: str) -> DataFrame:
    """Values divided by their image's ``disk_function`` of ``geometry`` (image_id, incidence, emission, and phase if there is one)."""
    phase = F.col("phase") if "phase" in geometry.columns else F.lit(None).cast("double")
    per_image = geometry.select("image_id", disk_function(model, F.col("incidence"), F.col("emission"), phase).alias("factor"))
    return pixels.join(per_image, "image_id").select(*PIXEL, (F.col("v") / F.col("factor")).alias("v"))


def fill_voids(dem: DataFrame) -> DataFrame:
    """Elevations with missing and infinite ones replaced by the mean of their image's others, 0 if it has none."""
    mean = dem.groupBy("image_id").agg(F.avg(known("v")).alias("_mean"))
    return dem.join(mean, "image_id").withColumn("v", F.coalesce(known("v"), F.col("_mean"), lit(0))).drop("_mean")


def horn_slope(dem: DataFrame, gsd: float) -> DataFrame:
    """Adds dzdx, dzdy and slope_deg of (image_id, x, y, v) elevations; edges mirror."""
    g = gradients(dem, mirror=True)
    dx, dy = F.col("sobel_x") / (8 * gsd), F.col("sobel_y") / (8 * gsd)
    return g.withColumns({"dzdx": dx, "dzdy": dy}).withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.col("dzdx") ** 2 + F.col("dzdy") ** 2))))


def central_slope(dem: DataFrame, gsd: float) -> DataFrame:
    """(image_id, x, y, v): rise over run by central differences, one-sided at an edge."""

    def rate(line: str, across: str) -> Column:
        window = Window.partitionBy("image_id", across).orderBy(line)
        before, after = F.lag("v").over(window), F.lead("v").over(window)
        has = F.lag("x").over(window).isNotNull().cast("int") + F.lead("x").over(window).isNotNull().cast("int")
        ends = F.when(F.lead("x").over(window).isNotNull(), after).otherwise(F.col("v")) - F.when(F.lag("x").over(window).isNotNull(), before).otherwise(F.col("v"))
        return F.try_divide(ends, has * gsd)

    return dem.withColumns({"_dx": rate("x", "y"), "_dy": rate("y", "x")}).select(*PIXEL, F.sqrt(F.pow("_dx", lit(2)) + F.pow("_dy", lit(2))).alias("v"))


def terrain_metrics(dem: DataFrame, gsd: float, least: int = 4) -> DataFrame:
    """(image_id, mean_slope, max_slope, mean_laplacian, roughness).

    Voids take the mean of their image. The Laplacian is that of two Sobel
    second derivatives, over the squared ground distance, at its absolute mean;
    roughness is the deviation from the least-squares plane. Images of fewer than
    ``least`` rows or columns, or without any elevation, have NULL figures.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("v")
    known_any = dem.groupBy("image_id").agg(F.count(known("v")).alias("_known"))
    curved = 2 * (F.col("nw") + F.col("ne") + F.col("sw") + F.col("se")) - 8 * z
    s = horn_slope(fill_voids(dem), gsd).withColumn("curved", curved / (gsd * gsd)).groupBy("image_id").agg(
        (F.max(x) - F.min(x)).alias("_w"), (F.max(y) - F.min(y)).alias("_h"),
        F.avg("slope_deg").alias("mean_slope"), F.max("slope_deg").alias("max_slope"), F.avg(F.abs("curved")).alias("mean_laplacian"),
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"), F.var_pop(z).alias("zz"),
    )
    c = F.col
    det = c("xx") * c("yy") - c("xy") * c("xy")
    a, b = F.try_divide(c("xz") * c("yy") - c("yz") * c("xy"), det), F.try_divide(c("yz") * c("xx") - c("xz") * c("xy"), det)
    left = c("zz") - a * c("xz") - b * c("yz")
    s = s.withColumn("roughness", F.when(det > 1e-12, F.sqrt(F.greatest(left, lit(0))))).join(known_any, "image_id")
    valid = (c("_w") >= least - 1) & (c("_h") >= least - 1) & (c("_known") > 0)
    return s.select("image_id", *(F.when(valid, c(m)).alias(m) for m in ("mean_slope", "max_slope", "mean_laplacian", "roughness")))


def cast_shadow(dem: DataFrame, azimuth: float, elevation: float, gsd: float, steps: int) -> DataFrame:
    """Adds ``shadow``: some pixel toward the sun, at most ``steps`` pixels away, rises above the ray.

    Each step goes one pixel along the axis nearer to the sun's azimuth (from
    north, which is up), and the ray rises with the elevation, within 2 to 88 degrees.
    """
    ux, uy = math.sin(math.radians(azimuth % 360)), -math.cos(math.radians(azimuth % 360))
    step = 1 / max(abs(ux), abs(uy), 1e-4)
    rise = math.tan(math.radians(min(max(elevation, 2.0), 88.0))) * max(gsd, 1e-3) * step
    ahead = [(round(k * ux * step), round(k * uy * step), rise * k) for k in range(1, int(steps / step + 1e-9) + 1)]
    rays = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), lit(up).alias("up")) for dx, dy, up in dict.fromkeys(ahead)))
    asked = dem.select(*PIXEL, "v", F.explode(rays).alias("r"))
    asked = asked.select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("r.dx")).alias("x"), (F.col("y") + F.col("r.dy")).alias("y"), (F.col("v") + F.col("r.up")).alias("ray"))
    hit = asked.join(dem.select(*PIXEL, F.col("v").alias("z")), PIXEL).groupBy("image_id", "x0", "y0").agg(F.max(F.col("z") > F.col("ray")).alias("hit"))
    return dem.join(hit.toDF(*PIXEL, "hit"), PIXEL, "left").select(*PIXEL, "v", F.coalesce("hit", F.lit(False)).alias("shadow"))


def hillshade(dem: DataFrame, azimuth: float, elevation: float, gsd: float, z_factor: float = 1.0, shadow_px: int = 150) -> DataFrame:
    """(image_id, x, y, shade) in [0, 1] of a sun at an azimuth and an elevation (5 to 85) in degrees; 0 in the shadow of what lies within ``shadow_px`` pixels.

    Voids take the mean of their image, edges mirror. The slope's aspect is
    atan2(dzdx, -dzdy) with y down the image, and the sun stands at 90 degrees
    less its azimuth.
    """
    filled, e = fill_voids(dem), math.radians(min(max(elevation, 5.0), 85.0))
    turn = math.radians((450 - azimuth % 360) % 360)
    dx, dy = F.col("dzdx") * z_factor, F.col("dzdy") * z_factor
    light = (math.sin(e) + math.cos(e) * (dx * math.sin(turn) - dy * math.cos(turn))) / F.sqrt(1 + dx * dx + dy * dy)
    shade = horn_slope(filled, gsd).select(*PIXEL, clip(light, 0, 1).alias("shade"))
    if shadow_px < 1:
        return shade
    dark = cast_shadow(filled, azimuth, math.degrees(e), gsd, shadow_px).select(*PIXEL, "shadow")
    return shade.join(dark, PIXEL).select(*PIXEL, F.when(F.col("shadow"), lit(0)).otherwise(F.col("shade")).alias("shade"))


#: Neighbours in the order of their bits.
CENSUS = ("nw", "n", "ne", "w", "e", "sw", "s", "se")
LBP = ("nw", "n", "ne", "e", "se", "s", "sw", "w")


def bit_code(pixels: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(image_id, x, y, code): one bit for each neighbour that isn't below the centre, in the given order."""
    code = sum(F.when(F.col(n) >= F.col("v"), F.lit(1 << k)).otherwise(0) for k, n in enumerate(order))
    return neighbours(pixels).select(*PIXEL, code.cast("bigint").alias("code"))


def census(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, code): bits of the stretched image, row by row around the centre."""
    return bit_code(stretch01(pixels), CENSUS)


def lbp(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, code, value): bits around the centre of the stretched image cut to 8 bits, clockwise from the upper left; value is code / 255."""
    grey = stretch01(pixels)
    ends = grey.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    level = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), lit(0)) * 255)
    cut = grey.join(ends, "image_id").select(*PIXEL, level.cast("double").alias("v"))
    return bit_code(cut, LBP).withColumn("value", F.col("code") / 255)


def profile_shift(a: DataFrame, b: DataFrame, max_shift: int) -> DataFrame:
    """(image_id, axis, shift, score): the shift of a's row or column profile at which it correlates best with b's; ties to the smaller.

    A profile is the line means of 0.6 times the image plus 0.4 times its Sobel
    gradient magnitude, each less its mean over the image and over its deviation,
    unless that is 1e-6 or less; edges mirror. The score is the sum of products
    over the lines that both have, over the product of both profiles' norms.
    """

    def lines(df: DataFrame) -> DataFrame:
        """(image_id, axis, k, p, n): each line's mean of the blend, n the norm of its profile."""
        g = gradients(df, mirror=True).select(*PIXEL, "v", F.sqrt(F.pow("sobel_x", lit(2)) + F.pow("sobel_y", lit(2))).alias("g"))
        # The blend is linear, so its line means follow from those of both parts; pixels meet no figures of their image.
        both = F.col("v").isNotNull() & F.col("g").isNotNull()
        pixels = materialize(g, "profile-pixels")
        parts = [f(c).alias(n + c) for c in "vg" for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_pop))]
        lines_of = lambda axis: pixels.groupBy("image_id", F.lit(axis).alias("axis"), F.col(axis).alias("k")).agg(*parts, *(F.avg(F.when(both, F.col(c))).alias("l" + c) for c in "vg"))
        each = materialize(lines_of("x").union(lines_of("y")), "profile-lines")
        mean = lambda c: F.try_divide(F.sum(F.col("n" + c) * F.col("m" + c)), F.sum("n" + c))
        means = each.groupBy("image_id", "axis").agg(*(mean(c).alias("a" + c) for c in "vg"))
        spread = lambda c: F.sqrt(F.try_divide(F.sum(F.col("n" + c) * (F.col("s" + c) + F.pow(F.col("m" + c) - F.col("a" + c), lit(2)))), F.sum("n" + c)))
        figures = each.join(means, ["image_id", "axis"]).groupBy("image_id", "axis").agg(*(F.first("a" + c).alias("a" + c) for c in "vg"), *(spread(c).alias("d" + c) for c in "vg"))
        z = lambda c: (F.col("l" + c) - F.col("a" + c)) / F.when(F.col("d" + c) > 1e-6, F.col("d" + c)).otherwise(lit(1))
        profile = each.join(figures, ["image_id", "axis"]).select("image_id", "axis", "k", (0.6 * z("v") + 0.4 * z("g")).alias("p"))
        return profile.withColumn("n", F.sqrt(F.sum(F.col("p") * F.col("p")).over(Window.partitionBy("image_id", "axis"))))

    one, two = lines(a).withColumnRenamed("n", "np"), lines(b).toDF("image_id", "axis", "k", "q", "nq")
    shifts = one.select("*", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))).alias("shift")).withColumn("k", F.col("k") + F.col("shift"))
    score = shifts.join(two, ["image_id", "axis", "k"]).groupBy("image_id", "axis", "shift").agg((F.sum(F.col("p") * F.col("q")) / (F.first("np") * F.first("nq") + 1e-9)).alias("score"))
    best = score.groupBy("image_id", "axis").agg(F.max_by(F.struct("shift", "score"), F.struct(F.round("score", 9), -F.abs("shift"), -F.col("shift"))).alias("b"))
    return best.select("image_id", "axis", "b.shift", "b.score")


def spectral_angle(cube: DataFrame, key: str = "image_id", reference: list[float] | None = None) -> DataFrame:
    """Adds ``angle`` (radians) between each pixel's bands and a reference, by default the mean spectrum of its image.

    The angle's cosine is the product over that of the lengths and 1e-8, so a spectrum without length lies at right angles.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), lit(0), lambda s, v: s + v)
    if reference is None:
        mean = cube.select(key, F.posexplode("bands").alias("band", "v")).groupBy(key, "band").agg(F.avg("v").alias("m"))
        spectrum = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "m"))), lambda s: s["m"]).alias("ref"))
        cube = cube.join(spectrum, key)
    else:
        cube = cube.withColumn("ref", F.array(*map(lit, reference)))
    size = F.sqrt(dot("bands", "bands")) * F.sqrt(dot("ref", "ref")) + 1e-8
    return cube.withColumn("angle", F.acos(clip(dot("bands", "ref") / size, -1, 1))).drop("ref")


def sam_gate(overlay: DataFrame, angles: DataFrame, limit: float = 0.35, fill: float | None = None) -> DataFrame:
    """(image_id, x, y, v, valid): overlay pixels (image_id, x, y, v) whose spectral angle is over ``limit`` or unknown are filled.

    The filling is ``fill``, or the median of the finite values of the whole overlay image, 0 if it has none.
    """
    angle = angles.select(*PIXEL, known("angle").alias("_angle"))
    middle = overlay.groupBy("image_id").agg(F.percentile(known("v"), F.lit(0.5)).alias("_fill"))
    both = overlay.join(angle, PIXEL, "left").join(middle, "image_id")
    valid = F.coalesce(F.col("_angle") <= limit, F.lit(False))
    return both.select(*PIXEL, F.when(valid, F.col("v")).otherwise(lit(fill) if fill is not None else F.coalesce("_fill", lit(0))).alias("v"), valid.alias("valid"))


def sam_gate_summary(gated: DataFrame) -> DataFrame:
    """(image_id, num_valid, num_rejected, rejected_fraction)."""
    return gated.groupBy("image_id").agg(
        F.count_if("valid").alias("num_valid"), F.count_if(~F.col("valid")).alias("num_rejected"), F.avg((~F.col("valid")).cast("double")).alias("rejected_fraction")
    )


def spectral_residuals(cube: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, spectral_variance, spectral_angle_deg): the mean over pixels of the variance of their bands, and of their angle to the mean spectrum.

    Cubes of one band have 0 for both.
    """
    n = F.size("bands")
    mean = F.aggregate("bands", lit(0), lambda s, v: s + v) / n
    spread = F.aggregate(F.transform("bands", lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))), lit(0), lambda s, v: s + v) / n
    one = spectral_angle(cube, key).withColumn("_mean", mean)
    one = one.select(key, F.when(n > 1, spread).otherwise(lit(0)).alias("s"), F.when(n > 1, F.col("angle")).otherwise(lit(0)).alias("a"))
    return one.groupBy(key).agg(F.avg("s").alias("spectral_variance"), F.degrees(F.avg("a")).alias("spectral_angle_deg"))


@F.pandas_udf(DoubleType())
def c_tangent(angles: pd.Series) -> pd.Series:
    return angles.map(lambda a: math.tan(a) if math.isfinite(a) else math.nan)


def disparity_to_dem(disparity: DataFrame, views: DataFrame, datum: float = 0.0) -> DataFrame:
    """(image_id, x, y, z): elevations from a disparity table and each stereo pair's fore and aft angles and ground distance.

    Lines of sight that are parallel meet at infinity: such a pair's elevations are infinite, NaN for a disparity of 0.
    Of nearly parallel ones the last bit of a tangent decides the ratio, so tangents are the C library's, not Java's.
    """
    tangent = lambda c: F.when(F.abs(c) < float("inf"), c_tangent(F.radians(c))).otherwise(F.tan(F.radians(c)))
    ratio = tangent(F.col("fore")) - tangent(F.col("aft"))
    both = disparity.join(views.select("image_id", "gsd", ratio.alias("ratio")), "image_id")
    height = F.when(F.col("ratio") == 0, F.col("v") * F.col("gsd") * float("inf")).otherwise(F.try_divide(F.col("v") * F.col("gsd"), F.col("ratio")))
    return both.select(*PIXEL, (datum + height).alias("z"))
