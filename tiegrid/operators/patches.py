"""Patches around keypoints: displacement search, descriptors, structural similarity, relief."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiegrid.functions.algebra import clip, lit
from tiegrid.operators.raster import PIXEL, central_slope, gradients, known, sample_raster
from tiegrid.plans.work import materialize


def sorted_join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """A join that broadcasts neither side: exploded patches are so regular that their shuffled files look small, but their rows aren't."""
    return df.hint("merge").join(other.hint("merge"), on)


def offsets(low: int, high: int) -> Column:
    steps = [(dx, dy) for dx in range(low, high + 1) for dy in range(low, high + 1)]
    return F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))


#: Keypoints whose displacements are worked out at once.
AT_ONCE = 500


def around(pixels: DataFrame, keypoints: DataFrame, half: int, name: str) -> DataFrame:
    """(image_id, kp_id, ``name``): the pixels up to ``half`` from each keypoint, as a list of ``k``, which counts column by column, and the other columns.

    Pixels are gathered in cells as wide as a patch and meet the keypoints of up
    to four of them there; no pixel is a row of its own for each keypoint.
    """
    side = 2 * half + 1
    values = [c for c in pixels.columns if c not in PIXEL]
    cell = lambda c: F.floor(F.col(c) / side).cast("bigint")
    cells = pixels.groupBy("image_id", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.collect_list(F.struct("x", "y", *values)).alias("pixels"))
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / side).cast("bigint"), F.floor((F.col(c) + half) / side).cast("bigint")))
    whole = keypoints.filter("kx = floor(kx) AND ky = floor(ky)").select("image_id", "kp_id", F.col("kx").cast("bigint").alias("kx"), F.col("ky").cast("bigint").alias("ky"))
    asked = whole.withColumn("cx", reach("kx")).withColumn("cy", reach("ky"))
    inside = F.filter("pixels", lambda q: (F.abs(q["x"] - F.col("kx")) <= half) & (F.abs(q["y"] - F.col("ky")) <= half))
    slot = lambda q: ((q["x"] - F.col("kx") + half) * side + q["y"] - F.col("ky") + half).cast("int")
    part = F.transform(inside, lambda q: F.struct(slot(q).alias("k"), *(q[v].cast("double").alias(v) for v in values)))
    return sorted_join(asked, cells, ["image_id", "cx", "cy"]).select("image_id", "kp_id", part.alias(name)).groupBy("image_id", "kp_id").agg(F.flatten(F.collect_list(name)).alias(name))


def dense(lists: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (column, row, slot) of lists of (k, columns), NULL ones as NaN, and how many pixels (row, slot) there are, NULL ones as a half of one."""
    k, *columns = lists.flatten().flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    at = (row, k.to_numpy(zero_copy_only=False))
    count, values = np.zeros((len(lists), size)), np.full((len(columns), len(lists), size), np.nan)
    np.add.at(count, at, 1)
    for v, c in zip(values, columns, strict=True):
        v[at] = c.to_numpy(zero_copy_only=False)
    known = np.zeros((len(lists), size), bool)
    known[at] = columns[0].is_valid().to_numpy(zero_copy_only=False)
    return values, np.where(known | (count != 1), count, 0.5)


class _Displacements:
    """Rows (image_id, kp_id, dx, dy, ncc, and with ``multimodal`` goa, rank, and a and b, the pixels, of the ``top`` ones) of (image_id, kp_id, a, b), lists as of ``around``.

    Displacements at which a pixel is missing, or that have no correlation, give no row.
    """

    def __init__(self, half: int, radius: int, multimodal: bool, by_goa: bool, top: int) -> None:
        self.half, self.radius, self.multimodal, self.by_goa, self.top = half, radius, multimodal, by_goa, top

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield self.rows(batch.slice(at, AT_ONCE))

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        side, wide, steps = 2 * self.half + 1, 2 * (self.half + self.radius) + 1, 2 * self.radius + 1
        a, has_a = dense(batch.column(2), side * side)
        b, has_b = dense(batch.column(3), wide * wide)
        b, has_b = b.reshape(len(b), -1, wide, wide), has_b.reshape(-1, wide, wide)
        moved = [(slice(dx, dx + side), slice(dy, dy + side)) for dx in range(steps) for dy in range(steps)]
        cut = lambda c, m: c[..., m[0], m[1]].reshape(*c.shape[:-2], -1)
        n = batch.num_rows
        ncc, goa = np.full((n, len(moved)), np.nan), np.full((n, len(moved)), np.nan)
        one_a = ((has_a == 1) | (has_a == 0.5)).all(1)
        with np.errstate(all="ignore"):
            for k, m in enumerate(moved):
                v, has = cut(b, m), cut(has_b, m)
                both = (has_a == 1) & (has == 1)
                found = correlation(a[0], v[0], both)
                ncc[:, k] = np.where(one_a & ((has == 1) | (has == 0.5)).all(1), found, np.nan)
                if self.multimodal:
                    goa[:, k] = agreement(a[1], a[2], v[1], v[2])
        good = ~np.isnan(ncc)
        row, k = np.nonzero(good)
        columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(k // steps - self.radius, pa.int32()), pa.array(k % steps - self.radius, pa.int32()), pa.array(ncc[row, k])]
        if self.multimodal:
            by = goa if self.by_goa else ncc
            # The largest first, as Spark orders them (NaN is the largest); a stable sort keeps the smaller displacement before.
            order = np.argsort(np.where(good, -np.where(np.isnan(by), np.inf, by), np.nan), axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(1, len(moved) + 1)[None, :].repeat(n, 0), 1)
            rank, few = rank[row, k], rank[row, k] <= self.top
            r, x, y = row[few], (k // steps)[few, None] + np.repeat(np.arange(side), side), (k % steps)[few, None] + np.tile(np.arange(side), side)
            lists = ((a[0][r], has_a[r]), (b[0][r[:, None], x, y], has_b[r[:, None], x, y]))
            columns += [pa.array(goa[row, k]), pa.array(rank, pa.int32()), *(listed(v, has == 1, few) for v, has in lists)]
        return pa.RecordBatch.from_arrays(columns, names=["image_id", "kp_id", "dx", "dy", "ncc", "goa", "rank", "a", "b"][: len(columns)])


def listed(values: np.ndarray, known: np.ndarray, where: np.ndarray) -> pa.ListArray:
    """A list column that has the rows of ``values``, NULL where not ``known``, at the places ``where``, and NULL elsewhere."""
    ends = np.concatenate(([0], np.cumsum(where * values.shape[1])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel(), mask=~known.ravel()), mask=pa.array(~where))


def correlation(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Of each row's values where ``both``; NaN where a side is flat."""
    n = both.sum(1)

    def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.where(both, v, np.inf).min(1), np.where(both, v, -np.inf).max(1)
        off = np.where(both, v - low[:, None], 0)
        off = np.where(both, off - (off.sum(1) / n)[:, None], 0)
        return off, np.where(low == high, 0, np.sqrt((off * off).sum(1) / n))

    (p, sp), (q, sq) = centred(a), centred(b)
    size = sp * sq
    return np.where(size == 0, np.nan, (p * q).sum(1) / n / size)


def agreement(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Orientation agreement of each row's gradients, weighted by their sizes; 0.5 where these vanish."""
    double_cos = (ax**2 - ay**2) * (bx**2 - by**2) + 4 * ax * ay * bx * by
    sizes = (ax**2 + ay**2) * (bx**2 + by**2)
    w = np.sqrt(sizes)
    total = w.sum(1)
    return np.where(total < 1e-8, 0.5, (w * 0.5 * (double_cos / (sizes + 1e-8) + 1)).sum(1) / total)


def search_displacement(
    source: DataFrame, target: DataFrame, keypoints: DataFrame, half: int, radius: int, apart: int = 5, multimodal: bool = False, preselect: str = "orientation", top: int = 5,
    w_mi: float = 0.6, w_ncc: float = 0.4,
) -> DataFrame:
    """(image_id, kp_id, dx, dy, score, ncc, uniqueness) of keypoints (image_id, kp_id, kx, ky).

    A keypoint's patch and the part of the target that it can be moved over meet
    as two lists, and are correlated at every displacement there; uniqueness is that of the best displacement less
    the largest that lies further than ``apart`` from it. Where patch or target
    is flat there is no correlation, and a keypoint of a flat patch gives no row. With ``multimodal``
    the ``top`` displacements by orientation agreement of gradients, or by
    correlation (preselect "ncc"), are ranked by w_mi of their mutual
    information and w_ncc of their correlation, if positive. Ties go to the
    smaller displacement.
    """
    image = lambda df: gradients(df, mirror=True).select(*PIXEL, "v", "sobel_x", "sobel_y") if multimodal else df.select(*PIXEL, "v")
    kp, spot = ["image_id", "kp_id"], ["image_id", "kp_id", "dx", "dy"]
    lists = sorted_join(around(image(source), keypoints, half, "a"), around(image(target), keypoints, half + radius, "b"), kp)
    kinds = {f: lists.schema[f].dataType.simpleString() for f in kp}
    schema = ", ".join(f"{f} {t}" for f, t in kinds.items()) + ", dx int, dy int, ncc double" + (", goa double, rank int, a array<double>, b array<double>" if multimodal else "")
    scored = materialize(lists.mapInArrow(_Displacements(half, radius, multimodal, preselect == "orientation", top), schema), "displacements")
    if multimodal:
        few = scored.filter(F.col("rank") <= top)
        pixels = few.select(*spot, F.explode(F.arrays_zip("a", "b")).alias("p")).select(*spot, "p.a", "p.b")
        joint = few.drop("a", "b").join(mutual_information(pixels, spot), spot, "left")
        value = w_mi * F.coalesce("mi", lit(0)) + w_ncc * F.greatest("ncc", lit(0))
        best = joint.withColumn("score", value).groupBy(*kp).agg(F.max_by(F.struct("dx", "dy", "score", "ncc"), F.struct("score", -F.col("rank"))).alias("m"))
    else:
        best = scored.withColumn("score", F.col("ncc")).groupBy(*kp).agg(F.max_by(F.struct("dx", "dy", "score", "ncc"), F.struct("ncc", -F.col("dx"), -F.col("dy"))).alias("m"))
    far = F.greatest(F.abs(F.col("dx") - F.col("m.dx")), F.abs(F.col("dy") - F.col("m.dy"))) > apart
    rest = scored.select(*spot, "ncc").join(best, kp).groupBy(*kp).agg(F.max(F.when(far, F.col("ncc"))).alias("second"))
    return best.join(rest, kp).select(*kp, "m.dx", "m.dy", "m.score", "m.ncc", (F.col("m.ncc") - F.coalesce("second", lit(0))).alias("uniqueness"))


def mutual_information(pixels: DataFrame, keys: list[str], bins: int = 32) -> DataFrame:
    """(keys, mi) of pairs (keys, a, b): mutual information over joint entropy of ``bins`` x ``bins`` histograms, in nats; 0 for a flat side."""
    ends = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("low", F.min), ("high", F.max), ("sd", F.stddev_pop)))
    )
    slot = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"low_{c}")) / ((F.col(f"high_{c}") - F.col(f"low_{c}") + 1e-6) / bins)).cast("int"))
    joint = pixels.join(ends, keys).groupBy(*keys, "n", "sd_a", "sd_b", slot("a").alias("i"), slot("b").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    w = lambda k: Window.partitionBy(*keys, *k)
    p = F.col("c") / F.col("n")
    sides = joint.withColumns({"pi": F.sum("c").over(w(["i"])) / F.col("n"), "pj": F.sum("c").over(w(["j"])) / F.col("n")})
    mi, entropy = F.sum(p * F.ln((p + 1e-12) / (F.col("pi") * F.col("pj") + 1e-12))), -F.sum(p * F.ln(p + 1e-12))
    flat = (F.col("sd_a") < 1e-6) | (F.col("sd_b") < 1e-6)
    found = sides.groupBy(*keys, "sd_a", "sd_b").agg((mi / F.greatest(entropy, lit(1e-12))).alias("mi"))
    return found.select(*keys, F.when(flat, lit(0)).otherwise(F.col("mi")).alias("mi"))


def spatial_quality(peaks: DataFrame, width: float, height: float) -> DataFrame:
    """Adds ``quality`` in [0.05, 1]: 0.5 of the peak's uniqueness, 0.35 of the refinement's tightness, 0.15 of the distance to the frame.

    A missing uniqueness counts 0.5. A refinement by d px (``refine_px``) counts
    exp(-0.75 d) within [0.15, 1], none 0.35. The distance to the frame counts
    over half the shorter side, at least 0.05; a point without a place 0.5.
    """
    unique = F.coalesce(clip(F.col("uniqueness"), 0, 1), lit(0.5))
    tight = F.coalesce(clip(F.exp(-0.75 * F.col("refine_px")), 0.15, 1), lit(0.35))
    placed = F.col("kx").isNotNull() & F.col("ky").isNotNull() & F.lit(width > 1 and height > 1)
    inside = F.least(F.col("kx"), F.col("ky"), width - F.col("kx"), height - F.col("ky")) / (0.5 * min(width, height))
    border = F.when(placed, clip(inside, 0.05, 1)).otherwise(lit(0.5))
    return peaks.withColumn("quality", clip(0.5 * unique + 0.35 * tight + 0.15 * border, 0.05, 1))


def patch_gradients(pixels: DataFrame, points: DataFrame, half: int, x: str, y: str) -> DataFrame:
    """(image_id, kp_id, x, y, gx, gy): Sobel gradients within the patch of each point (image_id, kp_id, x, y), counted from its centre.

    A patch spans ``half`` pixels before its centre and half - 1 behind it, and
    is mirrored at its own edges, not filled from the image around it.
    """
    near = points.select("image_id", "kp_id", F.bround(x).cast("bigint").alias("kx"), F.bround(y).cast("bigint").alias("ky"), F.explode(offsets(-half, half - 1)).alias("o"))
    near = near.select("image_id", "kp_id", (F.col("kx") + F.col("o.dx")).alias("x"), (F.col("ky") + F.col("o.dy")).alias("y"), "o")
    patch = sorted_join(near, pixels.select(*PIXEL, "v"), PIXEL).select(F.struct("image_id", "kp_id").alias("image_id"), F.col("o.dx").alias("x"), F.col("o.dy").alias("y"), "v")
    g = gradients(patch, mirror=True)
    return g.select("image_id.image_id", "image_id.kp_id", "x", "y", F.col("sobel_x").alias("gx"), F.col("sobel_y").alias("gy"))


def orientation_histogram(pixels: DataFrame, keypoints: DataFrame, half: int = 8, bins: int = 8) -> DataFrame:
    """(image_id, kp_id, desc): orientations over the full circle, weighted by gradient, in 2 x 2 cells of ``bins``, of unit length.

    Patches are cut off at the image's edges; their cells are the halves of
    what is left, an odd last row or column going to none. A keypoint with a
    patch of fewer than 9 pixels, or a flat one, has zeros.
    """
    g = patch_gradients(pixels, keypoints, half, "kx", "ky")
    kp = Window.partitionBy("image_id", "kp_id")
    low = lambda c: F.min(c).over(kp)
    side = lambda c: F.greatest(F.lit(1), F.floor((F.max(c).over(kp) - F.min(c).over(kp) + 1) / 2))
    g = g.withColumns({"cx": F.floor((F.col("x") - low("x")) / side("x")), "cy": F.floor((F.col("y") - low("y")) / side("y")), "size": F.count(F.lit(1)).over(kp)})
    turn = (F.atan2("gy", "gx") + math.pi) / (2 * math.pi) * bins
    slot = (F.col("cy") * 2 + F.col("cx")).cast("int") * bins + clip(F.floor(turn), 0, bins - 1).cast("int")
    kept = g.filter((F.col("cx") < 2) & (F.col("cy") < 2) & (F.col("size") >= 9))
    summed = kept.groupBy("image_id", "kp_id", slot.alias("k")).agg(F.sum(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).alias("m"))
    total = summed.groupBy("image_id", "kp_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("h"))
    value = lambda k: F.when(F.col("norm") > 1e-8, F.coalesce(F.try_element_at("h", k), lit(0)) / F.col("norm")).otherwise(lit(0))
    described = total.select("image_id", "kp_id", F.transform(F.sequence(F.lit(0), F.lit(4 * bins - 1)), value).alias("desc"))
    empty = F.array_repeat(lit(0), 4 * bins)
    return keypoints.select("image_id", "kp_id").join(described, ["image_id", "kp_id"], "left").select("image_id", "kp_id", F.coalesce("desc", empty).alias("desc"))


def orientation_agreement(a: DataFrame, b: DataFrame, pairs: DataFrame, half: int = 8) -> DataFrame:
    """(image_id, kp_id, agreement) in [0, 1] of points (image_id, kp_id, x1, y1, x2, y2): 1 for parallel or opposite gradients, 0 for right angles.

    The mean of (1 + cos 2d) / 2 over both patches, weighted by the product of
    their gradients; 0.5 where these vanish or a patch isn't whole.
    """
    one = patch_gradients(a, pairs, half, "x1", "y1").toDF("image_id", "kp_id", "x", "y", "ax", "ay")
    two = patch_gradients(b, pairs, half, "x2", "y2").toDF("image_id", "kp_id", "x", "y", "bx", "by")
    c = F.col
    double_cos = (c("ax") ** 2 - c("ay") ** 2) * (c("bx") ** 2 - c("by") ** 2) + 4 * c("ax") * c("ay") * c("bx") * c("by")
    sizes = (c("ax") ** 2 + c("ay") ** 2) * (c("bx") ** 2 + c("by") ** 2)
    w = F.sqrt(sizes)
    found = sorted_join(one, two, ["image_id", "kp_id", "x", "y"]).groupBy("image_id", "kp_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * 0.5 * (double_cos / (sizes + 1e-8) + 1)).alias("s")
    )
    good = (c("n") == (2 * half) ** 2) & (c("w") >= 1e-8)
    each = found.select("image_id", "kp_id", F.when(good, clip(c("s") / c("w"), 0, 1)).alias("agreement"))
    return pairs.select("image_id", "kp_id").join(each, ["image_id", "kp_id"], "left").select("image_id", "kp_id", F.coalesce("agreement", lit(0.5)).alias("agreement"))


def inlier_hulls(points: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, hull): the corners of the convex hull of each image's points (image_id, px, py), counter-clockwise, as whole pixels.

    Points are clamped to the frame and cut to whole pixels. Only the lowest
    and highest of each column can be corners, so a task gets twice as many
    points as the image is wide, however many there are. Fewer than 3 points give none.
    """
    x, y = (clip(F.col(c), 0, size - 1).cast("int") for c, size in (("px", width), ("py", height)))
    known_ = points.filter("px IS NOT NULL AND py IS NOT NULL AND NOT isnan(px) AND NOT isnan(py)")
    enough = known_.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("image_id")
    ends = known_.join(enough, "image_id").groupBy("image_id", x.alias("x")).agg(F.min(y).alias("low"), F.max(y).alias("high"))

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = sorted({(int(r.x), int(v)) for r in pdf.itertuples() for v in (r.low, r.high)})

        def half(points: list) -> list:
            out: list = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        ring = half(corners)[:-1] + half(corners[::-1])[:-1] if len(corners) > 1 else corners
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "hull": [[{"x": float(p), "y": float(q)} for p, q in ring]]})

    kind = points.schema["image_id"].dataType.simpleString()
    return ends.groupBy("image_id").applyInPandas(hull, f"image_id {kind}, hull array<struct<x:double,y:double>>")


def ssim_within_inliers(a: DataFrame, b: DataFrame, points: DataFrame, width: int, height: int, span: float, least: int = 36) -> DataFrame:
    """(image_id, n, ssim) in [0, 1] over pixels within the convex hull of the image's inliers (image_id, px, py).

    An image with fewer than 3 inliers, or ``least`` pixels within, is judged
    over all its overlap; one with fewer than that has similarity 0.
    """
    every = ssim_map(a, b, span)
    placed = every.join(inlier_hulls(points, width, height), "image_id", "left")
    turned = F.concat(F.slice("hull", 2, F.greatest(F.size("hull") - 1, F.lit(0))), F.slice("hull", 1, 1))
    left = lambda e: (e["q"]["x"] - e["p"]["x"]) * (F.col("y") - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (F.col("x") - e["p"]["x"]) >= 0
    edges = F.zip_with("hull", turned, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    inside = F.coalesce(F.forall(edges, left), F.lit(True))
    s = placed.withColumn("inside", inside).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.avg("s").alias("s_all"), F.count_if("inside").alias("n_in"), F.avg(F.when(F.col("inside"), F.col("s"))).alias("s_in")
    )
    use = F.col("n_in") >= least
    n, value = F.when(use, F.col("n_in")).otherwise(F.col("n_all")), F.when(use, F.col("s_in")).otherwise(F.col("s_all"))
    return s.select("image_id", n.alias("n"), F.when(n >= least, clip(value, 0, 1)).otherwise(lit(0)).alias("ssim"))


def ssim(a: DataFrame, b: DataFrame, span: float, sigma: float = 1.5) -> DataFrame:
    """(image_id, n, ssim): mean structural similarity under a 7 x 7 Gaussian window, over pixels whose whole window both images have."""
    return ssim_map(a, b, span, sigma).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("ssim"))


def ssim_map(a: DataFrame, b: DataFrame, span: float, sigma: float = 1.5) -> DataFrame:
    """(image_id, x, y, s): structural similarity at each pixel, by two passes of seven taps, along rows and then columns."""
    taps = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-3, 4)]
    taps = [t / sum(taps) for t in taps]
    p, q = F.col("a"), F.col("b")
    both = a.select(*PIXEL, F.col("v").alias("a")).join(b.select(*PIXEL, F.col("v").alias("b")), PIXEL)
    both = both.select(*PIXEL, p.alias("s0"), q.alias("s1"), (p * p).alias("s2"), (q * q).alias("s3"), (p * q).alias("s4"))
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("image_id", line).orderBy(along)
        whole = (F.lead(along, 3).over(w) - F.lag(along, 3).over(w)) == 6
        blur = lambda c: sum(t * (F.col(c) if k == 0 else F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)) for k, t in zip(range(-3, 4), taps, strict=True))  # noqa: E731, B023
        both = both.select(*PIXEL, whole.alias("whole"), *(blur(f"s{k}").alias(f"s{k}") for k in range(5))).filter("whole").drop("whole")
    ma, mb, aa, bb, ab = (F.col(f"s{k}") for k in range(5))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    value = (2 * ma * mb + c1) * (2 * (ab - ma * mb) + c2) / ((ma * ma + mb * mb + c1) * (aa - ma * ma + bb - mb * mb + c2))
    return both.select(*PIXEL, value.alias("s"))


def relief_shift(points: DataFrame, dem: DataFrame, emission: float | None, azimuth: float | None, gsd: float, key: str = "pair_id", id_col: str = "match_id") -> DataFrame:
    """(key, id, shift_x, shift_y, reason): parallax of points (image_id, px, py) from their height over the pair's mean.

    Shifts are 0, with a reason, when emission is below half a degree or unknown, or the azimuth is.
    """
    reason = "emission_missing" if emission is None else "near_nadir" if emission < 0.5 else "azimuth_missing" if azimuth is None else None
    if reason:
        return points.select(key, id_col, lit(0).alias("shift_x"), lit(0).alias("shift_y"), F.lit(reason).alias("reason"))
    z = sample_raster(points.select(key, id_col, "image_id", "px", "py"), dem, True)
    dz = F.col("value") - F.avg("value").over(Window.partitionBy(key))
    scale, a = math.tan(math.radians(emission)) / gsd, math.radians(azimuth)
    return z.select(key, id_col, (dz * scale * math.sin(a)).alias("shift_x"), (-dz * scale * math.cos(a)).alias("shift_y"), F.lit(None).cast("string").alias("reason"))


def slope_residual_corr(points: DataFrame, dem: DataFrame, gsd: float, key: str = "pair_id") -> DataFrame:
    """(key, n, correlation) of ``error`` and the slope, rise over run, at the pixels nearest to points (image_id, px, py).

    Points beyond an edge take its pixel; n counts those of which both figures
    are finite. 0 below 4 of them or without spread.
    """
    slope = central_slope(dem, max(gsd, 1e-6))
    # One row for each image; points of few images would meet in few tasks if they were shuffled by image.
    ends = slope.groupBy("image_id").agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    near = lambda c, most: F.least(F.greatest(F.bround(c).cast("bigint"), F.lit(0)), F.col(most))
    placed = points.select(key, "image_id", "px", "py", known("error").alias("error")).join(F.broadcast(ends), "image_id").withColumns({"x": near("px", "_mx"), "y": near("py", "_my")})
    at = placed.join(slope.select(*PIXEL, known("v").alias("slope")), PIXEL, "left")
    both = F.col("error").isNotNull() & F.col("slope").isNotNull()
    s = at.groupBy(key).agg(F.count_if(both).alias("n"), F.covar_pop("error", "slope").alias("c"), F.stddev_pop(F.when(both, F.col("error"))).alias("se"), F.stddev_pop(F.when(both, F.col("slope"))).alias("ss"))
    good = (F.col("n") >= 4) & (F.col("se") >= 1e-12) & (F.col("ss") >= 1e-12)
    return s.select(key, "n", F.coalesce(F.when(good, F.col("c") / (F.col("se") * F.col("ss"))), lit(0)).alias("correlation"))
