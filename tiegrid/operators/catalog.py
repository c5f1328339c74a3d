"""Catalogs of image products: sensors, footprints, overlaps in space and time, merges."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tiegrid.functions.algebra import clip, let, lit
from tiegrid.plans.work import materialize

MOON_RADIUS_M = 1_737_400.0
DEG_M = math.pi / 180 * MOON_RADIUS_M
#: Nominal ground sample distances in metres by canonical sensor: fixed values.
NOMINAL_GSD = {"OHRC": 0.25, "TMC": 5.0, "IIRS": 70.0, "LRO_NAC": 0.9}
#: Footprints meet in cells of this many degrees, or of these doubled, for joins.
CELL_DEG = 5.0
BOUNDS = ("west_lon", "east_lon", "south_lat", "north_lat")


def infer_sensor(*texts: Column) -> Column:
    """The sensor named by the first text that names one: IIRS as a token of its own, else OHRC, else TMC; UNKNOWN if none does."""

    def one(t: Column) -> Column:
        low = F.lower(t)
        return F.when(low.rlike("(^|[^a-z0-9])iirs?([^a-z0-9]|$)"), "IIRS").when(low.contains("ohr"), "OHRC").when(low.contains("tmc"), "TMC")

    return F.coalesce(*map(one, texts), F.lit("UNKNOWN"))


def attach_sensor_defaults(products: DataFrame, sensor: str = "sensor") -> DataFrame:
    """Adds ``canonical`` and ``nominal_gsd``; a name with separators gets a second chance without them."""
    bare = F.regexp_replace(F.upper(sensor), "[^A-Z0-9]", "")
    canonical = F.lit(None).cast("string")
    for name in NOMINAL_GSD:
        canonical = F.coalesce(canonical, F.when((F.upper(sensor) == name) | (bare == name.replace("_", "")) | bare.startswith(name.replace("_", "")), name))
    table = F.create_map(*(x for k, v in NOMINAL_GSD.items() for x in (F.lit(k), lit(v))))
    return products.withColumn("canonical", canonical).withColumn("nominal_gsd", F.try_element_at(table, "canonical"))


def resolve_metadata(labels: DataFrame, requests: DataFrame, fields: list[str], key: str = "product_id") -> DataFrame:
    """Each field from the label, else the request, else ``default_<field>`` of the label row, and a map of where it came from."""
    asked = requests.select(key, *(F.col(f).alias(f"r_{f}") for f in fields))
    both = labels.join(asked, key, "left")
    where = lambda f: (
        F.when(F.col(f).isNotNull(), "label").when(F.col(f"r_{f}").isNotNull(), "request").when(F.col(f"default_{f}").isNotNull(), "default").otherwise("missing")
    )
    provenance = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*map(where, fields)))
    return both.select(key, *(F.coalesce(f, f"r_{f}", f"default_{f}").alias(f) for f in fields), provenance.alias("provenance"))


def harmonize_gsd(products: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Fills ``native_gsd``, ``effective_gsd`` and ``gsd`` from each other and ``resampling_factor`` (1 if missing), and adds gsd_ok and gsd_problem.

    A missing effective distance is gsd; a missing native one the effective one
    where nothing was resampled, else gsd; an effective one still missing is
    native / factor; gsd then follows the effective one. A problem is a
    distance or factor that isn't positive, or an effective distance that
    differs from native / factor by more than the relative tolerance.
    """
    factor = F.coalesce("resampling_factor", lit(1))
    out = products.withColumn("resampling_factor", factor).withColumn("effective_gsd", F.coalesce("effective_gsd", "gsd"))
    plain = F.when(F.abs(F.col("resampling_factor") - 1) < 1e-6, F.col("effective_gsd"))
    out = out.withColumn("native_gsd", F.coalesce(F.col("native_gsd"), plain, F.col("gsd")))
    out = out.withColumn("effective_gsd", F.coalesce(F.col("effective_gsd"), F.col("native_gsd") / F.greatest("resampling_factor", lit(1e-9))))
    out = out.withColumn("gsd", F.coalesce("effective_gsd", "gsd"))
    expected = F.col("native_gsd") / F.col("resampling_factor")
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    problem = (
        F.when(~positive("native_gsd"), "native_gsd").when(~positive("effective_gsd"), "effective_gsd").when(~positive("resampling_factor"), "resampling_factor")
        .when(F.abs(F.col("effective_gsd") - expected) > tolerance * expected, "inconsistent")
    )
    return out.withColumn("gsd_problem", problem).withColumn("gsd_ok", F.col("gsd_problem").isNull())


def audit_gsd(products: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(sensor, products, failed): products whose effective distance isn't native / factor within a relative tolerance."""
    expected = F.col("native_gsd") / F.col("factor")
    bad = F.coalesce(F.abs(F.col("effective_gsd") - expected) > tolerance * expected, F.lit(True))
    return products.groupBy("sensor").agg(F.count(F.lit(1)).alias("products"), F.count_if(bad).alias("failed"))


def wrap360(lon: Column) -> Column:
    return F.pmod(lon, lit(360))


def wrap180(lon: Column) -> Column:
    return F.pmod(lon + 180, lit(360)) - 180


def normalize_footprints(products: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds ``unwrapped`` (longitudes within 180 degrees of the first vertex), ``projection`` and ``metric``.

    ``ring`` is array<struct<lon, lat>>. Near a pole (mean |latitude| of 65 or
    more, or any of 80) vertices are polar stereographic, else equirectangular,
    true to scale at the mean latitude.
    """
    r = F.col(ring)
    first = r[0]["lon"]
    unwrapped = F.transform(r, lambda p: F.struct((first + wrap180(p["lon"] - first)).alias("lon"), p["lat"].alias("lat")))
    out = products.withColumn("unwrapped", unwrapped)
    mean = F.aggregate("unwrapped", lit(0), lambda s, p: s + p["lat"]) / F.size("unwrapped")
    top = F.array_max(F.transform("unwrapped", lambda p: F.abs(p["lat"])))
    out = out.withColumn("mean_lat", mean).withColumn("projection", F.when((F.abs("mean_lat") >= 65) | (top >= 80), "polar_stereographic").otherwise("equirectangular"))
    flat = lambda p: F.struct((p["lon"] * DEG_M * F.cos(F.radians("mean_lat"))).alias("x"), (p["lat"] * DEG_M).alias("y"))

    def polar(p: Column) -> Column:
        south = F.col("mean_lat") < 0
        rho = 2 * MOON_RADIUS_M * F.tan(math.pi / 4 - F.radians(F.abs(p["lat"])) / 2)
        t = F.radians(p["lon"])
        return F.struct((rho * F.sin(t)).alias("x"), F.when(south, rho * F.cos(t)).otherwise(-rho * F.cos(t)).alias("y"))

    metric = F.when(F.col("projection") == "polar_stereographic", F.transform("unwrapped", polar)).otherwise(F.transform("unwrapped", flat))
    return out.withColumn("metric", metric)


def shoelace(ring: Column) -> Column:
    """The area of a ring of struct<x, y>, whichever way it runs."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), lit(0), lambda s, a: s + a)) / 2


def clip_ring(subject: Column, window: Column) -> Column:
    """A ring clipped by a convex ring that runs counter-clockwise (Sutherland and Hodgman), both of struct<x, y>.

    One aggregate over the window's edges; each step walks the subject's edges.
    """
    turn = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    edges = F.zip_with(window, turn(window), lambda p, q: F.struct(p.alias("a"), q.alias("b")))

    def by_edge(ring: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
        steps = F.zip_with(ring, turn(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q"), side(p).alias("s"), side(q).alias("t")))

        def walked(k: Column) -> Column:
            share = k["s"] / (k["s"] - k["t"])
            cut = F.struct((k["p"]["x"] + share * (k["q"]["x"] - k["p"]["x"])).alias("x"), (k["p"]["y"] + share * (k["q"]["y"] - k["p"]["y"])).alias("y"))
            inside, next_in = k["s"] >= 0, k["t"] >= 0
            return F.when(inside & next_in, F.array(k["q"])).when(inside, F.array(cut)).when(next_in, F.array(cut, k["q"])).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        return F.flatten(F.transform(steps, walked))

    return F.aggregate(edges, subject, by_edge)


def ring_xy(ring: Column, x: str = "lon", y: str = "lat") -> Column:
    """A ring of points as struct<x, y>, those with a missing coordinate left out."""
    whole = F.filter(ring, lambda p: p[x].isNotNull() & p[y].isNotNull())
    return F.transform(whole, lambda p: F.struct(p[x].cast("double").alias("x"), p[y].cast("double").alias("y")))


#: Pairs, or triples, of edges that ``shared_rings`` holds at a time.
EDGES_AT_ONCE = 200_000


def _edges(rings: pa.Array) -> tuple[np.ndarray, ...]:
    """(edges of each ring, lx, ly, rx, ry, sign): edges from left to right, signed by the way they run; upright ones are left out. With each ring's box."""
    ends = rings.offsets.to_numpy()
    x, y = (rings.values.field(k).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for k in range(2))
    ends = ends - ends[0]
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(x))
    follow = np.where(place + 1 == ends[1:][row], ends[:-1][row], place + 1)
    fold = lambda f, v, none: np.where(size > 0, f.reduceat(np.append(v, none), ends[:-1]) if len(size) else 0.0, none)
    box = np.stack([fold(np.minimum, x, np.inf), fold(np.maximum, x, -np.inf), fold(np.minimum, y, np.inf), fold(np.maximum, y, -np.inf)])
    sign = np.sign(x[follow] - x)
    some = sign != 0
    ahead = sign > 0
    left, right = np.where(ahead, place, follow)[some], np.where(ahead, follow, place)[some]
    return np.bincount(row[some], minlength=len(size)), x[left], y[left], x[right], y[right], sign[some], box


def _shared(rings: tuple[pa.Array, ...]) -> np.ndarray:
    parts = [_edges(r) for r in rings]
    counts, boxes = np.stack([p[0] for p in parts]), np.stack([p[6] for p in parts])
    x0, x1, y0, y1 = boxes[:, 0].max(0), boxes[:, 1].min(0), boxes[:, 2].max(0), boxes[:, 3].min(0)
    meet = (x0 < x1) & (y0 < y1)
    starts = [np.cumsum(c) - c for c in counts]
    made = np.where(meet, counts.prod(0), 0)
    total = np.zeros(len(meet))
    upto = np.cumsum(made)
    at = 0
    while at < len(made):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + EDGES_AT_ONCE, "right")))
        row = np.repeat(np.arange(at, end), made[at:end])
        rest = np.arange(len(row)) - np.repeat(np.cumsum(made[at:end]) - made[at:end], made[at:end])
        picks = []
        for c, s in zip(counts, starts, strict=True):
            picks.append(s[row] + rest % c[row])
            rest //= c[row]
        a = np.maximum.reduce([p[1][k] for p, k in zip(parts, picks, strict=True)])
        b = np.minimum.reduce([p[3][k] for p, k in zip(parts, picks, strict=True)])
        over = a < b
        row, a, b, picks = row[over], a[over], b[over], [k[over] for k in picks]
        slopes = [(p[4][k] - p[2][k]) / (p[3][k] - p[1][k]) for p, k in zip(parts, picks, strict=True)]
        lows = [p[2][k] - y0[row] + (a - p[1][k]) * m for p, k, m in zip(parts, picks, slopes, strict=True)]
        cuts = [a]
        for i, j in itertools.combinations(range(len(parts)), 2):
            apart = slopes[j] - slopes[i]
            t = np.divide(lows[i] - lows[j], apart, out=np.zeros(len(a)), where=apart != 0)
            cuts.append(np.clip(a + t, a, b))
        cuts = np.sort(np.stack([*cuts, b]), axis=0)
        least = np.minimum.reduce([low + (cuts - a) * m for low, m in zip(lows, slopes, strict=True)])
        under = ((least[1:] + least[:-1]) / 2 * np.diff(cuts, axis=0)).sum(0)
        total[at:end] = np.bincount(row - at, under * np.prod([p[5][k] for p, k in zip(parts, picks, strict=True)], axis=0), end - at)
        at = end
    # What the sums' rounding alone can leave is no area.
    noise = np.where(meet, 1e-13 * (x1 - x0) * (boxes[:, 3] - boxes[:, 2]).max(0), 0)
    return np.where(np.abs(total) > noise, np.abs(total), 0.0)


@F.arrow_udf(DoubleType())
def _shared_areas(*rings: pa.Array) -> pa.Array:
    known = np.logical_and.reduce([r.is_valid().to_numpy(zero_copy_only=False) for r in rings])
    with np.errstate(all="ignore"):  # of rings that reach to infinity
        return pa.array(_shared(rings), mask=~known)


def shared_rings(*rings: Column) -> Column:
    """The area that rings of struct<x, y> share, of any sense, concave or not; NULL if one is missing.

    A ring is the sum of the stretches below its edges, signed by the way they
    run, so the shared area is a signed sum over pairs (triples, ...) of edges: of
    the least of their heights, over what they share of x. Not deterministic for
    Spark's planner, which would otherwise repeat it for a filter of its result.
    """
    return _shared_areas.asNondeterministic()(*rings)


def box_ring(west: Column, east: Column, south: Column, north: Column) -> Column:
    """The four corners of a box as struct<lon, lat>; NULL if a bound is missing."""
    known = west.isNotNull() & east.isNotNull() & south.isNotNull() & north.isNotNull()
    return F.when(known, F.array(*(F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat")) for x, y in ((west, south), (east, south), (east, north), (west, north)))))


#: Pairs of rows that a task of a join of boxes should get; and the most tasks it is cut into, which then get more.
PAIRS_AT_ONCE, MOST_TASKS = 1_000_000, 10_000


def _overlapping(a: DataFrame, b: DataFrame, a_id: str) -> tuple[DataFrame, list[str]]:
    """The pairs of ``overlapping`` and the names of the key they were joined by; all pairs of a row of ``a`` lie in one task, under one key."""
    west, east, south, north = (F.col(c) for c in BOUNDS)
    # A box of a lies in the one cell that holds its corner, in a grid at least as wide as the box; b's are cut into all cells with boxes that can touch.
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(east - west, north - south) / CELL_DEG * (1 + 1e-9)))).cast("int")
    size = F.pow(lit(2), F.col("_level")) * CELL_DEG
    left = a.filter(reduce(lambda p, q: p & q, (F.col(c).isNotNull() for c in BOUNDS))).withColumn("_level", F.coalesce(level, F.lit(0)))
    left = left.withColumns({"_cx": F.floor(west / size), "_cy": F.floor(south / size)})
    levels = sorted(r[0] for r in left.select("_level").distinct().collect())
    right = b.toDF(*("b_" + c for c in b.columns)).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    for c, low, high in (("_cx", "b_west_lon", "b_east_lon"), ("_cy", "b_south_lat", "b_north_lat")):
        right = right.filter(F.col(low) <= F.col(high)).withColumn(c, F.explode(F.sequence(F.floor(F.col(low) / size) - 1, F.floor(F.col(high) / size))))
    cell = ["_level", "_cx", "_cy"]
    held = lambda df: next((F.size(c) for c in ("_held", "b__held") if c in df.columns), F.lit(1))
    count = lambda df, name: df.groupBy(cell).agg(F.sum(held(df)).alias(name))
    work = materialize(count(left, "_l").join(count(right, "_r"), cell).select(*cell, (F.col("_l") * F.col("_r")).alias("_pairs")), "overlap-cells")
    total = work.agg(F.sum("_pairs")).first()[0] or 0
    most = max(PAIRS_AT_ONCE, math.ceil(total / MOST_TASKS))
    tasks = max(1, math.ceil(total / most))
    crowded = F.broadcast(work.filter(F.col("_pairs") > most).select(*cell, F.ceil(F.col("_pairs") / most).cast("int").alias("_parts")))  # ``tasks`` rows at most
    parts = F.coalesce("_parts", F.lit(1))
    left = left.join(crowded, cell, "left").withColumn("_part", F.pmod(F.xxhash64(a_id), parts).cast("int")).drop("_parts")
    right = right.join(crowded, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    key = [*cell, "_part"]
    near = left.repartition(tasks, *key).hint("merge").join(right.repartition(tasks, *key), key)
    touch = (F.greatest(west, F.col("b_west_lon")) <= F.least(east, F.col("b_east_lon"))) & (F.greatest(south, F.col("b_south_lat")) <= F.least(north, F.col("b_north_lat")))
    return near.filter(touch), key


def overlapping(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """(all columns of a and b) of pairs whose boxes touch; b's columns carry the prefix ``b_``.

    Boxes meet in grid cells; a box of ``a`` lies in one alone, so no pair comes
    twice and no distinct is needed. The pairs grow with the square of a cell's
    boxes, so their number, not the tables' sizes, decides how many tasks share
    the join: both sides are counted by cell first, and of crowded cells each
    task gets a part of a's boxes.
    """
    pairs, key = _overlapping(a, b, a_id)
    return pairs.drop(*key)


def box_area(west: Column, east: Column, south: Column, north: Column) -> Column:
    """Square degrees; 0 for a box without an inside. In the equirectangular plane areas keep their ratios."""
    return F.greatest(east - west, lit(0)) * F.greatest(north - south, lit(0))


def shared_area() -> Column:
    return box_area(
        F.greatest("west_lon", "b_west_lon"), F.least("east_lon", "b_east_lon"), F.greatest("south_lat", "b_south_lat"), F.least("north_lat", "b_north_lat")
    )


def _ring(prefix: str = "") -> Column:
    """The points of a row's ring, or of its box where the ring is missing."""
    box = box_ring(*(F.col(prefix + c) for c in BOUNDS))
    return ring_xy(F.coalesce(F.when(F.size(prefix + "ring") >= 3, _lon_lat(F.col(prefix + "ring"))), box))


def _lon_lat(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat")))


#: Products of one footprint that a row of ``by_footprint`` holds at most; fewer where tasks get few pairs, as a row stays in its task.
HELD = 250


def by_footprint(products: DataFrame, own: list[str]) -> DataFrame:
    """(own columns, _held, _fid): each footprint once, or once for every HELD of its products, whose other columns are held in an array.

    What two footprints share is the same for all their products, so it is worked out once.
    """
    rest = [c for c in products.columns if c not in own]
    lot = F.floor((F.row_number().over(Window.partitionBy(*own).orderBy("product_id" if "product_id" in rest else rest[0])) - 1) / max(1, min(HELD, math.isqrt(PAIRS_AT_ONCE) // 4)))
    held = products.withColumn("_lot", lot).groupBy(*own, "_lot").agg(F.collect_list(F.struct(*rest)).alias("_held")).drop("_lot")
    return materialize(held.withColumn("_fid", F.monotonically_increasing_id()), "footprints")


def _footprint_pairs(left: DataFrame, right: DataFrame, containment: float, rings: bool) -> DataFrame:
    """The pairs of ``by_footprint`` rows with ``overlap`` of at least ``containment``; b's columns carry the prefix ``b_``, rings are in _ring, their area in _area."""
    if rings:
        left = left.withColumn("_ring", _ring()).withColumn("_area", shoelace(F.col("_ring")))
        pairs = overlapping(left, right.withColumn("_ring", _ring()), "_fid", "_fid")
        # Rings share no more than their boxes.
        pairs = pairs.filter(shared_area() >= (containment - 1e-9) * F.col("_area"))
        share = F.try_divide(shared_rings(F.col("_ring"), F.col("b__ring")), F.col("_area"))
    else:
        pairs = overlapping(left.withColumn("_area", box_area(*(F.col(c) for c in BOUNDS))), right, "_fid", "_fid")
        share = F.try_divide(shared_area(), F.col("_area"))
    return pairs.withColumn("overlap", share).filter(F.col("overlap") >= containment)


def _to_digits(c: str, digits: int | None) -> Column:
    return F.col(c) if digits is None else F.round(c, digits).alias(c)


def footprint_join(a: DataFrame, b: DataFrame, containment: float, digits: int | None = None) -> DataFrame:
    """Pairs with |A and B| / |A| of at least ``containment``; adds ``overlap``, rounded to ``digits``.

    If both have ``ring``s, polygons count, else boxes. Rings may run either way
    and be concave; where one is missing its box stands for it. A ring without
    area has no overlap with anything.
    """
    rings = "ring" in a.columns and "ring" in b.columns
    own = [*BOUNDS, *(["ring"] if rings else [])]
    pairs = _footprint_pairs(by_footprint(a, own), by_footprint(b, own), containment, rings)
    pairs = pairs.select(*own, *("b_" + c for c in own), "_held", "b__held", _to_digits("overlap", digits))
    pairs = pairs.withColumn("_a", F.explode("_held")).withColumn("_b", F.explode("b__held"))
    return pairs.select(*(c if c in own else F.col("_a")[c].alias(c) for c in a.columns), *("b_" + c if c in own else F.col("_b")[c].alias("b_" + c) for c in b.columns), "overlap")


#: How far a footprint can be trusted, the best first: fixed values.
CONFIDENCE = ("polygon_exact", "approximate", "bbox_only", "unavailable")


def footprint_overlap(pairs: DataFrame) -> DataFrame:
    """Adds area1, area2, intersection (km2), pct1, pct2 and iou of two footprints.

    Without rings, boxes are compared, true to scale at the mean latitude of
    both, the second one shifted by whole turns to lie nearest to the first.

    With ``ring`` and ``b_ring`` (array<struct<lon, lat>>, of any sense, concave
    or not) polygons are, in a plane for the pair: polar stereographic about
    their mean longitude if the mean latitude of all their points is 65 degrees
    or more, or any is 80, else equirectangular, true to scale at the mean
    latitude; longitudes are unwrapped about the mean one. Where a ring is
    missing its box stands for it. Also added are ``projection`` and
    ``confidence``, the worse one of both footprints: ``confidence`` and
    ``b_confidence`` if the table has them, else polygon_exact for a ring,
    bbox_only for a box, unavailable for neither, which leaves zeros. A ring
    that crosses itself counts its parts by the sense in which they run.
    """
    if not ("ring" in pairs.columns and "b_ring" in pairs.columns):
        shift = F.round((F.col("west_lon") + F.col("east_lon") - F.col("b_west_lon") - F.col("b_east_lon")) / 720) * 360
        moved = pairs.withColumns({"b_west_lon": F.col("b_west_lon") + shift, "b_east_lon": F.col("b_east_lon") + shift})
        mean = (F.col("south_lat") + F.col("north_lat") + F.col("b_south_lat") + F.col("b_north_lat")) / 4
        unit = (DEG_M / 1000) ** 2 * F.cos(F.radians(mean))
        a, b = box_area(*(F.col(c) for c in BOUNDS)) * unit, box_area(*(F.col("b_" + c) for c in BOUNDS)) * unit
        both = shared_area() * unit
        return moved.withColumns({"area1": a, "area2": b, "intersection": both, "pct1": F.try_divide(both, a) * 100, "pct2": F.try_divide(both, b) * 100, "iou": F.try_divide(both, a + b - both)})

    worst = F.lit(len(CONFIDENCE) - 1)

    def level(prefix: str) -> Column:
        has = F.when(F.size(prefix + "ring") >= 3, 0).when(box_ring(*(F.col(prefix + c) for c in BOUNDS)).isNotNull(), 2).otherwise(worst)
        said = F.col(prefix + "confidence") if prefix + "confidence" in pairs.columns else F.lit(None).cast("string")
        told = F.coalesce(*(F.when(said == name, k) for k, name in enumerate(CONFIDENCE)))
        return F.when(has == worst, worst).otherwise(F.coalesce(told, has))

    def points(prefix: str) -> Column:
        box = box_ring(*(F.col(prefix + c) for c in BOUNDS))
        return ring_xy(F.coalesce(F.when(F.size(prefix + "ring") >= 3, _lon_lat(F.col(prefix + "ring"))), box, F.array().cast("array<struct<lon:double,lat:double>>")))

    out = pairs.withColumns({"_level": F.greatest(level(""), level("b_")), "_a": points(""), "_b": points("b_")}).withColumn("_all", F.concat("_a", "_b"))
    mean = lambda c: F.try_divide(F.aggregate("_all", lit(0), lambda s, p: s + p[c]), F.size("_all"))
    out = out.withColumns({"_lon": mean("x"), "_lat": mean("y"), "_top": F.array_max(F.transform("_all", lambda p: F.abs(p["y"])))})
    polar = (F.abs("_lat") >= 65) | (F.col("_top") >= 80)

    def placed(p: Column) -> Column:
        east = wrap180(p["x"] - F.col("_lon"))
        side = F.when(F.col("_lat") < 0, lit(-1)).otherwise(lit(1))
        rho = 2 * MOON_RADIUS_M * F.tan(math.pi / 4 - F.radians(side * p["y"]) / 2)
        flat = F.struct((east * DEG_M * F.cos(F.radians("_lat"))).alias("x"), (p["y"] * DEG_M).alias("y"))
        return F.when(polar, F.struct((rho * F.sin(F.radians(east))).alias("x"), (-side * rho * F.cos(F.radians(east))).alias("y"))).otherwise(flat)

    usable = F.col("_level") < worst
    out = out.withColumns({c: F.when(usable, F.transform(c, placed)) for c in ("_a", "_b")})
    areas = {"area1": shoelace(F.col("_a")), "area2": shoelace(F.col("_b")), "intersection": shared_rings(F.col("_a"), F.col("_b"))}
    out = out.withColumns({k: F.when(usable, v / 1e6).otherwise(lit(0)) for k, v in areas.items()})
    both = F.col("intersection")
    share = lambda whole: F.least(F.coalesce(F.try_divide(100 * both, whole), lit(0)), lit(100))
    name = F.when(~polar, "equirectangular").when(F.col("_lat") < 0, "south_polar_stereographic").otherwise("north_polar_stereographic")
    return out.withColumns({
        "pct1": share(F.col("area1")), "pct2": share(F.col("area2")), "iou": F.coalesce(F.try_divide(both, F.col("area1") + F.col("area2") - both), lit(0)),
        "projection": F.when(usable, name), "confidence": F.array(*map(F.lit, CONFIDENCE))[F.col("_level")],
    }).drop("_level", "_a", "_b", "_all", "_lon", "_lat", "_top")


def gap_days(a: Column, b: Column) -> Column:
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400.0


def time_ok(t_o: Column, t_t: Column, t_i: Column, least: float, most: float, require_dates: bool, gap: Callable[[Column, Column], Column] = gap_days) -> Column:
    """Every dated pair lies ``least`` to ``most`` days apart; an undated O-T or O-I pair fails only if dates are required."""
    within = lambda a, b: (gap(a, b) >= least) & (gap(a, b) <= most)
    strict = lambda a, b: F.coalesce(within(a, b), F.lit(not require_dates))
    return strict(t_o, t_t) & strict(t_o, t_i) & F.coalesce(within(t_t, t_i), F.lit(True))


def build_triplets(
    products: DataFrame, containment: float, least_gap: float = 0.0, most_gap: float = 1e9, require_dates: bool = False, digits: int | None = None
) -> DataFrame:
    """(ohrc_id, tmc_id, iirs_id, fraction, pct_ot, pct_oi): products of three sensors that share ground and time, anchored on OHRC.

    Footprints are the ``ring``s if there are any, of any sense, concave or not,
    else boxes; they meet by ``by_footprint``, and only what shares enough ground
    becomes triplets of products. ``digits`` rounds the fraction.
    """
    rings = "ring" in products.columns
    own = [*BOUNDS, *(["ring"] if rings else [])]
    of = lambda s: by_footprint(products.filter(F.col("sensor") == s).select("product_id", *own, F.unix_timestamp("acquired").alias("at")), own)
    sites = of("OHRC")
    ends = dict(zip(BOUNDS, (F.greatest, F.least) * 2, strict=True))

    def shared(sensor: str, name: str) -> DataFrame:
        """What the sensor's footprints share with each site's; the site's columns stay with the first sensor."""
        pairs = _footprint_pairs(sites, of(sensor), containment, rings)
        ground = [f(c, "b_" + c).alias(name + c) for c, f in ends.items()] + ([F.col("b__ring").alias(name + "ring")] if rings else [])
        site = ["_held", "_area", *(["_ring"] if rings else [])] if name == "t_" else []
        return materialize(pairs.select("_fid", *site, *ground, F.col("b__held").alias(name + "held"), F.round(F.col("overlap") * 100, 3).alias("pct_o" + name[0])), "triplets-two")

    two, other = shared("TMC", "t_"), shared("IIRS", "i_")
    # Triplets, not sites, decide how many tasks share the join.
    counts = two.groupBy("_fid").agg(F.sum(F.size("t_held") * F.size("_held")).cast("double").alias("_t")).join(other.groupBy("_fid").agg(F.sum(F.size("i_held")).alias("_i")), "_fid")
    total = counts.agg(F.sum(F.col("_t") * F.col("_i"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, math.ceil(total / PAIRS_AT_ONCE)))
    both = two.repartition(tasks, "_fid").hint("merge").join(other.repartition(tasks, "_fid"), "_fid")
    boxes = box_area(*(f("t_" + c, "i_" + c) for c, f in ends.items()))
    if rings:
        both = both.filter(boxes >= (containment - 1e-9) * F.col("_area"))
        boxes = shared_rings(F.col("_ring"), F.col("t_ring"), F.col("i_ring"))
    both = both.withColumn("fraction", F.try_divide(boxes, F.col("_area"))).filter(F.col("fraction") >= containment)
    both = both.select("_held", "t_held", "i_held", _to_digits("fraction", digits), "pct_ot", "pct_oi")
    for name, held in (("o", "_held"), ("t", "t_held"), ("i", "i_held")):
        both = both.withColumn(name, F.explode(held))
    days = lambda p, q: F.abs(p - q) / 86400.0
    within = time_ok(*(F.col(name)["at"] for name in "oti"), least_gap, most_gap, require_dates, days)
    ids = [F.col(name)["product_id"].alias(alias) for name, alias in (("o", "ohrc_id"), ("t", "tmc_id"), ("i", "iirs_id"))]
    return both.filter(within).select(*ids, "fraction", "pct_ot", "pct_oi")


def first_triplets(products: DataFrame, containment: float, first: int) -> DataFrame:
    """(ohrc_id, tmc_id, iirs_id, fraction): of each site's ``build_triplets`` of equal fraction the ``first`` by their ids, without regard to dates.

    Triplets grow with the cube of the products, these don't: products of one
    box change no fraction but by their ids, so the first of each box do, and a
    site meets what they leave of it, its clips, not each pair of them.
    Footprints are boxes; with ``ring``s all triplets are built.
    """
    in_order = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= first
    if "ring" in products.columns:
        every = build_triplets(products, containment).select("ohrc_id", "tmc_id", "iirs_id", "fraction")
        return every.withColumn("_first", in_order(["ohrc_id", "fraction"], ["tmc_id", "iirs_id"])).filter("_first").drop("_first")
    of = lambda s: products.filter(F.col("sensor") == s).select("product_id", *BOUNDS)
    sites, area = of("OHRC"), box_area(*(F.col(c) for c in BOUNDS))
    ends = dict(zip(BOUNDS, (F.greatest, F.least) * 2, strict=True))

    def clips(sensor: str, name: str) -> DataFrame:
        few = of(sensor).withColumn("_first", in_order(BOUNDS, ["product_id"])).filter("_first").drop("_first")
        pairs, key = _overlapping(sites, few, "product_id")
        pairs = pairs.filter(F.try_divide(shared_area(), area) >= containment)
        pairs = pairs.select(*key, "product_id", "b_product_id", area.alias("_area"), *(f(c, "b_" + c).alias(name + c) for c, f in ends.items()))
        # All pairs of a site lie in one task already.
        clip = [*key, "product_id", "_area", *(name + c for c in BOUNDS)]
        least = pairs.withColumn("_first", in_order(clip, ["b_product_id"])).filter("_first")
        return least.groupBy(*clip).agg(F.array_sort(F.collect_list("b_product_id")).alias(name + "ids")).drop(*key)

    both = clips("TMC", "t_").join(clips("IIRS", "i_").drop("_area"), "product_id")
    shared = box_area(*(f("t_" + c, "i_" + c) for c, f in ends.items()))
    both = both.withColumn("fraction", F.try_divide(shared, F.col("_area"))).filter(F.col("fraction") >= containment)
    pairs = F.flatten(F.transform("t_ids", lambda t: F.transform("i_ids", lambda i: F.struct(t.alias("tmc_id"), i.alias("iirs_id")))))
    found = both.select(F.col("product_id").alias("ohrc_id"), "fraction", F.explode(F.slice(pairs, 1, first)).alias("p")).select("ohrc_id", "p.tmc_id", "p.iirs_id", "fraction")
    return found.withColumn("_first", in_order(["ohrc_id", "fraction"], ["tmc_id", "iirs_id"])).filter("_first").drop("_first")


#: What a requested containment falls back to: fixed values.
FALLBACK = (0.75, 0.70, 0.65, 0.60, 0.50)


def adaptive_containment(triplets: DataFrame, requested: float) -> DataFrame:
    """Triplets (built at the lowest fallback) at the requested fraction, or at the largest fallback below it that yields any; adds ``used``."""
    tries = [requested, *(t for t in FALLBACK if t < requested)]
    reached = F.array_max(F.filter(F.array(*map(lit, tries)), lambda t: t <= F.col("fraction")))
    best = triplets.agg(F.max(reached).alias("used"))
    return triplets.crossJoin(F.broadcast(best)).filter(F.col("fraction") >= F.col("used"))


def adaptive_triplets(products: DataFrame, requested: float, least_gap: float = 0.0, most_gap: float = 1e9, require_dates: bool = False) -> DataFrame:
    """``adaptive_containment`` of ``build_triplets``, which are only built at a containment until one yields any; adds ``used``."""
    for least in (tries := [requested, *(t for t in FALLBACK if t < requested)]):
        # What shares so much of its site with both others shares as much with each of them.
        found = build_triplets(products, least, least_gap, most_gap, require_dates)
        if least == tries[-1] or not found.isEmpty():
            return found.withColumn("used", lit(least))


def rank_candidates(targets: DataFrame, candidates: DataFrame, least: float = 0.20) -> DataFrame:
    """(target_id, product_id, overlap, score, rank): candidates by 0.8 overlap + 0.2 (1 - incidence gap / 90), or overlap alone.

    Boxes are compared as they are, without a turn around the antimeridian.
    """
    pairs, key = _overlapping(targets, candidates, "product_id")
    overlap = shared_area() / box_area(*(F.col(c) for c in BOUNDS))
    gap = F.abs(F.col("incidence") - F.col("b_incidence"))
    score = F.coalesce(0.8 * F.col("overlap") + 0.2 * (1 - gap / 90), F.col("overlap"))
    ranked = pairs.withColumn("overlap", overlap).filter(F.col("overlap") >= least).withColumns({"score": score, "gap": gap})
    # All pairs of a target lie in one task already, so none is shuffled.
    order = Window.partitionBy(*key, "product_id").orderBy(F.desc("score"), F.desc("overlap"), F.asc_nulls_last("gap"), "b_product_id")
    return ranked.select(F.col("product_id").alias("target_id"), F.col("b_product_id").alias("product_id"), "overlap", "score", F.row_number().over(order).alias("rank"))


SIDES = ("west", "east", "south", "north")


def coverage_check(regions: DataFrame, dems: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(id, contained, dem_id, margin_deg, margin_west, margin_east, margin_south, margin_north): the DEM that fully holds each region with the widest margin.

    Margins of the sides are in pixels of that DEM, by its ``res_x_deg`` and
    ``res_y_deg``; NULL where these aren't known or positive. A region that none
    holds has no DEM; ``missing_regions`` lists such. Bounds are taken as they are.
    """
    known = {c: F.col(c) if c in dems.columns else F.lit(None).cast("double") for c in ("res_x_deg", "res_y_deg")}
    pairs = overlapping(regions.select("id", *BOUNDS), dems.select("id", *BOUNDS, *(v.alias(c) for c, v in known.items())), "id", "id")
    away = {"west": F.col("west_lon") - F.col("b_west_lon"), "east": F.col("b_east_lon") - F.col("east_lon"), "south": F.col("south_lat") - F.col("b_south_lat"), "north": F.col("b_north_lat") - F.col("north_lat")}
    size = lambda side: F.col("b_res_x_deg" if side in ("west", "east") else "b_res_y_deg")
    pixels = {f"margin_{s}": F.when(size(s) > 0, away[s] / size(s)) for s in SIDES}
    inside = pairs.withColumns({"margin_deg": F.least(*away.values()), **pixels}).filter(F.col("margin_deg") >= -eps)
    found = F.struct(F.col("b_id").alias("dem_id"), "margin_deg", *pixels)
    best = inside.groupBy("id").agg(F.max_by(found, F.struct("margin_deg", -F.col("b_id"))).alias("m"))
    return regions.select("id").join(best, "id", "left").select("id", F.col("m").isNotNull().alias("contained"), "m.*")


def missing_regions(covered: DataFrame) -> DataFrame:
    """(id) of the regions of a ``coverage_check`` that no DEM holds: what stops a job that must not go on without."""
    return covered.filter(~F.col("contained")).select("id")


def merge_catalog(sources: list[DataFrame], key: str, fill: list[str], required: list[str]) -> DataFrame:
    """One row for each id: the first source wins, and NULLs of ``fill`` columns come from later ones; rows that lack ``required`` go."""
    tagged = [s.withColumn("_order", F.lit(k)) for k, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    columns = [c for c in every.columns if c not in (key, "_order")]
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order")) if c in fill else F.col("_order")).alias(c)
    return every.groupBy(key).agg(*map(pick, columns)).dropna(subset=required)


def upsert_manifest(existing: DataFrame, new: DataFrame, key: str, region: str = "region_id") -> DataFrame:
    """Existing rows and new keys; an old row without a region takes the new one's; ``action`` tells kept, upgraded and added."""
    columns = [c for c in existing.columns if c != key]
    fresh = new.select(F.col(key), *(F.col(c).alias("_n_" + c) for c in columns), F.lit(True).alias("_new"))
    both = existing.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")
    upgrade = F.col("_old").isNotNull() & F.col(region).isNull() & F.col("_n_" + region).isNotNull()
    action = F.when(F.col("_old").isNull(), "added").when(upgrade, "upgraded").otherwise("kept")
    take = F.col("_old").isNull() | upgrade
    return both.select(key, *(F.when(take, F.coalesce(F.col("_n_" + c), F.col(c))).otherwise(F.col(c)).alias(c) for c in columns), action.alias("action"))


def union_catalogs(catalogs: list[DataFrame], key: str, path: str = "path") -> DataFrame:
    """All catalogs together, the first path of each key."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.withColumn("_order", F.lit(k)) for k, c in enumerate(catalogs)])
    first = Window.partitionBy(key).orderBy("_order", path)
    return every.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_order")


def assert_disjoint(train: DataFrame, test: DataFrame, group: str) -> None:
    """Raises if a group is on both sides."""
    common = train.select(group).intersect(test.select(group))
    if not common.isEmpty():
        raise ValueError(f"groups on both sides: {[r[0] for r in common.take(5)]}")


def illumination_gap(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """(pair_id, azimuth_gap, elevation_1, elevation_2, bucket): circular sun azimuth gap, and elevations with the incidence as fallback."""
    elevation = F.coalesce("sun_elevation", 90 - F.col("incidence"))
    sun = products.select("product_id", "sun_azimuth", clip(F.coalesce(elevation, lit(45)), 5, 85).alias("e"))
    one = sun.toDF("product_1", "a1", "elevation_1")
    two = sun.toDF("product_2", "a2", "elevation_2")
    d = F.pmod(F.abs(F.col("a1") - F.col("a2")), lit(360))
    gap = F.least(d, 360 - d)
    bucket = F.when(gap.isNull(), "unknown").when(gap < 15, "small").when(gap < 45, "medium").otherwise("large")
    return pairs.join(one, "product_1").join(two, "product_2").select("pair_id", F.when(d.isNotNull(), gap).alias("azimuth_gap"), "elevation_1", "elevation_2", bucket.alias("bucket"))


def tile_windows(images: DataFrame, size: int, overlap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, row, col, x0, y0, x1, y1): windows with stride size - overlap; the last one is clipped, none starts past it. Columns to ``keep`` follow."""
    stride = size - overlap
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(n) - size) / stride).cast("int")))
    grid = images.select("image_id", "width", "height", *keep, F.explode(starts("height")).alias("row")).select("*", F.explode(starts("width")).alias("col"))
    x0, y0 = F.col("col") * stride, F.col("row") * stride
    return grid.select("image_id", "row", "col", x0.alias("x0"), y0.alias("y0"), F.least(x0 + size, F.col("width")).alias("x1"), F.least(y0 + size, F.col("height")).alias("y1"), *keep)


def georeference(matches: DataFrame, regions: DataFrame, width: float, height: float) -> DataFrame:
    """Adds lat, lon and metres_per_px of source points from the region's bounds; NULL without bounds."""
    placed = matches.join(regions.select(F.col("id").alias("region_id"), *BOUNDS), "region_id", "left")
    w, e, s, n = (F.col(c) for c in BOUNDS)
    middle = F.cos(F.radians((s + n) / 2))
    return placed.withColumns({
        "lon": w + F.col("source_x") / width * (e - w), "lat": n - F.col("source_y") / height * (n - s), "metres_per_px": (e - w) * DEG_M * middle / width,
    })


def validate_registry(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """(slot, problems): what is wrong with each registry entry; cited numbers must equal those of the manifest."""
    m = manifests.select(F.col("manifest").alias("manifest"), F.col("fit_rmse").alias("_rmse"), F.col("inliers").alias("_inliers"), F.lit(True).alias("_there"))
    both = entries.join(m, "manifest", "left")
    numbers = F.col("fit_rmse").isNotNull() | F.col("inliers").isNotNull()
    rules = [
        ((F.col("status") == "validated") & F.col("_there").isNull(), "manifest_missing"), ((F.col("status") == "pending") & numbers, "pending_with_numbers"),
        (F.abs(F.col("fit_rmse") - F.col("_rmse")) > 1e-9, "fit_rmse_differs"), (F.col("inliers") != F.col("_inliers"), "inliers_differ"),
    ]
    return both.select("slot", F.array_compact(F.array(*(F.when(c, n) for c, n in rules))).alias("problems"))


def paired_tiles(pairs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Tiles of the first image with the scaled box of the second: adds u0, v0, u1, v1 clipped to (width2, height2).

    Tiles carry the sizes along, so nothing is joined: a table of very regular tiles looks small enough to broadcast, and isn't.
    """
    images = pairs.select(F.col("pair_id").alias("image_id"), F.col("width1").alias("width"), F.col("height1").alias("height"), "width2", "height2")
    both = tile_windows(images, size, overlap, ("width", "height", "width2", "height2")).withColumnRenamed("image_id", "pair_id")
    sx, sy = F.col("width2") / F.col("width"), F.col("height2") / F.col("height")
    return both.select(
        "pair_id", "row", "col", "x0", "y0", "x1", "y1", F.floor(F.col("x0") * sx).alias("u0"), F.floor(F.col("y0") * sy).alias("v0"),
        F.least(F.ceil(F.col("x1") * sx), F.col("width2")).alias("u1"), F.least(F.ceil(F.col("y1") * sy), F.col("height2")).alias("v1"),
    )


def axis_alignment(products: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds lat_paired, lon_paired, polygon_area, bbox_area, relative_diff and is_axis_aligned of footprints.

    Coordinates are paired if, to ten digits, there are two and each stands at
    two corners; a footprint is aligned if both are. Areas are in square
    degrees; the difference is over the box's, 0 for a box without area.
    """
    r = F.col(ring)

    def paired(c: str) -> Column:
        values = F.transform(r, lambda p: F.round(p[c], 10))
        return let(values, lambda v: (F.size(F.array_distinct(v)) == 2) & F.forall(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)) == 2))

    side = lambda c: F.array_max(F.transform(r, lambda p: p[c])) - F.array_min(F.transform(r, lambda p: p[c]))
    out = products.withColumns({"lat_paired": paired("lat"), "lon_paired": paired("lon"), "polygon_area": shoelace(ring_xy(r)), "bbox_area": side("lon") * side("lat")})
    off = F.coalesce(F.try_divide(F.abs(F.col("bbox_area") - F.col("polygon_area")), F.col("bbox_area")), F.when(F.col("bbox_area") == 0, lit(0)))
    return out.withColumns({"relative_diff": off, "is_axis_aligned": F.col("lat_paired") & F.col("lon_paired")})


def audit_axis_alignment(products: DataFrame, ring: str = "ring") -> DataFrame:
    """(sensor, products, rotated, lat_paired, lon_paired, max_relative_diff): footprints that aren't aligned with the axes, by sensor."""
    return axis_alignment(products, ring).groupBy("sensor").agg(
        F.count(F.lit(1)).alias("products"), F.count_if(~F.col("is_axis_aligned")).alias("rotated"), F.count_if("lat_paired").alias("lat_paired"),
        F.count_if("lon_paired").alias("lon_paired"), F.max("relative_diff").alias("max_relative_diff"),
    )
