"""Feature tables of matches: labels, neighbours, descriptors, splits and a match classifier."""

from functools import reduce
from operator import and_, mul

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tiegrid.functions.algebra import clip, lit
from tiegrid.plans.work import join_on_hot_keys, materialize, running_sums

XY = ("source_x", "source_y", "target_x", "target_y")
#: Label columns in the order in which they count: fixed names.
TRUTH_KEYS = ("ground_truth_label", "human_label", "hand_label", "manual_label", "verified_label")
CONSENSUS_KEYS = ("is_inlier", "inlier", "ransac_inlier", "label")


def truthy(df: DataFrame, name: str) -> Column:
    """A label column of booleans, numbers or words; NULL where a word can't be read."""
    c, kind = F.col(name), dict(df.dtypes)[name]
    if kind == "boolean":
        return c
    if kind != "string":
        return c != 0
    word = F.lower(F.trim(c))
    return F.when(word.isin("true", "1", "yes", "inlier", "y"), True).when(word.isin("false", "0", "no", "outlier", "n"), False)


def label_matches(matches: DataFrame, allow_consensus: bool = False) -> DataFrame:
    """Adds ``truth`` and ``truth_source``: the first label column that can be read; consensus labels ("ransac") only if allowed."""
    have = [k for k in TRUTH_KEYS if k in matches.columns]
    said = F.col("label_source") if "label_source" in matches.columns else F.lit(None).cast("string")
    value, source = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for key in reversed(have):
        read = truthy(matches, key)
        origin = F.when(said == "synthetic_geometry", said).when(said.isin("hand", "manual", "hand_labelled"), "hand").otherwise("synthetic_geometry" if key == TRUTH_KEYS[0] else "hand")
        value, source = F.when(read.isNotNull(), read).otherwise(value), F.when(read.isNotNull(), origin).otherwise(source)
    if allow_consensus:
        votes = [truthy(matches, k) for k in CONSENSUS_KEYS if k in matches.columns]
        if "is_outlier" in matches.columns:
            votes.append(~truthy(matches, "is_outlier"))
        vote = F.coalesce(*votes) if votes else F.lit(None).cast("boolean")
        source = F.coalesce(source, F.when(vote.isNotNull(), "ransac"))
        value = F.coalesce(value, vote)
    return matches.withColumns({"truth": value, "truth_source": F.coalesce(source, F.lit("none"))})


def label_by_truth(projected: DataFrame, near: float = 2.0, far: float = 5.0) -> DataFrame:
    """Matches with their error under a true transform: near ones true, far ones false, those between dropped."""
    return projected.filter((F.col("error") <= near) | (F.col("error") >= far)).withColumn("truth", F.col("error") <= near)


def provenance_group(matches: DataFrame) -> DataFrame:
    """Adds group_id and group_level: the image pair, else the region, else the source image."""
    src, tgt, region = (F.nullif(F.col(c), F.lit("")) for c in ("source_image", "target_image", "region"))
    pair = F.concat(src, F.lit("::"), tgt)
    group = F.coalesce(F.concat(region, F.lit(":"), pair), pair, region, src)
    level = F.when(pair.isNotNull(), "image_pair").when(region.isNotNull(), "region").when(src.isNotNull(), "source_image").otherwise("none")
    return matches.withColumns({"group_id": group, "group_level": level})


#: Pairs of so many matches at most are compared as a whole, one at a time; larger ones by cells. Distances that are held at once.
WHOLE, APART = 4_000, 1 << 18


def _nearest_others(ids: pa.Array, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, distance): of each place up to k others by distance, then id; places of one id aren't each other's."""
    order = pc.rank(ids, tiebreaker="min").to_numpy(zero_copy_only=False)
    n, step, found = len(x), max(1, APART // max(1, len(x))), []
    for at in range(0, n, step):
        with np.errstate(all="ignore"):
            away = np.sqrt(np.square(x[at : at + step, None] - x) + np.square(y[at : at + step, None] - y))
        ranked = np.where(np.isnan(away), np.inf, away)
        ranked[order[at : at + step, None] == order] = np.nan
        most = np.partition(ranked, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(ranked), np.inf)
        r, o = np.nonzero(ranked <= np.where(np.isnan(most), np.inf, most)[:, None])
        away = away[r, o]
        by = np.lexsort((order[o], away, r))  # NaN comes last
        r, o, away = r[by], o[by], away[by]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        found.append((r[place < k] + at, o[place < k], away[place < k]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _neighbours_of(k: int, id_col: str):
    """Adds ``near`` to the rows of one pair; NULL without an id or a place."""

    def run(pair: pa.Table) -> pa.Table:
        known = np.logical_and.reduce([pair[c].is_valid().to_numpy() for c in (id_col, "source_x", "source_y")])
        some = pair.filter(pa.array(known)).combine_chunks()
        ids, places = some[id_col].combine_chunks(), {c: some[c].combine_chunks().cast(pa.float64()) for c in XY}
        r, o, away = _nearest_others(ids, *(places[c].to_numpy() for c in ("source_x", "source_y")), k)
        others = pa.array(o, pa.int64())
        fields = {"away": pa.array(away, pa.float64()), "id": ids.take(others), **{c: v.take(others) for c, v in places.items()}}
        counts = np.zeros(len(known), np.int64)
        counts[known] = np.bincount(r, minlength=len(some))
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.append(~known, False))
        near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
        return pair.append_column("near", near)

    return run


def neighbours(matches: DataFrame, k: int, key: str = "pair_id", id_col: str = "match_id", counted: DataFrame | None = None) -> DataFrame:
    """The rows, and ``near``: array of (away, id, places) of the k nearest others of the same pair by source position; ties to the smaller id.

    A pair of up to WHOLE matches is shuffled once and compared in one go, so
    nothing else is written; of larger ones the places meet in cells. ``counted``
    has at least the same rows by ``key`` and costs less to count.
    """
    near = f"array<struct<away: double, id: {matches.schema[id_col].dataType.simpleString()}, {', '.join(c + ': double' for c in XY)}>>"
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema)
    compare = lambda some: some.groupBy(key).applyInArrow(_neighbours_of(k, id_col), f"{names}, near {near}")
    sizes = materialize((matches if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "neighbours-sizes")
    large = materialize(sizes.filter(F.col("_n") > WHOLE).select(key), "neighbours-large")
    if large.isEmpty():
        return compare(matches)
    rest = matches.join(large, key, "left_semi")
    own = nearest_by_cells(rest.select(key, id_col, *XY), k, key, id_col).select(key, id_col, F.col("near").cast(near).alias("near"))
    return compare(matches.join(large, key, "left_anti")).unionByName(rest.join(own, [key, id_col], "left"))


def nearest(matches: DataFrame, k: int, key: str = "pair_id", id_col: str = "match_id") -> DataFrame:
    """(own columns, o_ columns, away, rank) of each match and its k nearest others of the same pair, as ``neighbours`` has them."""
    done = neighbours(matches.select(key, id_col, *XY), k, key, id_col).select(key, id_col, *XY, F.posexplode("near").alias("rank", "o"))
    return done.select(key, id_col, *XY, F.col("o.id").alias("o_" + id_col), *(F.col("o")[c].alias("o_" + c) for c in XY), "o.away", (F.col("rank") + 1).alias("rank"))


def nearest_by_cells(matches: DataFrame, k: int, key: str, id_col: str) -> DataFrame:
    """(key, id, places, near) as ``neighbours`` gives them, for pairs of any size.

    Cells are sized by each pair's density, for about ten times k matches in a
    block of four. Those that may have nearer ones outside their block look
    again into cells twice as large, until every match has its k nearest or all
    others of its pair. So a pair is never compared as a whole unless it is that
    small.
    """
    ends = matches.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("source_x").alias("_x"), F.min("source_y").alias("_y"),
        F.greatest(F.max("source_x") - F.min("source_x"), F.max("source_y") - F.min("source_y"), lit(1e-6)).alias("_span"),
    )
    side = F.col("_span") / F.greatest(lit(1), F.floor(F.sqrt(F.col("_n") / k) * 1.25))
    base = materialize(matches.select(key, id_col, *XY).join(ends, key).withColumn("_side", side * (1 + 1e-9)).drop("_n"), "nearest")
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)))
    other = F.struct(F.col(id_col).alias("id"), *XY)
    own = ["cx", "cy"]

    def measured(o: Column) -> Column:
        away = F.sqrt(F.pow(F.col("source_x") - o["source_x"], 2) + F.pow(F.col("source_y") - o["source_y"], 2))
        return F.struct(away.alias("away"), o["id"].alias("id"), *(o[c].alias(c) for c in XY))

    found, asking, scale = None, base, 1
    while True:
        size = F.col("_side") * scale
        # Cells are two sides wide. A match looks into a block of 2 x 2, in whose middle it lies, a side away from its edges at least; the
        # matches of a cell go to its four blocks, later only to those that are asked for. So no pair of matches is shuffled.
        at = lambda shift: {c: F.floor((F.col(f"source_{c[1]}") - F.col("_" + c[1])) / (2 * size) - shift) for c in own}
        cell, looks = at(0.0), asking.withColumns(at(0.5))
        there = F.explode(steps).alias("d")
        moved = lambda sign: [(F.col(c) + sign * F.col("d.d" + c[1])).alias(c) for c in own]
        if scale == 1:
            sent = base.withColumns(cell).select(key, other.alias("o"), *own, there).select(key, "o", *moved(-1))
        else:
            asked = looks.select(key, *own).distinct().select(key, F.col("cx").alias("ax"), F.col("cy").alias("ay"), *own, there).select(key, "ax", "ay", *moved(1))
            sent = base.withColumns(cell).join(asked, [key, *own]).select(key, other.alias("o"), F.col("ax").alias("cx"), F.col("ay").alias("cy"))
        lists = sent.groupBy(key, *own).agg(F.collect_list("o").alias("others"))  # about 10 k
        ranked = F.sort_array(F.transform(F.filter("others", lambda o: o["id"] != F.col(id_col)), measured))
        near = materialize(looks.join(lists, [key, *own]).withColumn("near", F.slice(ranked, 1, k)).drop("others", *own), "nearest")
        # Whoever has k within one side, or has looked at the whole pair, is done.
        full = (F.size("near") == k) & (F.element_at("near", -1)["away"] <= size * (1 - 1e-9))
        sure = F.coalesce(full, F.lit(False)) | (size >= F.col("_span"))
        done = near.filter(sure).select(key, id_col, *XY, "near")
        found = done if found is None else found.union(done)
        asking = near.filter(~sure).drop("near")
        if asking.isEmpty():
            return found
        scale *= 2


def neighborhood_consistency(matches: DataFrame, k: int = 5, sigma: float = 20.0, key: str = "pair_id", id_col: str = "match_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, id, ``keep`` columns, disp_consistency, ratio_consistency) in [0, 1]; 0.5 in a pair of fewer than 4 matches."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    near = neighbours(matches.select(key, id_col, *keep, *XY, n.alias("n")), k, key, id_col)
    c = F.col
    dx = lambda o: (o["target_x"] - o["source_x"]) - (c("target_x") - c("source_x"))
    dy = lambda o: (o["target_y"] - o["source_y"]) - (c("target_y") - c("source_y"))
    there = lambda o: F.sqrt(F.pow(o["target_x"] - c("target_x"), 2) + F.pow(o["target_y"] - c("target_y"), 2))
    known = lambda of: F.filter(F.transform("near", of), lambda v: v.isNotNull())
    es = known(lambda o: F.sqrt(dx(o) * dx(o) + dy(o) * dy(o)))
    rs = F.array_sort(known(lambda o: F.when(o["away"] > 1e-3, there(o) / o["away"])))
    mean = lambda vs: F.try_divide(F.aggregate(vs, lit(0), lambda s, v: s + v), F.size(vs))
    found = near.select(key, id_col, *keep, "n", mean(es).alias("e"), rs.alias("rs"), F.size("near").alias("some"))
    half = (F.size("rs") - 1) / 2
    at = lambda place: F.get("rs", place.cast("int"))
    found = found.withColumn("mid", (at(F.floor(half)) + at(F.ceil(half))) / 2)
    spread = mean(F.transform("rs", lambda r: F.abs(r - F.col("mid"))))
    ratio_score = F.when(F.size("rs") > 0, 1 / (1 + spread)).otherwise(lit(0.5))
    scores = {"disp_consistency": 1 / (1 + c("e") / max(1.0, sigma)), "ratio_consistency": ratio_score}
    small = c("n") < 4
    return found.filter(small | (c("some") > 0)).select(key, id_col, *keep, *(F.when(small, 0.5).otherwise(clip(v, 0, 1)).alias(name) for name, v in scores.items()))


def relief_strain(matches: DataFrame, fitted: DataFrame, k: int = 6, key: str = "pair_id", id_col: str = "match_id") -> DataFrame:
    """(key, global_rmse, local_rmse, ratio, strained): residuals of the pair's map against those of local affine maps.

    A local map is fitted by least squares to the k matches nearest to a match,
    itself included, and judged at that match; where it can't be fitted the
    pair's residual counts. A match that has no place under the pair's map
    counts 1e6 px. Pairs of fewer than 6 matches aren't computed.
    """
    from tiegrid.operators.fit import U, V, X, Y, solve_moments
    from tiegrid.operators.points import project

    big = matches.select(key, id_col, *XY, F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n")).filter("n >= 6")
    far = F.when(F.isnan("error") | (F.col("error") == float("inf")), lit(1e6)).otherwise(F.coalesce("error", lit(1e6)))
    overall = project(big.join(fitted.select(key, "h"), key)).select(key, id_col, *XY, far.alias("whole"))
    # A match's map is fitted from its own list, whose moments are taken about the match, so no neighbours are shuffled.
    around = neighbours(overall, k - 1, key, id_col, counted=matches)
    around = around.withColumn("near", F.filter("near", lambda o: o["target_x"].isNotNull() & o["target_y"].isNotNull()))
    terms = {"sw": (), "sx": (X,), "sy": (Y,), "su": (U,), "sv": (V,), "sxx": (X, X), "sxy": (X, Y), "syy": (Y, Y), "sxu": (X, U), "syu": (Y, U), "sxv": (X, V), "syv": (Y, V)}
    product = lambda o, names: reduce(mul, (o[c] - F.col(c) for c in names), lit(1))
    total = lambda names: F.aggregate("near", lit(0 if names else 1), lambda s, o: s + product(o, names))
    summed = around.select(key, "whole", *(total(names).alias(m) for m, names in terms.items()))
    det, six = solve_moments({m: F.col(m) for m in terms})
    # The match is the origin, so its local map is off by the constant terms.
    local = F.when((F.col("sw") >= 3) & (det > 1e-12), F.sqrt(six[2] * six[2] + six[5] * six[5]))
    judged = summed.select(key, "whole", F.coalesce(local, "whole").alias("error"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    found = judged.groupBy(key).agg(rms("whole").alias("global_rmse"), rms("error").alias("local_rmse"))
    ratio = F.col("global_rmse") / F.greatest("local_rmse", lit(0.05))
    return found.select(key, "global_rmse", "local_rmse", ratio.alias("ratio"), ((ratio >= 1.35) & (F.col("global_rmse") >= 1.2)).alias("strained"))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), lit(0), lambda s, v: s + v))


#: Targets drawn for each pivot that is chosen among them.
SAMPLED = 16


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def apart(vectors: pd.Series, most: pd.Series) -> pd.Series:
    """Of each list of vectors so many at most, each the furthest from those before it; no two are equal."""
    out = []
    for some, k in zip(vectors, most, strict=True):
        v = np.stack([np.asarray(x, float) for x in some])
        taken, left = [0], np.full(len(v), np.inf)
        while True:
            left = np.minimum(left, ((v - v[taken[-1]]) ** 2).sum(1))
            at = int(left.argmax())
            if len(taken) >= k or not left[at] > 0:
                break
            taken.append(at)
        out.append([v[i].tolist() for i in taken])
    return pd.Series(out)


#: Looks, and targets, that are compared in one task, about; distances that are held at once.
CELL, HELD = 16_384, 250_000


def _matrix(c: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of equally long lists."""
    return np.concatenate([np.zeros(0), *(x.flatten().to_numpy(zero_copy_only=False) for x in c.chunks)]).reshape(len(c), -1)


def near_pairs(source: np.ndarray, target: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, distance) of what can be a source row's least distance, or the first that is further by over 1e-6, among all targets.

    Of each row these are the least, other values up to 1e-6 from it, and the
    first beyond; of equal distances the one with the smallest id. Products of
    matrices give squared distances up to a rounding that is bounded, and all pairs
    within it are worked out term by term. Rows whose least is over ``bound`` give nothing.
    """
    found: list = []
    st, fine = (target * target).sum(1), np.isfinite(target).all(1)
    most = st[fine].max(initial=0.0)
    good = np.where(fine[:, None], target, 0)
    step = max(1, HELD // max(1, len(target)))
    for at in range(0, len(source), step):
        s = source[at : at + step]
        ss = (s * s).sum(1)
        square = s @ (-2 * good.T)
        square += ss[:, None]
        square += np.where(fine, st, np.inf)[None, :]
        square[~np.isfinite(s).all(1)] = np.inf
        # Far more than the rounding of the sums; infinite squares stay what they are.
        slack = np.nan_to_num(8 * (target.shape[1] + 4) * np.finfo(float).eps * (ss + most), nan=0.0, posinf=0.0)
        least = square.min(1)
        open_ = np.nonzero(~(least - slack > np.square(bound[at : at + step]) * (1 + 1e-12)))[0]
        if not len(open_):
            continue
        square, slack, least = square[open_], slack[open_], least[open_]
        upto = np.square(np.sqrt(np.maximum(least + slack, 0)) + 1e-6) + slack
        beyond = np.where(square > upto[:, None], square, np.inf).min(1)
        r, t = np.nonzero(square <= (beyond + 2 * slack)[:, None])
        r = open_[r] + at
        d = np.zeros(len(r))
        for k in range(target.shape[1]):
            off = source[r, k] - target[t, k]
            d += off * off
        d = np.sqrt(d)
        order = np.lexsort((ids[t], d, r))
        r, t, d = r[order], t[order], d[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | ~((d[1:] == d[:-1]) | (np.isnan(d[1:]) & np.isnan(d[:-1])))
        r, t, d = r[new], t[new], d[new]
        first = np.nonzero(np.concatenate(([True], r[1:] != r[:-1])))[0]
        low = np.repeat(d[first], np.diff(np.append(first, len(r))))
        close = ~(d > low + 1e-6) & ~(np.isnan(d) & ~np.isnan(low))
        # The first beyond follows a close one of its row.
        after = np.concatenate(([False], close[:-1] & (r[1:] == r[:-1])))
        kept = close | after
        found.append((r[kept], t[kept], d[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def compared(looks: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, kp_id, target_id, d): distances of looks (key, kp_id, bands, bound, blocks) to targets (key, block, target_id, b) of their blocks that ``near_pairs`` keeps, within their bound.

    Blocks are put together to bins of about CELL targets, so a look is sent once for each bin, not for each block;
    larger ones are cut by the hash of their ids, and so are the looks of a key. Each cell of looks meets each cell of targets in a task of its own.
    """
    sizes = targets.groupBy(key, "block").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy(key).orderBy("block")) - F.col("m")  # as many rows as pivots
    binned = sizes.withColumn("bin", F.floor(before / CELL).cast("int"))
    cells = lambda n: F.greatest(F.ceil(n / CELL), F.lit(1)).cast("int")
    binned = binned.withColumn("tc", cells(F.sum("m").over(Window.partitionBy(key, "bin"))))
    bins = binned.groupBy(key).agg(F.sum("m").alias("m"), F.collect_list(F.struct("block", "bin", "tc")).alias("bins"))
    asked = looks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    plan = bins.join(asked, key).select(key, "bins", cells(F.col("n")).alias("sc"), (F.col("n") + F.col("m")).alias("n"))
    plan = materialize(plan, "descriptor-cells")
    drawn = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    where = F.array_distinct(F.transform(F.filter("bins", lambda b: F.array_contains("blocks", b["block"])), lambda b: F.struct(b["bin"].alias("bin"), b["tc"].alias("tc"))))
    left = join_on_hot_keys(looks, plan, key, "n").select(key, "kp_id", "bands", "bound", "blocks", drawn("kp_id", "sc").alias("_s"), F.explode(where).alias("w"))
    left = left.select(key, "kp_id", "bands", "bound", "blocks", "_s", F.col("w.bin").alias("_bin"), F.col("w.tc").alias("_tc")).withColumn("_t", every("_tc")).drop("_tc")
    right = join_on_hot_keys(targets, plan, key, "n").withColumn("w", F.filter("bins", lambda b: b["block"] == F.col("block"))[0])
    right = right.select(key, "block", "target_id", "b", F.col("w.bin").alias("_bin"), F.col("w.tc").alias("_tc"), "sc").withColumn("_t", drawn("target_id", "_tc")).withColumn("_s", every("sc")).drop("_tc", "sc")

    def match(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({c: pa.array([], t) for c, t in ((key, one[key].type), ("kp_id", one["kp_id"].type), ("target_id", two["target_id"].type), ("d", pa.float64()))})
        bound = one["bound"].to_numpy()
        bound = np.where(np.isnan(bound), np.inf, bound)
        # Ids of any type, by their order.
        order = pc.sort_indices(two["target_id"]).to_numpy()
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(len(order))
        block = two["block"].to_numpy()
        lists = one["blocks"].combine_chunks()
        needs = np.zeros((one.num_rows, int(block.max()) + 1), bool)
        rows, blocks = np.repeat(np.arange(one.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        needs[rows[blocks < needs.shape[1]], blocks[blocks < needs.shape[1]]] = True
        # Blocks that every look needs are compared as one.
        common = needs.all(0)
        parts = [(np.arange(one.num_rows), np.nonzero(common[block])[0])]
        parts += [(np.nonzero(needs[:, k])[0], np.nonzero(block == k)[0]) for k in np.unique(block[~common[block]])]
        source, target = _matrix(one["bands"]), _matrix(two["b"])
        found = []
        with np.errstate(all="ignore"):
            for mine, theirs in parts:
                if len(mine) and len(theirs):
                    r, t, d = near_pairs(source[mine], target[theirs], ids[theirs], bound[mine])
                    found.append((mine[r], theirs[t], d))
        r, t, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        limit = bound[r]
        kept = (d <= limit) | np.isinf(limit)
        r, t, d = pa.array(r[kept]), pa.array(t[kept]), d[kept]
        return pa.table({key: one[key].take(r), "kp_id": one["kp_id"].take(r), "target_id": two["target_id"].take(t), "d": pa.array(d)})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"{key} {kind(looks, key)}, kp_id {kind(looks, 'kp_id')}, target_id {kind(targets, 'target_id')}, d double"
    cell = [key, "_bin", "_s", "_t"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(match, schema)


def descriptor_looks(source: DataFrame, target: DataFrame, key: str = "pair_id", pivots: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(looks, second looks, blocks): which source descriptors have to be compared with which blocks of target ones.

    As many target descriptors of a pair as the root of their number, ``pivots``
    at most, are pivots, each the furthest from those before it among SAMPLED
    times as many targets, drawn by a hash of their ids; a target belongs to the
    block of its nearest one. A source descriptor looks into the block of its
    nearest pivot first. That bounds the distances of its two nearest, and no
    block whose pivot is further away than this bound and the block's radius can
    hold one of them, by the triangle inequality. ``looks`` are the first ones
    (key, kp_id, block), ``second looks`` the others that are needed, with the
    first ones, and their ``bound`` (NULL: none); ``blocks`` are targets (key,
    block, target_id, b).
    """
    looks, told, blocks = _looks(source, target, key, pivots)
    return looks, told.select(key, "kp_id", "bands", "bound", F.explode("blocks").alias("block")), blocks


def _looks(source: DataFrame, target: DataFrame, key: str, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``descriptor_looks`` gives, with the second looks of a descriptor as one list ``blocks``."""
    whole = lambda df: df.filter(F.col("bands").isNotNull() & ~F.exists("bands", F.isnull))
    target, source = whole(target).select(key, F.col("kp_id").alias("target_id"), F.col("bands").alias("b")), whole(source).select(key, "kp_id", "bands")
    sizes = target.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    drawn = Window.partitionBy(key).orderBy(F.xxhash64("target_id"), "target_id")
    few = F.least(F.lit(pivots), F.ceil(F.sqrt("n"))).cast("int")
    sample = target.withColumn("k", F.row_number().over(drawn)).filter(F.col("k") <= SAMPLED * pivots).join(sizes, key).filter(F.col("k") <= SAMPLED * few)
    drawn_lists = sample.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "b"))), lambda p: p["b"]).alias("some"), F.first("n").alias("n"))
    lists = materialize(drawn_lists.select(key, apart("some", few).alias("pivots"), "n"), "pivots")
    away = lambda c: F.transform("pivots", lambda p: _distance(F.col(c), p))
    placed = join_on_hot_keys(target, lists, key, "n").withColumn("far", away("b"))
    blocks = placed.select(key, "target_id", "b", F.array_position("far", F.array_min("far")).cast("int").alias("block"), F.array_min("far").alias("d"))
    blocks = materialize(blocks, "descriptor-blocks")
    radii = blocks.groupBy(key, "block").agg(F.max("d").alias("radius")).groupBy(key).agg(F.collect_list(F.struct("block", "radius")).alias("radii"))
    both = materialize(lists.join(radii, key), "descriptor-radii")
    seen = join_on_hot_keys(source, both, key, "n").withColumn("far", away("bands"))
    seen = seen.withColumn("least", F.array_min("far")).withColumn("next", F.array_min(F.filter("far", lambda d: d > F.col("least") + 1e-6)))
    near = F.transform("radii", lambda r: F.struct(r["block"].alias("block"), (F.element_at("far", r["block"]) - r["radius"] - 1e-9 * (1 + F.element_at("far", r["block"]))).alias("low")))
    seen = seen.select(key, "kp_id", "bands", "least", "next", F.array_position("far", F.col("least")).cast("int").alias("block"), near.alias("near"))
    seen = materialize(seen, "descriptor-looks")
    looks = seen.select(key, "kp_id", "bands", F.lit(None).cast("double").alias("bound"), F.array("block").alias("blocks"))
    # Of two distances that differ by more than the tolerance, the second nearest can't exceed the larger.
    least = Window.partitionBy(key, "kp_id")
    inside = compared(looks, blocks, key).withColumn("_least", F.min("d").over(least)).groupBy(key, "kp_id").agg(F.min(F.when(F.col("d") > F.col("_least") + 1e-6, F.col("d"))).alias("other"))
    told = seen.join(materialize(inside, "descriptor-bounds"), [key, "kp_id"], "left").withColumn("bound", F.least("next", "other"))
    needed = F.filter("near", lambda b: F.col("bound").isNull() | (b["low"] <= F.col("bound")))
    told = told.select(key, "kp_id", "bands", "bound", F.transform(needed, lambda n: n["block"]).alias("blocks"))
    return seen.select(key, "kp_id", "block"), told, blocks.select(key, "block", "target_id", "b")


def descriptor_match(source: DataFrame, target: DataFrame, ratio: float = 0.8, key: str = "pair_id", pivots: int = 64) -> DataFrame:
    """(key, kp_id, target_id, distance, second, kept): the nearest target descriptor and the next one that isn't equally near (1e-6).

    Kept if the distance is at most ``ratio`` of the second one; without a second
    one, only if it is 0 (1e-8). Equal to a comparison of all pairs, but only
    blocks of targets that can hold one of the two are compared
    (``descriptor_looks``), as matrices, and of these distances only those that
    can be one of the two are shuffled (``compared``). Descriptors with a missing number don't take part.
    """
    _, looks, blocks = _looks(source, target, key, pivots)
    d = compared(looks, blocks, key)
    # One sort of each keypoint's distances gives the least, and the first that is further by more than the tolerance.
    by_distance = Window.partitionBy(key, "kp_id").orderBy("d", "target_id")
    least = d.withColumns({"_least": F.first("d").over(by_distance), "_target": F.first("target_id").over(by_distance)})
    second = least.groupBy(key, "kp_id").agg(
        F.first("_target").alias("target_id"), F.first("_least").alias("distance"), F.min(F.when(F.col("d") > F.col("_least") + 1e-6, F.col("d"))).alias("second")
    )
    return second.withColumn("kept", F.coalesce(F.col("distance") <= ratio * F.col("second"), F.col("distance") <= 1e-8))


def backfill_features(records: DataFrame, index: DataFrame, features: list[str]) -> DataFrame:
    """Missing features from an index by exact position (4 digits), then rough position (2), then (x, y, confidence); adds ``filled_by``."""
    keys = {
        "exact": [F.round(c, 4) for c in XY], "rough": [F.round(c, 2) for c in XY],
        "confidence": [F.round("source_x", 2), F.round("source_y", 2), F.round("confidence", 6)],
    }
    missing = lambda: F.array_contains(F.array(*(F.col(f).isNull() for f in features)), True)
    # Both are read more than once; records that miss nothing take no part in the joins.
    index = materialize(index.select("source_x", "source_y", "target_x", "target_y", "confidence", *features), "backfill-index")
    told = materialize(records.withColumn("filled_by", F.when(missing(), "none")), "backfill-records")
    out = told.filter(F.col("filled_by").isNotNull())
    for name, parts in keys.items():
        named = [p.alias(f"_k{i}") for i, p in enumerate(parts)]
        found = index.select(*named, *features).groupBy(*(f"_k{i}" for i in range(len(parts)))).agg(*(F.min(f).alias("_" + f) for f in features), F.lit(True).alias("_hit"))
        out = out.withColumns({f"_k{i}": p for i, p in enumerate(parts)}).join(found, [f"_k{i}" for i in range(len(parts))], "left")
        use = (F.col("filled_by") == "none") & F.col("_hit").isNotNull()
        out = out.withColumns({**{f: F.when(use, F.coalesce(F.col(f), F.col("_" + f))).otherwise(F.col(f)) for f in features}, "filled_by": F.when(use, F.lit(name)).otherwise(F.col("filled_by"))})
        out = out.drop("_hit", *("_" + f for f in features), *(f"_k{i}" for i in range(len(parts))))
    return told.filter(F.col("filled_by").isNull()).unionByName(out)


def topology_preservation(matches: DataFrame, least: float = 5.0, first: int = 15, key: str = "pair_id", id_col: str = "match_id") -> DataFrame:
    """(key, n, mean_ratio, std_ratio, angle_mean, angle_median, shape_mean, area_ratio) of pairs of 4 matches or more; NULL where nothing counts.

    Target to source distances of match pairs that lie further apart than
    ``least``; the change, in degrees, of the angle at each match between its
    two nearest others; and over triangles of the ``first`` matches with
    perimeters over 10 the summed change of their ordered side shares, and the
    ratio of areas where the source's is over 10.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    m = matches.select(key, id_col, *XY, n.alias("n"), F.row_number().over(Window.partitionBy(key).orderBy(id_col)).alias("i")).filter("n >= 4")
    other = m.select(F.col(key).alias("_k"), F.col("i").alias("j"), *(F.col(c).alias("o_" + c) for c in XY))
    span = lambda side, p="", q="o_": F.sqrt(F.pow(F.col(f"{p}{side}_x") - F.col(f"{q}{side}_x"), 2) + F.pow(F.col(f"{p}{side}_y") - F.col(f"{q}{side}_y"), 2))
    both = m.join(other, (F.col(key) == F.col("_k")) & (F.col("i") < F.col("j"))).select(key, "i", "j", span("source").alias("s"), span("target").alias("t"))
    ratio = F.when(F.col("s") > least, F.col("t") / F.col("s"))
    ratios = both.groupBy(key).agg(F.avg(ratio).alias("mean_ratio"), F.stddev_pop(ratio).alias("std_ratio"))

    close = neighbours(m.select(key, id_col, *XY), 2, key, id_col, counted=matches)
    leg = lambda o, side: F.struct((o[f"{side}_x"] - F.col(f"{side}_x")).alias("x"), (o[f"{side}_y"] - F.col(f"{side}_y")).alias("y"))
    legs = close.select(key, *(leg(F.get("near", F.lit(r - 1)), side).alias(f"{side[0]}{r}") for r in (1, 2) for side in ("source", "target")))
    size = lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])

    def angle(c: str) -> Column:
        p, q = F.col(f"{c}1"), F.col(f"{c}2")
        return F.degrees(F.acos(clip((p["x"] * q["x"] + p["y"] * q["y"]) / (size(p) * size(q) + 1e-6), -1, 1)))

    turned = legs.select(key, F.abs(angle("s") - angle("t")).alias("a")).groupBy(key).agg(F.avg("a").alias("angle_mean"), F.percentile("a", F.lit(0.5)).alias("angle_median"))

    few = both.filter((F.col("i") <= first) & (F.col("j") <= first))
    ij, jk, ik = (few.toDF(key, p, q, f"s{p}{q}", f"t{p}{q}") for p, q in (("i", "j"), ("j", "k"), ("i", "k")))
    tri = ij.join(jk, [key, "j"]).join(ik, [key, "i", "k"])
    sides = {c: [F.col(f"{c}{e}") for e in ("ij", "jk", "ik")] for c in "st"}
    tri = tri.select(key, *(sum(sides[c][1:], sides[c][0]).alias("p" + c) for c in "st"), *(F.array_sort(F.array(*sides[c])).alias(c) for c in "st"))
    tri = tri.filter("ps > 10 AND pt > 10")

    def area(c: str) -> Column:
        h = F.col("p" + c) / 2
        return F.sqrt(F.greatest(lit(0), h * (h - F.col(c)[0]) * (h - F.col(c)[1]) * (h - F.col(c)[2])))

    shape = sum((F.abs(F.col("s")[k] / F.col("ps") - F.col("t")[k] / F.col("pt")) for k in (1, 2)), F.abs(F.col("s")[0] / F.col("ps") - F.col("t")[0] / F.col("pt")))
    shapes = tri.groupBy(key).agg(F.avg(shape).alias("shape_mean"), F.avg(F.when(area("s") > 10, area("t") / area("s"))).alias("area_ratio"))
    sizes = m.groupBy(key).agg(F.first("n").alias("n"))
    return sizes.join(ratios, key, "left").join(turned, key, "left").join(shapes, key, "left")


def refill_candidates(keypoints: DataFrame, matches: DataFrame, transforms: DataFrame, width: float, height: float, gap: float = 6.0, cap: int = 80, key: str = "pair_id", id_col: str = "kp_id") -> DataFrame:
    """Keypoints at least ``gap`` px from every match of their pair, with a predicted target inside the frame; at most ``cap`` a pair.

    The distance anti-join looks into the cells around a keypoint alone.
    """
    from tiegrid.operators.points import mapped

    cellx, celly = F.floor(F.col("source_x") / gap), F.floor(F.col("source_y") / gap)
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    taken = matches.select(F.col(key).alias("o_key"), F.col("source_x").alias("ox"), F.col("source_y").alias("oy"), cellx.alias("cx"), celly.alias("cy"), F.explode(steps).alias("d"))
    taken = taken.select("o_key", "ox", "oy", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    close = (F.col(key) == F.col("o_key")) & (cellx == F.col("cx")) & (celly == F.col("cy")) & (F.pow(F.col("source_x") - F.col("ox"), 2) + F.pow(F.col("source_y") - F.col("oy"), 2) < gap * gap)
    free = keypoints.join(taken, close, "left_anti").join(transforms.select(key, "h"), key)
    px, py, pz = mapped(F.col("h"), F.col("source_x"), F.col("source_y"))
    free = free.filter(pz > 1e-12).withColumns({"px": px / pz, "py": py / pz}).filter((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    first = Window.partitionBy(key).orderBy(id_col)
    return free.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= cap).select(key, id_col, "px", "py")


def grouped_split(df: DataFrame, group: str, label: str, test_size: float, tries: int = 10) -> DataFrame:
    """Adds ``is_test``: whole groups on one side, both classes on both; the first of ``tries`` seeds that does it, else an error.

    All seeds are judged in one aggregation over groups.
    """
    per_group = df.groupBy(group).agg(F.count_if(F.col(label)).alias("yes"), F.count_if(~F.col(label)).alias("no"))
    seeds = per_group.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("seed"))
    draw = F.pmod(F.crc32(F.concat_ws("|", F.col("seed"), F.col(group).cast("string")).cast("binary")), F.lit(10_000))
    sided = seeds.withColumn("t", draw < int(test_size * 10_000))
    sums = [F.sum(F.when(F.col("t") == side, F.col(c)).otherwise(0)) for side in (True, False) for c in ("yes", "no")]
    good = sided.groupBy("seed").agg(F.least(*sums).alias("least")).filter("least > 0").agg(F.min("seed")).first()[0]
    if good is None:
        raise ValueError("no split has both classes on both sides")
    chosen = F.pmod(F.crc32(F.concat_ws("|", F.lit(good), F.col(group).cast("string")).cast("binary")), F.lit(10_000)) < int(test_size * 10_000)
    return df.withColumn("is_test", chosen)


def persist_split(split: DataFrame, group: str, path: str) -> None:
    """Write the groups of both sides of ``grouped_split`` as JSON, in order, under ``path``/train_groups and ``path``/test_groups; overlapping sides raise."""
    from tiegrid.operators.catalog import assert_disjoint

    train, test = (split.filter(c).select(group).distinct() for c in ("NOT is_test", "is_test"))
    assert_disjoint(train, test, group)
    for name, side in (("train_groups", train), ("test_groups", test)):
        side.orderBy(group).write.mode("overwrite").json(f"{path}/{name}")


def train_verifier(df: DataFrame, features: list[str], label: str = "truth", trees: int = 100):
    """A class-balanced random forest; data of one class is refused."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        raise ValueError("training data holds one class only")
    n = sum(counts.values())
    weight = F.when(F.col(label), lit(n / (2 * counts[True]))).otherwise(lit(n / (2 * counts[False])))
    ready = df.withColumns({"label": F.col(label).cast("double"), "weight": weight})
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), RandomForestClassifier(numTrees=trees, weightCol="weight", seed=42, maxDepth=8)]
    return Pipeline(stages=stages).fit(ready)


def score_matches(matches: DataFrame, model=None, threshold: float = 0.5) -> DataFrame:
    """Matches with ``probability_true`` at or above a threshold; without a model the confidence filter stands in."""
    from tiegrid.operators.selection import baseline_filter

    if model is None:
        return baseline_filter(matches)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(matches).withColumn("probability_true", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction").filter(F.col("probability_true") >= threshold)


def classification_report(predicted: DataFrame, slice_col: str, truth: str = "truth", prediction: str = "predicted") -> DataFrame:
    """(slice, n, tp, fp, fn, tn, accuracy, precision, recall, f1) per slice, and over all with a NULL slice."""
    t, p = F.col(truth), F.col(prediction)
    s = predicted.rollup(slice_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )
    c = F.col
    precision, recall = F.try_divide(c("tp"), c("tp") + c("fp")), F.try_divide(c("tp"), c("tp") + c("fn"))
    return s.withColumns({"accuracy": F.try_divide(c("tp") + c("tn"), c("n")), "precision": precision, "recall": recall}).withColumn(
        "f1", F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall"))
    )


def ranking_report(scored: DataFrame, score: str, truth: str = "truth", key: str | None = None) -> DataFrame:
    """(roc_auc, average_precision): areas from counts at each distinct score; tied scores count half. With ``key`` each group has its own."""
    keys = [key] if key else []
    t = scored.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    if key:
        down = Window.partitionBy(key).orderBy(F.desc("s"))
        t = t.withColumns({"upto_p": F.sum("p").over(down), "upto_n": F.sum("n").over(down)})
    else:
        t = running_sums(t, "s", ["p", "n"], descending=True)
    tp, fp = F.col("upto_p"), F.col("upto_n")
    return t.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("n") * (tp - F.col("p") / 2)), F.sum("p") * F.sum("n")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("p") * F.try_divide(tp, tp + fp)), F.sum("p")).alias("average_precision"),
    )


def _training_rows(matches: DataFrame, features: list[str], needed: list[str], defaults: dict[str, float] | None, allow_consensus: bool) -> DataFrame:
    """All rows with truth, group, features filled by their defaults, and ``fate``: no_label, missing_features, duplicate or kept."""
    labelled = label_matches(matches, allow_consensus)
    whole = reduce(and_, (F.col(c).isNotNull() & (~F.isnan(c) if t in ("double", "float") else F.lit(True)) for c, t in labelled.dtypes if c in needed), F.lit(True))
    fate = F.when(F.col("truth").isNull(), "no_label").when(~whole, "missing_features")
    marked = labelled.withColumn("fate", fate).withColumns({c: F.coalesce(c, lit(v)) for c, v in (defaults or {}).items()})
    keys = [*(F.round(f, 6) for f in features), F.col("truth"), *(F.round(F.coalesce(c, lit(0)), 4) for c in XY)]
    grouped = provenance_group(marked)
    order = Window.partitionBy(F.col("fate"), *keys).orderBy("match_id", "group_id")
    rows = grouped.filter("fate IS NULL").withColumn("fate", F.when(F.row_number().over(order) == 1, "kept").otherwise("duplicate"))
    return rows.unionByName(grouped.filter("fate IS NOT NULL"))


def training_set(matches: DataFrame, features: list[str], needed: list[str], defaults: dict[str, float] | None = None, allow_consensus: bool = False) -> DataFrame:
    """Labelled, complete and distinct rows with group and domain; repeats on rounded features, label and position go.

    Features that are missing take ``defaults``, if given; rows that lack a
    ``needed`` one are left out. ``training_report`` counts what goes.
    """
    return _training_rows(matches, features, needed, defaults, allow_consensus).filter("fate = 'kept'").drop("fate")


def training_report(matches: DataFrame, features: list[str], needed: list[str], file_col: str = "file", defaults: dict[str, float] | None = None, allow_consensus: bool = False) -> DataFrame:
    """Counts of ``training_set``'s rows for each file, and of all files in a row of NULL file.

    inliers and outliers are kept rows; skipped_no_label, skipped_missing_features
    and duplicates are not. synthetic_geometry, hand and ransac count where the
    labels of complete rows, repeated ones included, come from. ``group_key`` is
    the finest kind of group among the kept rows. One aggregation, two levels.
    """
    rows = _training_rows(matches, features, needed, defaults, allow_consensus)
    is_fate = lambda f: F.col("fate") == f
    complete = F.col("fate").isin("kept", "duplicate")
    has = lambda level: F.max(is_fate("kept") & (F.col("group_level") == level))
    counts = rows.groupingSets([[F.col(file_col)], []], F.col(file_col)).agg(
        F.grouping(file_col).alias("is_total"), F.count_if(is_fate("kept") & F.col("truth")).alias("inliers"), F.count_if(is_fate("kept") & ~F.col("truth")).alias("outliers"),
        F.count_if(is_fate("no_label")).alias("skipped_no_label"), F.count_if(is_fate("missing_features")).alias("skipped_missing_features"), F.count_if(is_fate("duplicate")).alias("duplicates"),
        *(F.count_if(complete & (F.col("truth_source") == s)).alias(s) for s in ("synthetic_geometry", "hand", "ransac")),
        F.when(has("image_pair"), "image_pair").when(has("region"), "region").when(has("source_image"), "source_image").otherwise("none").alias("group_key"),
    )
    return counts.withColumn("is_total", F.col("is_total") == 1)


