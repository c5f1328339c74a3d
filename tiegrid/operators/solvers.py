"""Solvers over many pairs: sums run as Spark aggregates, only small systems are solved in vectorised functions."""

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tiegrid.functions.algebra import affine, lit, normal3
from tiegrid.operators.fit import MOMENTS, U, V, X, Y, fit_affine, fit_sums, moment_columns
from tiegrid.operators.points import conditioned, project, whiten, whitened
from tiegrid.plans.work import join_on_hot_keys, materialize

PAIRS9 = [(i, j) for i in range(9) for j in range(i, 9)]
PAIRS6 = [(i, j) for i in range(6) for j in range(i, 6)]


def stacked(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in values]) if len(values) else np.zeros((0, 1))


@F.pandas_udf(ArrayType(DoubleType()))
def homography_of(sums: pd.Series, norms: pd.Series) -> pd.Series:
    """A 3 x 3 matrix from the 45 sums of A'A over normalised points and the normalisation (mx, my, s, mu, mv, t)."""
    s, n = stacked(sums), stacked(norms)
    if not len(s):
        return pd.Series([], dtype=object)
    full = np.zeros((len(s), 9, 9))
    for k, (i, j) in enumerate(PAIRS9):
        full[:, i, j] = full[:, j, i] = s[:, k]
    h = np.linalg.eigh(full)[1][:, :, 0].reshape(-1, 3, 3)
    to = np.zeros((len(s), 3, 3))
    back = np.zeros((len(s), 3, 3))
    mx, my, scale, mu, mv, other = n.T
    to[:, 0, 0] = to[:, 1, 1] = scale
    to[:, 0, 2], to[:, 1, 2], to[:, 2, 2] = -scale * mx, -scale * my, 1
    back[:, 0, 0] = back[:, 1, 1] = 1 / other
    back[:, 0, 2], back[:, 1, 2], back[:, 2, 2] = mu, mv, 1
    h = back @ h @ to
    last = h[:, 2:3, 2:3]
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(np.abs(last) > 1e-12, h / last, np.nan)
    return pd.Series(list(h.reshape(-1, 9)))


@F.pandas_udf(ArrayType(DoubleType()))
def solve6(left: pd.Series, right: pd.Series) -> pd.Series:
    """Solutions of symmetric 6 x 6 systems; NaN where one is singular."""
    a, b = stacked(left), stacked(right)
    if not len(a):
        return pd.Series([], dtype=object)
    full = np.zeros((len(a), 6, 6))
    for k, (i, j) in enumerate(PAIRS6):
        full[:, i, j] = full[:, j, i] = a[:, k]
    out = np.full((len(a), 6), np.nan)
    good = np.linalg.cond(full) < 1e14
    if good.any():
        out[good] = np.linalg.solve(full[good], b[good][:, :, None])[:, :, 0]
    return pd.Series(list(out))


def fit_homography(matches: DataFrame, key: str | list[str] = "pair_id", weight: str | None = None, mode: str = "ordinary") -> DataFrame:
    """(key, n, h): normalised direct linear transform of each group of at least 4 matches.

    mode "scaled" weighs a match's rows by the root of ``weight`` (at least
    1e-6), or without one of 2 over the trace of its conditioned covariance;
    "whitened" weighs both rows together by the inverse of that covariance;
    "ordinary" weighs all alike.
    """
    keys = [key] if isinstance(key, str) else key
    if mode not in ("ordinary", "scaled", "whitened"):
        raise ValueError(f"no mode {mode!r}")
    if mode == "whitened" or mode == "scaled" and not weight:
        matches = conditioned(matches)
    if mode == "scaled" and not weight:
        matches = matches.withColumn("_w", 1 / F.greatest((F.col("sxx") + F.col("syy")) / 2, lit(1e-4)))
    elif mode == "scaled" or weight:
        matches = matches.withColumn("_w", F.greatest(F.col(weight).cast("double"), lit(1e-6)))
    else:
        matches = matches.withColumn("_w", lit(1))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy") if mode == "whitened" else None
    parts = {"p": F.col("syy") / det, "q": -F.col("sxy") / det, "r": F.col("sxx") / det} if mode == "whitened" else {"p": F.col("_w"), "q": lit(0), "r": F.col("_w")}
    return _direct(matches.select(*keys, X, Y, U, V, *(v.alias(k) for k, v in parts.items())), keys)


def _direct(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, h) of matches (keys, coordinates) whose two rows weigh p and r, and q together."""
    means = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias("m_" + c) for c in (X, Y, U, V))).filter("n >= 4")
    away = lambda a, b: F.sqrt(F.pow(F.col(a) - F.col("m_" + a), 2) + F.pow(F.col(b) - F.col("m_" + b), 2))
    centred = matches.join(means, keys)
    scales = centred.groupBy(*keys).agg((np.sqrt(2.0) / F.avg(away(X, Y))).alias("s"), (np.sqrt(2.0) / F.avg(away(U, V))).alias("t"))
    c = centred.join(scales, keys)
    x, y = (F.col(X) - F.col("m_" + X)) * F.col("s"), (F.col(Y) - F.col("m_" + Y)) * F.col("s")
    u, v = (F.col(U) - F.col("m_" + U)) * F.col("t"), (F.col(V) - F.col("m_" + V)) * F.col("t")
    c = c.select(*keys, "n", *("m_" + k for k in (X, Y, U, V)), "s", "t", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"), "p", "q", "r")
    x, y, u, v, zero, one = F.col("x"), F.col("y"), F.col("u"), F.col("v"), lit(0), lit(1)
    rows = [(-x, -y, -one, zero, zero, zero, u * x, u * y, u), (zero, zero, zero, -x, -y, -one, v * x, v * y, v)]
    one_, two = rows
    mixed = lambda i, j: F.col("p") * one_[i] * one_[j] + F.col("q") * (one_[i] * two[j] + two[i] * one_[j]) + F.col("r") * two[i] * two[j]
    sums = [F.sum(mixed(i, j)) for i, j in PAIRS9]
    norms = F.array(*(F.first(k) for k in ("m_" + X, "m_" + Y, "s", "m_" + U, "m_" + V, "t")))
    found = c.groupBy(*keys, "n").agg(F.array(*sums).alias("sums"), norms.alias("norms"))
    return found.select(*keys, "n", homography_of("sums", "norms").alias("h"))


def refine_gls(matches: DataFrame, initial: DataFrame, rounds: int = 4, tolerance: float = 1e-6, key: str = "pair_id") -> DataFrame:
    """(key, h, objective, status): affine maps by covariance-weighted least squares, starting from ``initial`` (key, h).

    ``refine_homography`` does so for homographies.
    Each round rebuilds the residual covariances under the maps of the last,
    sums the whitened normal equations of each pair, and keeps the best map so
    far. Pairs that no longer change leave the loop.
    """
    rows = materialize(conditioned(matches).select(key, X, Y, U, V, "sxx", "sxy", "syy"), "gls-matches")
    best = materialize(initial.select(key, "h", lit(float("inf")).alias("objective"), F.lit("running").alias("status")), "gls")
    for _ in range(rounds + 1):
        active = best.filter("status = 'running'")
        w = whitened(rows.join(active.select(key, "h"), key))
        a, b, d, e = (F.col("h")[k] for k in (0, 1, 3, 4))
        xx, xy, yy = F.col("sxx"), F.col("sxy"), F.col("syy")
        rxx = a * a * xx + 2 * a * b * xy + b * b * yy + xx
        rxy = a * d * xx + (a * e + b * d) * xy + b * e * yy + xy
        ryy = d * d * xx + 2 * d * e * xy + e * e * yy + yy
        w = w.withColumns({"rxx": rxx, "rxy": rxy, "ryy": ryy}).withColumn("det", F.col("rxx") * F.col("ryy") - F.col("rxy") * F.col("rxy"))
        w = w.select(key, X, Y, U, V, "distance", (F.col("ryy") / F.col("det")).alias("p"), (-F.col("rxy") / F.col("det")).alias("q"), (F.col("rxx") / F.col("det")).alias("r"))
        t = (F.col(X), F.col(Y), lit(1))
        block = {(0, 0): F.col("p"), (0, 1): F.col("q"), (1, 1): F.col("r")}
        left = [F.sum(block[(i // 3, j // 3)] * t[i % 3] * t[j % 3]) for i, j in PAIRS6]
        pull = (F.col("p") * F.col(U) + F.col("q") * F.col(V), F.col("q") * F.col(U) + F.col("r") * F.col(V))
        right = [F.sum(pull[i // 3] * t[i % 3]) for i in range(6)]
        solved = w.groupBy(key).agg(F.array(*left).alias("left"), F.array(*right).alias("right"), F.avg(F.col("distance") * F.col("distance")).alias("now"))
        solved = solved.select(key, "now", solve6("left", "right").alias("p6"))
        done = best.join(solved, key, "left")
        new = affine(*(F.col("p6")[k] for k in range(6)))
        failed = F.exists("p6", F.isnan)
        better = F.col("now") < F.col("objective") - tolerance
        running = F.col("status") == "running"
        status = F.when(~running, F.col("status")).when(F.col("p6").isNull() | failed, "failed").when(better, "running").otherwise("converged")
        best = materialize(done.select(
            key, F.when(running & better & ~failed, new).otherwise(F.col("h")).alias("h"),
            F.when(running & better, F.col("now")).otherwise(F.col("objective")).alias("objective"), status.alias("status"),
        ), "gls")
        if best.filter("status = 'running'").isEmpty():
            break
    return best.withColumn("status", F.when(F.col("status") == "running", "max_rounds").otherwise(F.col("status")))


PAIRS8 = [(i, j) for i in range(8) for j in range(i, 8)]


@F.pandas_udf(ArrayType(DoubleType()))
def damped_step8(left: pd.Series, right: pd.Series, damping: pd.Series) -> pd.Series:
    """Levenberg-Marquardt steps of 8 x 8 systems: the diagonal grows by damping times itself and 1e-6; NULL where one is singular."""
    a, b, lam = stacked(left), stacked(right), damping.to_numpy(float)
    out: list = [None] * len(lam)
    if not len(lam):
        return pd.Series(out, dtype=object)
    full = np.zeros((len(lam), 8, 8))
    for k, (i, j) in enumerate(PAIRS8):
        full[:, i, j] = full[:, j, i] = a[:, k]
    d = np.arange(8)
    full[:, d, d] += lam[:, None] * (full[:, d, d] + 1e-6)
    for k in range(len(lam)):
        try:
            step = np.linalg.solve(full[k], -b[k])
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(step).all():
            out[k] = step.tolist()
    return pd.Series(out, dtype=object)


def refine_homography(matches: DataFrame, initial: DataFrame | None = None, rounds: int = 15, key: str = "pair_id") -> DataFrame:
    """(key, n, h, objective, initial_objective, iterations, status): homographies that minimise the sum of squared whitened residuals.

    The covariances of matches, conditioned (``conditioned``), are those of the
    residuals. From ``initial`` (key, h), or the whitened direct transform,
    damped Gauss-Newton steps of the eight free elements are tried: one
    aggregation over the matches of all pairs gives objective, gradient and
    normal matrix at the maps on trial, only 8 x 8 systems are solved in a
    vectorised function. A step that lowers the objective is taken and the
    damping falls to a fifth, else it grows tenfold, so the objective never
    rises. A pair leaves the loop as "converged_gradient" or "converged_step"
    (norms below 1e-6) or "singular"; after ``rounds`` trials it is
    "cost_decreased" or "max_rounds". Pairs of fewer than 4 matches, or without
    a finite initial map, are left out.
    """
    c = conditioned(matches.dropna(subset=[X, Y, U, V]))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    m = c.select(key, X, Y, U, V, (F.col("syy") / det).alias("p"), (-F.col("sxy") / det).alias("q"), (F.col("sxx") / det).alias("r"))
    m = materialize(m, "lm-matches")
    start = (_direct(m, [key]) if initial is None else initial).select(key, normal3(F.col("h")).alias("trial"))
    start = start.filter(F.col("trial").isNotNull() & ~F.exists("trial", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    sizes = m.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    nothing = F.lit(None).cast("array<double>")
    inf = lit(float("inf"))
    state = start.join(sizes, key).select(
        key, "n", "trial", nothing.alias("h"), inf.alias("objective"), F.lit(None).cast("double").alias("initial_objective"), nothing.alias("left"), nothing.alias("right"),
        lit(1e-3).alias("damping"), lit(1).alias("step"), F.lit(-1).alias("iterations"), F.lit("running").alias("status"),
    )
    state = materialize(state, "lm-state")
    t, x, y = F.col("trial"), F.col(X), F.col(Y)
    ended = None
    for turn in range(rounds + 1):
        rows = join_on_hot_keys(m, state.select(key, "trial", "n"), key, "n")
        w = t[6] * x + t[7] * y + 1
        rows = rows.withColumn("w", w).withColumns({"u": F.try_divide(t[0] * x + t[1] * y + t[2], F.col("w")), "v": F.try_divide(t[3] * x + t[4] * y + t[5], F.col("w"))})
        rows = rows.select(key, "p", "q", "r", (F.abs("w") < 1e-9).alias("lost"), F.try_divide(x, F.col("w")).alias("a"), F.try_divide(y, F.col("w")).alias("b"), F.try_divide(lit(1), F.col("w")).alias("c"), "u", "v", (F.col("u") - F.col(U)).alias("e"), (F.col("v") - F.col(V)).alias("f"))
        a, b, one, zero = F.col("a"), F.col("b"), F.col("c"), lit(0)
        first = (a, b, one, zero, zero, zero, -F.col("u") * a, -F.col("u") * b)
        other = (zero, zero, zero, a, b, one, -F.col("v") * a, -F.col("v") * b)
        p, q, r, e, f = (F.col(k) for k in "pqref")
        form = lambda i, j: p * first[i] * first[j] + q * (first[i] * other[j] + other[i] * first[j]) + r * other[i] * other[j]
        pull = lambda i: p * first[i] * e + q * (first[i] * f + other[i] * e) + r * other[i] * f
        seen = rows.groupBy(key).agg(
            F.when(F.max("lost"), lit(1e12)).otherwise(F.sum(p * e * e + 2 * q * e * f + r * f * f)).alias("now"),
            F.array(*(F.sum(form(i, j)) for i, j in PAIRS8)).alias("new_left"), F.array(*(F.sum(pull(i)) for i in range(8))).alias("new_right"),
        )
        better = F.col("now") < F.col("objective")
        new = state.join(seen, key).withColumns({"better": F.coalesce(better, F.lit(False)), "iterations": F.col("iterations") + 1})
        take = lambda fresh, old: F.when(F.col("better"), F.col(fresh)).otherwise(F.col(old))
        eased = F.when(F.col("better"), F.greatest(F.col("damping") * 0.2, lit(1e-7))).otherwise(F.least(F.col("damping") * 10, lit(1e4)))
        new = new.withColumns({
            "h": take("trial", "h"), "left": take("new_left", "left"), "right": take("new_right", "right"), "objective": take("now", "objective"),
            "damping": F.col("damping") if turn == 0 else eased, "initial_objective": F.col("now") if turn == 0 else F.col("initial_objective"),
        })
        slope = F.sqrt(F.aggregate("right", lit(0), lambda s, v: s + v * v))
        status = F.when(F.col("h").isNull(), "singular").when(F.col("better") & (F.col("step") < 1e-6), "converged_step").when(slope < 1e-6, "converged_gradient")
        new = new.withColumn("status", F.coalesce(status, F.when(F.lit(turn == rounds), F.when(F.col("objective") < F.col("initial_objective"), "cost_decreased").otherwise("max_rounds")), F.lit("running")))
        new = new.withColumn("move", F.when(F.col("status") == "running", damped_step8("left", "right", "damping")))
        new = new.withColumns({
            "status": F.when((F.col("status") == "running") & F.col("move").isNull(), "singular").otherwise(F.col("status")),
            "trial": F.when(F.col("move").isNotNull(), F.concat(F.zip_with(F.slice("h", 1, 8), "move", lambda h, d: h + d), F.array(lit(1)))).otherwise(F.col("h")),
            "step": F.sqrt(F.aggregate(F.coalesce("move", F.array(lit(1))), lit(0), lambda s, v: s + v * v)),
        })
        new = materialize(new.select(state.columns), "lm-state")
        over = new.filter("status <> 'running'")
        ended = over if ended is None else ended.unionByName(over)
        state = new.filter("status = 'running'")
        if state.isEmpty():
            break
    return ended.select(key, "n", "h", "objective", "initial_objective", "iterations", "status")


def _apply(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return h[0] * x + h[1] * y + h[2], h[3] * x + h[4] * y + h[5]


def adjust_network(matches: DataFrame, rounds: int = 6, huber: float = 3.0, network: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(poses (image_id, h), report) of matches (src, ref, source_x, ...): affine poses that agree on all edges of each network.

    With ``network`` that column tells networks apart, whose images have ids of
    their own; else all matches are one. The most frequent reference of a
    network stays fixed. Initial poses are composed along edges, a frontier
    join for each step away from it; then each round fits every image to its
    neighbours' poses with Huber weights and goes on a way in the direction of
    the round before (Nesterov's steps), as plain rounds pass a change on by
    one edge only. Each network keeps the poses of its own least RMSE and
    leaves the loop by itself, once a round gains less than 1e-6, so its result
    doesn't hang on the others.
    The report has a row for each network: rmse_before, rmse_after,
    improvement_pct and status, "failed" for one of fewer than 2 edges, which
    isn't adjusted. Poses, one row an image, are written after every round.
    """
    name = network or "network"
    m = materialize(matches.select((F.col(network) if network else F.lit(0)).alias(name), "src", "ref", X, Y, U, V), "network")
    edges = m.select(name, "src", "ref").distinct().groupBy(name).agg(F.count(F.lit(1)).alias("edges"))
    good = edges.filter("edges >= 2").select(name)
    if not network and good.isEmpty():
        raise ValueError("a network needs two edges")
    # Without a network column, and in a large network, all matches have one key and would meet in one task.
    sizes = m.groupBy(name).agg(F.count(F.lit(1)).alias("rows")).join(good, name)
    m = materialize(join_on_hot_keys(m, materialize(sizes, "network-sizes"), name, "rows").drop("rows"), "network")
    counted = m.groupBy(name, "ref").agg(F.count(F.lit(1)).alias("n"))
    first = counted.withColumn("k", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("n"), "ref"))).filter("k = 1")
    roots = materialize(first.select(F.col("ref").alias("image_id")), "network-roots")
    members = m.select(F.col("src").alias("image_id"), name).union(m.select("ref", name)).distinct()
    there = fit_affine(m, ["src", "ref"]).select("src", "ref", "h")
    turned = m.select(F.col("ref").alias("src"), F.col("src").alias("ref"), F.col(U).alias(X), F.col(V).alias(Y), F.col(X).alias(U), F.col(Y).alias(V))
    steps = materialize(there.unionByName(fit_affine(turned, ["src", "ref"]).select("src", "ref", "h")), "network-steps")
    poses = roots.withColumn("h", affine(*(lit(v) for v in (1, 0, 0, 0, 1, 0))))
    while True:
        known = poses.select(F.col("image_id").alias("ref"), F.col("h").alias("g"))
        new = steps.join(known, "ref").join(poses.select(F.col("image_id").alias("src")), "src", "left_anti")
        g, h = F.col("g"), F.col("h")
        rows = [g[3 * i] * h[j] + g[3 * i + 1] * h[3 + j] + (g[3 * i + 2] if j == 2 else lit(0)) for i in range(2) for j in range(3)]
        new = materialize(new.groupBy("src").agg(F.min_by(affine(*rows), "ref").alias("h")).select(F.col("src").alias("image_id"), "h"), "network-frontier")
        if new.isEmpty():
            break
        poses = materialize(poses.union(new), "network-poses")

    ends = materialize(m.select(name, "src", "ref").distinct(), "network-edges")

    def summed(poses: DataFrame) -> DataFrame:
        """For each edge its squared errors under the poses, and what its matches add to the fits of both images; matches are shuffled once."""
        a = poses.select(F.col("image_id").alias("src"), F.col("h").alias("hs"))
        b = poses.select(F.col("image_id").alias("ref"), F.col("h").alias("hr"))
        both = m.join(ends.join(a, "src").join(b, "ref"), [name, "src", "ref"])
        (px, py), (qx, qy) = _apply(F.col("hs"), F.col(X), F.col(Y)), _apply(F.col("hr"), F.col(U), F.col(V))
        both = both.select(name, "src", "ref", X, Y, U, V, px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"))
        both = both.withColumn("e", F.sqrt(F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2)))
        half = lambda p, q: (F.col(p) + F.col(q)) / 2
        both = both.withColumns({"w": F.least(lit(1), huber / F.greatest("e", lit(1e-9))), "mx": half("px", "qx"), "my": half("py", "qy")})
        added = [F.sum(c).alias(side + n) for side, x, y in (("s_", X, Y), ("r_", U, V)) for n, c in zip(MOMENTS, moment_columns(F.col("w"), x, y, "mx", "my"), strict=True)]
        return materialize(both.groupBy(name, "src", "ref").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("ee"), *added), "network-sums")

    rmse = lambda sums: sums.groupBy(name).agg(F.sqrt(F.sum("ee") / F.sum("n")).alias("rmse"))
    poses = materialize(poses.join(members, "image_id").withColumn("fitted", F.col("h")), "network-poses")
    sums = summed(poses)
    state = materialize(rmse(sums).select(name, F.col("rmse").alias("rmse_before"), F.col("rmse").alias("best"), F.lit(0).alias("at"), F.lit(True).alias("running")), "network-state")
    tried, t = [poses], 1.0
    for k in range(1, rounds + 1):
        active = state.filter("running").select(name)
        if active.isEmpty():
            break
        now = poses.join(active, name, "left_semi")
        sides = [sums.join(active, name, "left_semi").select(F.col(c).alias("image_id"), "n", *(F.col(k + n).alias(n) for n in MOMENTS)) for c, k in (("src", "s_"), ("ref", "r_"))]
        each = sides[0].union(sides[1]).join(roots, "image_id", "left_anti").groupBy("image_id").agg(*(F.sum(n).alias(n) for n in ("n", *MOMENTS)))
        fits = fit_sums(each, ["image_id"]).select("image_id", F.col("h").alias("new"))
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = F.zip_with("new", "fitted", lambda new, old: new + lit((before - 1) / t) * (new - old))  # noqa: B023
        poses = materialize(now.join(fits, "image_id", "left").select("image_id", name, F.coalesce(ahead, "h").alias("h"), F.coalesce("new", "h").alias("fitted")), "network-poses")
        tried.append(poses)
        sums = summed(poses)
        after = state.join(rmse(sums), name, "left").withColumn("gain", F.when(F.col("running"), F.col("best") - F.col("rmse")))
        better = F.coalesce(F.col("gain") > 0, F.lit(False))
        state = materialize(after.select(
            name, "rmse_before", F.when(better, F.col("rmse")).otherwise(F.col("best")).alias("best"), F.when(better, F.lit(k)).otherwise(F.col("at")).alias("at"),
            (F.col("running") & ~F.coalesce((F.col("gain") > 0) & (F.col("gain") < 1e-6), F.lit(False))).alias("running"),
        ), "network-state")
    kept = sorted(r["at"] for r in state.select("at").distinct().collect())  # as many as rounds
    best = reduce(DataFrame.unionByName, (tried[k].join(state.filter(F.col("at") == k).select(name), name, "left_semi") for k in kept))
    best = best.select("image_id", "h")
    before, done = (state.select(name, F.col(c).alias(k)) for c, k in (("rmse_before", "rmse_before"), ("best", "rmse_after")))
    report = edges.join(before, name, "left").join(done, name, "left")
    gained = F.try_divide(100 * (F.col("rmse_before") - F.col("rmse_after")), F.col("rmse_before"))
    report = report.select(name, "edges", "rmse_before", "rmse_after", F.coalesce(gained, F.when(F.col("rmse_before") == 0, lit(0))).alias("improvement_pct"), F.when(F.col("edges") < 2, "failed").otherwise("ok").alias("status"))
    return best, report


def band_pca(cube: DataFrame, k: int, key: str = "image_id") -> DataFrame:
    """(key, component, explained, loadings): the first k principal components of each image's bands, the largest loading positive.

    Tasks sum their pixels' outer products; the sums of an image, as many as
    bands squared, are added up by Spark and decomposed one image at a time.
    """
    import pyarrow as pa

    def sums(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            data = np.stack([np.asarray(x.as_py(), float) for x in lists]) if len(ids) else np.zeros((0, 1))
            for one in np.unique(ids):
                d = data[ids == one]
                flat = np.concatenate(([len(d)], d.sum(0), (d.T @ d).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), one)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["key", "i", "v"])

    kind = cube.schema[key].dataType.simpleString()
    total = cube.select(key, "bands").mapInArrow(sums, f"key {kind}, i int, v double").groupBy("key", "i").agg(F.sum("v").alias("v"))

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = pdf.sort_values("i")["v"].to_numpy()
        bands = int(round((np.sqrt(1 + 4 * (len(flat) - 1)) - 1) / 2))
        n, mean = flat[0], flat[1 : 1 + bands] / flat[0]
        cov = flat[1 + bands :].reshape(bands, bands) / n - np.outer(mean, mean)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[:k]
        out = []
        for c, o in enumerate(order):
            v = vectors[:, o] * np.sign(vectors[np.argmax(np.abs(vectors[:, o])), o])
            out.append((pdf["key"].iloc[0], c, float(values[o] / max(values.sum(), 1e-300)), list(v)))
        return pd.DataFrame(out, columns=[key, "component", "explained", "loadings"])

    return total.groupBy("key").applyInPandas(decompose, f"{key} {kind}, component int, explained double, loadings array<double>")


def gls_objective(matches: DataFrame, transforms: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, objective): mean squared whitened distance."""
    return whiten(matches, transforms, key).groupBy(key).agg(F.avg(F.col("distance") * F.col("distance")).alias("objective"))


__all__ = ["adjust_network", "band_pca", "fit_homography", "gls_objective", "project", "refine_gls", "refine_homography"]
