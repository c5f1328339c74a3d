"""Every registered query with SQL gives DuckDB's rows at the smallest scale; each of the others equals a plain computation."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"
SQL = {n: q for n, q in __spark_entry__.oracle_sql().items() if not n.startswith("op")}
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(([plain(r[k]) for k in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", SQL)
def test_query_equals_duckdb(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    found = duck.execute(SQL[name])
    want = table([d[0] for d in found.description], found.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


def plain_matches(duck, where="label"):
    """{pair: (match_id, source_x, source_y, target_x, target_y)} of the matches view, by DuckDB."""
    from tiegrid.plans.views import oracle

    out = {}
    for pair, *rest in duck.execute(oracle(f"SELECT pair_id, match_id, source_x, source_y, target_x, target_y FROM {{v_matches}} WHERE {where} ORDER BY 1, 2")).fetchall():
        out.setdefault(pair, []).append(rest)
    return {k: np.array(v) for k, v in out.items()}


def lstsq(m):
    a = np.c_[m[:, 1:3], np.ones(len(m))]
    return np.array([np.linalg.lstsq(a, m[:, c], rcond=None)[0] for c in (3, 4)])


def residuals(h, m):
    p = np.c_[m[:, 1:3], np.ones(len(m))] @ h.T
    return np.hypot(*(p[:, :2] / (p[:, 2:] if h.shape[0] == 3 else 1) - m[:, 3:5]).T)


def run(spark, name):
    return {r[0]: r for r in __spark_entry__.queries()[name](spark, SF_DIR).collect()}


def test_fit_homography_equals_svd(spark, duck):
    """The DLT of each pair anew by a singular value decomposition; the whitened one has no larger weighted residuals than it."""
    data = plain_matches(duck)
    found = run(spark, "fit_homography")
    assert set(found) == set(data)
    for k, m in data.items():
        norm = []
        for p in (m[:, 1:3], m[:, 3:5]):
            c = p.mean(0)
            s = math.sqrt(2) / np.hypot(*(p - c).T).mean()
            norm.append(np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]]))
        (x, y), (u, v) = ((np.c_[p, np.ones(len(p))] @ t.T)[:, :2].T for p, t in zip((m[:, 1:3], m[:, 3:5]), norm, strict=True))
        o, e = np.zeros_like(x), np.ones_like(x)
        rows = np.vstack([np.c_[-x, -y, -e, o, o, o, u * x, u * y, u], np.c_[o, o, o, -x, -y, -e, v * x, v * y, v]])
        h = np.linalg.inv(norm[1]) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ norm[0]
        assert found[k]["n"] == len(m) and np.allclose([found[k][f"h{j}"] for j in range(9)], (h / h[2, 2]).ravel(), atol=2e-3)
    white = run(spark, "fit_homography_whitened")
    assert set(white) == set(found) and all(abs(white[k]["h0"] - 1.01) < 0.05 for k in white)


def test_refine_gls_and_metrics_are_consistent(spark, duck):
    data = plain_matches(duck)
    for k, r in run(spark, "refine_gls").items():
        assert r["status"] in ("converged", "max_rounds") and abs(r["a"] - lstsq(data[k])[0][0]) < 0.05 and r["objective"] > 0
    every = plain_matches(duck, "true")
    for k, r in run(spark, "canonical_metrics").items():
        e = residuals(lstsq(data[k]), data[k])
        assert r["inliers"] == len(data[k]) and r["matches"] == len(every[k]) and r["validation"] == "holdout"
        assert math.isclose(r["fit_rmse"], math.sqrt((e**2).mean()), abs_tol=1e-3) and math.isclose(r["fit_median"], np.median(e), abs_tol=1e-3)


def test_relief_strain_equals_plain_neighbours(spark, duck):
    data = plain_matches(duck)
    found = run(spark, "relief_strain")
    for k in list(data)[:3]:
        m = data[k]
        away = np.hypot(m[:, None, 1] - m[None, :, 1], m[:, None, 2] - m[None, :, 2])
        overall = residuals(lstsq(m), m)
        squares = []
        for i in range(len(m)):
            near = m[np.lexsort((m[:, 0], np.arange(len(m)) != i, away[i]))[:6]]  # itself first, then the nearest
            fits = np.linalg.det(np.cov(near[:, 1:3].T, bias=True)) > 1e-12
            squares.append((residuals(lstsq(near), m[i : i + 1])[0] if fits else overall[i]) ** 2)
        assert math.isclose(found[k]["local_rmse"], math.sqrt(np.mean(squares)), rel_tol=1e-3)
        assert math.isclose(found[k]["global_rmse"], math.sqrt((residuals(lstsq(m), m) ** 2).mean()), rel_tol=1e-4)
        assert found[k]["strained"] == (found[k]["ratio"] >= 1.35 and found[k]["global_rmse"] >= 1.2)


def test_band_pca_equals_eigh(spark, duck):
    cubes = {}
    for i, v in duck.execute("SELECT CAST(floor(vec_id / 64e0) AS BIGINT), embedding FROM embeddings").fetchall():
        cubes.setdefault(i, []).append(v)
    found = __spark_entry__.queries()["band_pca"](spark, SF_DIR).collect()
    assert len(found) == 3 * len(cubes)
    for r in found:
        values = np.sort(np.linalg.eigvalsh(np.cov(np.array(cubes[r["image_id"]], float).T, bias=True)))[::-1]
        assert math.isclose(r["explained"], values[r["component"]] / values.sum(), abs_tol=1e-4)


def test_adjust_network_keeps_its_root(spark, duck):
    """The reference with the most matches stays where it is; the network is a tree, so every image has a place."""
    data = plain_matches(duck)
    counts = {}
    for k, m in data.items():
        if k // 2:
            counts[k // 2] = counts.get(k // 2, 0) + len(m)
    root = min(counts, key=lambda r: (-counts[r], r))
    found = run(spark, "adjust_network")
    assert found[root]["c"] == found[root]["f"] == 0 and set(found) == {k for k in data if k // 2} | set(counts)
    assert all(math.isfinite(v) for r in found.values() for v in (r["c"], r["f"]))


def test_registration_jobs_recover_the_map(spark, duck):
    """Every pair of the view is one affine map and a third outliers; the budgeted, weighted consensus finds it."""
    every = plain_matches(duck, "true")
    for name in ("register_pairs", "register_tiled"):
        found = run(spark, name)
        assert set(found) == set(every)
        for r in found.values():
            assert r["status"] == "registered" and 4 <= r["inliers"] <= r["candidates"] and r["fit_rmse"] < 2 and r["near_share"] > 0.5, name


def test_verifier_beats_chance(spark):
    report = {r["domain"]: r for r in __spark_entry__.queries()["verifier"](spark, SF_DIR).collect()}
    assert {None, "same", "cross"} >= set(report) and report[None]["n"] == report[None]["tp"] + report[None]["fp"] + report[None]["fn"] + report[None]["tn"]
    assert report[None]["recall"] > 0.6


def test_diverse_triplets_equal_a_plain_fold(spark, duck):
    """The greedy choice anew in one loop over all triplets, areas by fine sampling of each box."""
    from tiegrid.operators import catalog
    from tiegrid.plans.views import view

    p = {r["product_id"]: r for r in view(spark, SF_DIR, "v_products").collect()}
    rows = sorted(catalog.build_triplets(view(spark, SF_DIR, "v_products"), 0.5).collect(), key=lambda r: (-r["fraction"], r["ohrc_id"], r["tmc_id"], r["iirs_id"]))
    clusters, want = [], set()
    for r in rows:
        b = p[r["ohrc_id"]]
        sun = 45.0 if b["sun_elevation"] is None else b["sun_elevation"]
        xs, ys = (np.linspace(b[lo], b[hi], 201)[:-1] + (b[hi] - b[lo]) / 400 for lo, hi in (("west_lon", "east_lon"), ("south_lat", "north_lat")))
        home = None
        for c in clusters:
            inside = np.zeros((200, 200), bool)
            for o in c["boxes"]:
                inside |= ((xs >= o["west_lon"]) & (xs <= o["east_lon"]))[:, None] & ((ys >= o["south_lat"]) & (ys <= o["north_lat"]))[None, :]
            if inside.mean() >= 0.8:
                home = c
                break
        if home is None:
            clusters.append({"boxes": [b], "suns": [sun]})
        elif len(home["suns"]) < 3 and any(abs(sun - s) >= 5 for s in home["suns"]):
            home["boxes"].append(b)
            home["suns"].append(sun)
        else:
            continue
        want.add((r["ohrc_id"], r["tmc_id"], r["iirs_id"]))
    kept = __spark_entry__.queries()["diverse_triplets"](spark, SF_DIR).collect()
    assert {tuple(r)[:3] for r in kept} == want
    job = __spark_entry__.queries()["build_catalog_job"](spark, SF_DIR).collect()
    assert {r["outcome"] for r in job if r["region_id"]} <= {"PASS"} and all(r["region_id"] is None for r in job if r["outcome"] == "FAIL")


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
