"""Descriptor matches by pivots against all pairs, and the number of distances that are taken."""

import numpy as np
import pytest

from tiegrid.operators import features

NAMES = "pair_id bigint, kp_id bigint, bands array<double>"


def table(spark, groups):
    return spark.createDataFrame([(pair, k, None if v is None else [None if x is None else float(x) for x in v]) for pair, rows in groups.items() for k, v in enumerate(rows)], NAMES)


def plain(source, target, ratio):
    found = {}
    for pair, rows in source.items():
        t = np.array(target.get(pair, []), float)
        for k, v in enumerate(rows if len(t) else []):
            d = np.sqrt(((t - v) ** 2).sum(1))
            best = int(np.lexsort((np.arange(len(t)), d))[0])
            more = d[d > d[best] + 1e-6]
            second = more.min() if len(more) else None
            found[pair, k] = (best, d[best], second, bool(d[best] <= (ratio * second if second is not None else 1e-8)))
    return found


def same(found, want):
    got = {(r["pair_id"], r["kp_id"]): r for r in found.collect()}
    assert got.keys() == want.keys()
    for k, (best, d, second, kept) in want.items():
        r = got[k]
        assert r["distance"] == pytest.approx(d, abs=1e-12) and (r["second"] is None) == (second is None) and (second is None or r["second"] == pytest.approx(second))
        assert r["target_id"] == best and r["kept"] == kept


def clustered(rng, n, clusters, size, centres=None):
    centres = rng.normal(size=(clusters, size)) * 20 if centres is None else centres
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, size)) * 0.3, centres


def test_equal_to_all_pairs(spark):
    rng = np.random.default_rng(1)
    source, target = {}, {}
    for pair, (n, m, clusters) in enumerate(((40, 300, 8), (30, 100, 2), (20, 1, 1), (25, 400, 60), (10, 5, 1))):
        target[pair], centres = clustered(rng, m, clusters, 8)
        source[pair], _ = clustered(rng, n, clusters, 8, centres)
    source[5], target[5] = rng.normal(size=(30, 4)), rng.normal(size=(200, 4))
    target[6] = np.repeat(rng.normal(size=(3, 4)), 40, axis=0)  # copies: the second nearest is of another kind
    source[6] = np.r_[target[6][:2], rng.normal(size=(5, 4))]
    target[7] = np.ones((50, 4))  # no second one at all
    source[7] = np.r_[np.ones((1, 4)), np.zeros((2, 4))]
    target[8] = np.r_[target[5][:90], target[5][:90] + 3e-7]
    source[8] = source[5][:12]
    for pivots in (64, 3, 1):
        same(features.descriptor_match(table(spark, source), table(spark, target), 0.8, pivots=pivots), plain(source, target, 0.8))


def test_few_distances_on_clustered_data(spark):
    rng = np.random.default_rng(2)
    target, centres = clustered(rng, 3600, 50, 16)
    source, _ = clustered(rng, 3000, 50, 16, centres)
    first, second, blocks = features.descriptor_looks(table(spark, {1: source}), table(spark, {1: target}))
    sizes = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    taken = 60 * (3600 + 3000) + sum(sizes[r["block"]] * r["count"] for looks in (first, second) for r in looks.groupBy("block").count().collect())
    assert taken < 0.1 * 3000 * 3600 and 50 <= len(sizes) <= 60
    same(features.descriptor_match(table(spark, {1: source[:200]}), table(spark, {1: target})), plain({1: source[:200]}, {1: target}, 0.8))


def test_missing_numbers_and_sides(spark):
    source = table(spark, {1: [[0, 0], None, [None, 1], [3, 3]], 2: [[0, 0]]})
    target = table(spark, {1: [[0, 1], None, [None, 0], [3, 4]], 3: [[0, 0]]})
    assert {(r["pair_id"], r["kp_id"], r["target_id"]) for r in features.descriptor_match(source, target).collect()} == {(1, 0, 0), (1, 3, 3)}
    assert features.descriptor_match(table(spark, {}), table(spark, {})).collect() == []


def test_pairs_that_are_kept_are_few_and_exact():
    rng = np.random.default_rng(3)
    target = rng.normal(size=(400, 16))
    target[300:] = target[:100]  # copies
    target[299] = target[0] + 2e-8  # within the tolerance of the first
    target[298] = np.inf
    source = np.r_[target[:50], rng.normal(size=(50, 16)) * 1e4, [np.full(16, np.nan)]]
    ids = np.arange(400)[::-1]
    r, t, d = features.near_pairs(source, target, ids, np.full(len(source), np.inf))
    assert len(r) < 4 * len(source)
    for k, s in enumerate(source[:-1]):
        full = np.sqrt(sum((s[c] - target[:, c]) ** 2 for c in range(16)))  # term by term, as the distances are
        least = full.min()
        mine, which = d[r == k], t[r == k]
        assert mine[0] == least and ids[which[0]] == min(ids[full == least])
        assert mine[-1] == full[full > least + 1e-6].min() and mine[-1] > mine[0] + 1e-6
    assert np.isnan(d[r == len(source) - 1]).all() and len(d[r == len(source) - 1]) == 1
    assert not len(features.near_pairs(source[50:100], target, ids, np.zeros(50))[0])


def test_cells_cut_blocks_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(features, "CELL", 20)
    source, target = {1: rng.normal(size=(90, 5))}, {1: np.repeat(rng.normal(size=(70, 5)), 2, axis=0)}
    same(features.descriptor_match(table(spark, source), table(spark, target), pivots=2), plain(source, target, 0.8))
