"""Density clusters of many keys at once, against the walk from point to point."""

import numpy as np
import pyarrow as pa
import pytest

from orbweave.operators import points as P


@pytest.mark.parametrize("step", [1 << 21, 400, 1])
def test_labels_of_many_keys(monkeypatch, step):
    monkeypatch.setattr(P, "STEP", step)  # 1: every key goes point by point
    r = np.random.default_rng(4)
    parts = [np.round(r.random((n, 3)) * w, 1) for n, w in ((1, 1), (60, 4), (200, 6), (5, 9), (150, 3))]
    head = np.cumsum([0, *map(len, parts)])[:-1]
    xyz = np.concatenate(parts)
    xyz[3] = np.nan
    parts[1][2] = np.nan
    got = P._labels(pa.table({a: xyz[:, i] for i, a in enumerate("xyz")}), head, 0.8, 5)
    for h, p in zip(head, parts):
        ok = np.isfinite(p).all(1)
        want = P.dbscan_labels(p[ok], 0.8, 5)
        one = got[h : h + len(p)]
        assert (one[~ok] == -1).all()
        # The same partition, each cluster named by its first core.
        assert (P._first_core(want, p[ok], 0.8, 5, h + np.flatnonzero(ok)) == one[ok]).all()


def test_far_keys_do_not_share_numbers():
    xyz = np.array([[0, 0, 0], [0.1, 0, 0], [1e9, 1e9, 1e9], [1e9, 1e9, 1e9 + 0.1]])
    got = P._labels(pa.table({a: xyz[:, i] for i, a in enumerate("xyz")}), np.array([0, 2]), 1.0, 2)
    assert got.tolist() == [0, 0, 2, 2]


def test_density_queries_keep_pairs_inside(spark, sf):
    from orbweave.plans import catalog

    for q in ("density_clusters", "dbscan_largest", "denoised_objects"):
        plan = catalog.queries()[q](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan, q


def test_overlaps_of_groups_of_objects(spark, monkeypatch):
    rows = [(o, i, float(x), float(y), 0.0) for o in range(12) for i, (x, y) in enumerate(np.random.default_rng(o).integers(0, 9, (15, 2)))]
    df = spark.createDataFrame(rows, "o int, i int, x double, y double, z double")
    flat = lambda: sorted(map(tuple, P.overlap_ratios(df, "o", "i", 1.5).collect()))
    want = flat()
    seen, old = [], P._in_blocks
    monkeypatch.setattr(P, "_in_blocks", lambda l, r, on, *a: seen.append(list(on)) or old(l, r, on, *a))
    monkeypatch.setattr(P, "STEP", 100)
    assert flat() == want != [] and seen == [["_gi", "_gj"]]
