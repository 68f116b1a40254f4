"""Neighbour searches against brute force, with rows that lack coordinates, repeated rows and far points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.config import Relations
from orbweave.operators import points as P
from orbweave.operators import relations as R

SCHEMA = "scene string, obj string, pid bigint, x double, y double, z double"
NONE = [("s", "a", 900, None, 1.0, 1.0), ("s", "b", 901, 1.0, float("nan"), 1.0), ("s", "b", 902, float("inf"), 0.0, 0.0)]


def cloud(seed, n=120, flat=False, whole=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        p = rng.integers(0, 8, 3).astype(float) if whole else rng.random(3) * 6
        rows.append((rng.choice(["s", "t"]), rng.choice(["a", "b", "c"]), i, float(p[0]), float(p[1]), 0.0 if flat else float(p[2])))
    return rows


def d2(p, q):
    return sum((p[k] - q[k]) ** 2 for k in (3, 4, 5))


@pytest.mark.parametrize("kind", [{}, {"flat": True}, {"whole": True}])
def test_nearest(spark, kind):
    left, right = cloud(1, **kind), [(s, o, i + 500, *p) for s, o, i, *p in cloud(2, 40, **kind)] + [("s", "b", 5000, 400.0, -300.0, 0.0)]
    left += [("s", "a", 950, 1000.0, 1000.0, 1000.0), ("lone", "a", 951, 0.0, 0.0, 0.0)]
    dl, dr = spark.createDataFrame(left * 2 + NONE, SCHEMA), spark.createDataFrame(right + right[:5] + NONE, SCHEMA).withColumnRenamed("pid", "q")
    for on in ([], ["scene"]):
        want = {}
        for p in left:
            best = min(((d2(p, q), q[2]) for q in right if not on or q[0] == p[0]), default=None)
            if best:
                want[p[2]] = best
        got = P.nearest(dl, dr, "pid", "q", 0.1, on).collect()
        assert len(got) == len(want)
        for r in got:
            assert r.q == want[r.pid][1] and abs(r.d2 - want[r.pid][0]) < 1e-9
    assert P.nearest(dl.limit(0), dr, "pid", "q", 0.1).isEmpty() and P.nearest(dl, dr.limit(0), "pid", "q", 0.1).isEmpty()
    assert P.nearest(dl.filter("pid = 900"), dr, "pid", "q", 0.1).isEmpty()


def test_spacing(spark):
    rows = cloud(3) + [("s", "one", 800, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows + rows[:30] + NONE + [("s", "same", 810 + i, 2.0, 2.0, 2.0) for i in range(3)], SCHEMA)
    want = {}
    for s, o in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == (s, o)]
        near = [min(d2(p, q) for q in own if q is not p) for p in own if len(own) > 1]
        if near:
            want[s, o] = np.median(np.sqrt([v for v in near if v > 0]))
    got = {(r.scene, r.obj): r.spacing for r in P.spacing(d, "obj", "pid", 0.01, ["scene"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("whole", [False, True])
def test_overlap_ratios(spark, whole):
    rows = cloud(4, 150, whole=whole)
    d = spark.createDataFrame(rows + NONE, SCHEMA)
    want = {}
    for s in "st":
        for a in "abc":
            own = [r for r in rows if r[:2] == (s, a)]
            for b in "abc":
                n = sum(any(d2(p, q) < 1.0 for q in rows if q[:2] == (s, b)) for p in own)
                if a != b and n:
                    want[s, a, b] = n / len(own)
    for df in (d, d.unionByName(d)):  # repeated rows count on both sides
        got = {(r.scene, r.a, r.b): r.ratio for r in P.overlap_ratios(df, "obj", "pid", 1.0, ["scene"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_near_3d_of_uneven_objects(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in "st":
        for o, n, wide in (("a", 60, 1.0), ("b", 60, 1.0), ("c", 12, 30.0), ("d", 1, 1.0)):
            rows += [(s, o, i, *(rng.random(3) * wide + (0.5 if o == "b" else 0)).tolist()) for i in range(n)]
    d = spark.createDataFrame(rows + NONE, SCHEMA)
    gaps = {(r.scene, r.obj): 2.5 * r.spacing for r in P.spacing(d, "obj", "pid", 0.05, ["scene"]).collect()}
    want = {}
    for s in "st":
        for a in "abcd":
            for b in "abcd":
                if a < b and (radius := max(gaps.get((s, a), 0), gaps.get((s, b), 0))):
                    share = [sum(any(d2(p, q) <= radius**2 for q in rows if q[:2] == (s, y)) for p in rows if p[:2] == (s, x)) / sum(p[:2] == (s, x) for p in rows) for x, y in ((a, b), (b, a))]
                    if any(share):
                        want[s, a, b] = share
    got = {(r.scene, r.a, r.b): r for r in R.near_3d(d, "obj", "pid", 0.05, Relations(), ["scene"]).collect()}
    assert got.keys() == want.keys() and len(want) > 4
    for k, (ab, ba) in want.items():
        assert abs(got[k].a_to_b - ab) < 1e-9 and abs(got[k].b_to_a - ba) < 1e-9 and got[k].candidate == (max(ab, ba) >= Relations().min_fraction)
    assert R.near_3d(d.filter("obj = 'd'"), "obj", "pid", 0.05).isEmpty()


def test_only_counts_leave_a_block(spark):
    d = spark.createDataFrame(cloud(6), SCHEMA)
    plan = P.overlap_ratios(d, "obj", "pid", 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("explode") == 3
    assert P.touching(d, d, "obj", 1.0).agg(F.sum("n")).first()[0] <= 120 * 3
