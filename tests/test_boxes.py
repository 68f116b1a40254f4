"""Boxes against each other: equal ones are measured once, and nothing is lost or doubled when they are told apart."""

import random

import pytest
from pyspark.sql import functions as F

from orbweave.functions import boxes as B
from orbweave.operators import mapping as M
from orbweave.plans.registry import rounded


@pytest.mark.parametrize("members", [1024, 3])
def test_box_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(M, "MEMBERS", members)
    rng = random.Random(1)
    forms = [[rng.uniform(0, 5) for _ in range(3)] for _ in range(4)]
    rows = [(i, *lo, *(v + 1 + k for k, v in enumerate(lo))) for i in range(40) for lo in [rng.choice(forms)]]
    df = spark.createDataFrame(rows, ["obj", *M.BOX])
    got = M.box_pairs(df, "obj", {"iou": B.iou(B.Box("a_"), B.Box("b_"))}, left=lambda o: o % 4 == 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan
    got = sorted((r.a, r.b, round(r.iou, 9)) for r in got.collect())
    x = {r[0]: r[1:] for r in rows}

    def iou(p, q):
        i = v = w = 1.0
        for k in range(3):
            i *= max(0, min(p[k + 3], q[k + 3]) - max(p[k], q[k]))
            v, w = v * (p[k + 3] - p[k]), w * (q[k + 3] - q[k])
        return i / (v + w - i)

    assert got == [(a, b, round(iou(x[a], x[b]), 9)) for a in range(0, 40, 4) for b in range(a + 1, 40)]
    assert M.kinds(df, "obj", M.BOX).count() < len(rows)


def test_rounded_as_round(spark):
    rng = random.Random(2)
    v = [rng.uniform(-9, 9) for _ in range(2000)] + [k / 2e6 for k in range(-50, 50)] + [rng.uniform(-1, 1) * 1e15 for _ in range(50)] + [0.0, -0.0, 1.0000005, 2.5000015, 1e300, float("inf"), float("-inf"), float("nan"), None]
    v += [k + d * 1e-9 for k in (0.1234565, 7.0000005) for d in range(-5, 6)]
    x = spark.createDataFrame([(a,) for a in v], "v double")
    assert x.filter(~rounded(F.col("v")).eqNullSafe(F.round("v", 6) + 0.0)).count() == 0
