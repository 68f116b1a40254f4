"""Oriented boxes: many pairs at once against one at a time, and against the formula of boxes along the axes."""

import numpy as np

from orbweave.operators import obb


def _turned(rng, n):
    q = np.stack([np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(n)])
    return q * rng.uniform(0.1, 3, (n, 3))[:, :, None]


def test_many_as_one():
    rng = np.random.default_rng(4)
    n = 300
    ca, cb, xa, xb = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), _turned(rng, n), _turned(rng, n)
    xa[:9, 1], xb[4:20, 2] = 0, xb[4:20, 2] * 1e-3
    cb[20:40], xb[20:40] = ca[20:40], xa[20:40]
    got = np.stack(obb.measures_of(ca, xa, cb, xb), 1)
    want = [list(obb.measures(*r).values()) for r in zip(ca, xa, cb, xb)]
    assert np.abs(got - want).max() < 1e-9
    assert np.abs(got[20:40] - 1).max() < 1e-9  # a box with itself


def test_touching_faces():
    x = np.eye(3)[None] * [1.0, 1, 1]
    for k in (0.1, 1.0, 3.3):
        c = np.full((1, 3), k / 7)
        assert obb.measures_of(c, x * k, c + [[2 * k, 0, 0]], x * k)[0] == 0


def test_faces_in_one_plane():
    """The hull of two boxes with faces in common planes: corners inside a face's hull must not dent it."""
    ca, cb = np.array([[0.0, 0, 0]]), np.array([[2.5, 0.5, 0]])
    xa, xb = np.eye(3)[None] * [1.0, 1, 1], np.eye(3)[None] * [0.5, 2, 1]
    p = np.concatenate([obb.corners(ca[0], xa[0]), obb.corners(cb[0], xb[0])])
    from orbweave.operators.relations import hull as flat

    x, y = flat(p[:, :2]).T
    area = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2
    iou, giou, _ = obb.measures_of(ca, xa, cb, xb)
    assert iou[0] == 0 and abs(giou[0] + (2 * area - 16) / (2 * area)) < 1e-9


def test_pairs_are_spread(spark, sf):
    from orbweave.plans import catalog

    assert catalog.queries()["oriented_boxes"](spark, sf).rdd.getNumPartitions() > 1
