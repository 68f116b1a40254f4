"""Point clouds: voxels, neighbour joins on grids, overlap ratios, nearest neighbours, density clusters.

Where the pairs themselves are the result, points are put in cells as wide as the radius and a cell is joined with its 27
neighbours. Where only a count or a nearest point is wanted, points are grouped in blocks with a rim and the pairs are never made rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checked, materialize
from . import blocks

AXES = ("x", "y", "z")


def cell(size: float | Column) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long").alias(f"_c{a}") for a in AXES]


def voxel_downsample(points: DataFrame, keys: list[str], size: float, extra: tuple[str, ...] = (), anchor: str = "scene") -> DataFrame:
    """Mean position (and mean of ``extra``) of each voxel. ``anchor``: 'scene' puts the grid at the origin,
    so voxels stay as data grows; 'object' puts it half a voxel below each key's least corner."""
    if anchor == "object":
        w = W.partitionBy(*keys)
        v = [F.floor((F.col(a) - F.min(a).over(w) + size / 2) / size).alias(f"_c{a}") for a in AXES]
        points = points.select("*", *v)
    else:
        points = points.select("*", *cell(size))
    return points.groupBy(*keys, *(f"_c{a}" for a in AXES)).agg(*(F.avg(a).alias(a) for a in (*AXES, *extra)), F.count("*").alias("n")).drop(*(f"_c{a}" for a in AXES))


def aabb(points: DataFrame, keys: list[str]) -> DataFrame:
    """Axis-aligned box of each key's points, flat sides widened by a millionth of the largest coordinate."""
    out = points.groupBy(*keys).agg(
        *(F.min(a).alias(f"min_{a}") for a in AXES), *(F.max(a).alias(f"max_{a}") for a in AXES),
        F.greatest(*(F.max(F.abs(a)) for a in AXES), F.lit(1.0)).alias("_s"), F.count("*").alias("n_points"),
    )
    pad = F.col("_s") * 1e-6
    new = {}
    for a in AXES:
        flat = F.col(f"max_{a}") <= F.col(f"min_{a}")
        new[f"min_{a}"] = F.when(flat, F.col(f"min_{a}") - pad).otherwise(F.col(f"min_{a}"))
        new[f"max_{a}"] = F.when(flat, F.col(f"max_{a}") + pad).otherwise(F.col(f"max_{a}"))
    return out.withColumns(new).drop("_s")


def scene_diagonal(points: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Length of the diagonal of all points; 1 if degenerate."""
    d = [F.max(a) - F.min(a) for a in AXES]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return points.groupBy(*keys).agg(F.coalesce(F.when(n > 0, n), F.lit(1.0)).alias("diagonal"))


def _around(df: DataFrame, size: float | Column) -> DataFrame:
    """Each row under the 27 cells about its own."""
    near = F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for v, a in zip(d, AXES))) for d in itertools.product((-1, 0, 1), repeat=3)))
    d = df.select("*", *cell(size)).withColumn("_d", F.explode(near))
    return d.select(*df.columns, *((F.col(f"_c{a}") + F.col(f"_d.d{a}")).alias(f"_c{a}") for a in AXES))


def squared_distance(a: str = "a", b: str = "b") -> Column:
    return sum(((F.col(f"{a}.{x}") - F.col(f"{b}.{x}")) * (F.col(f"{a}.{x}") - F.col(f"{b}.{x}")) for x in AXES[1:]), (F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x")))


def pairs_within(left: DataFrame, right: DataFrame, radius: float, on: list[str] = [], strict: bool = False) -> DataFrame:  # noqa: B006
    """All pairs (a: left row, b: right row, d2) with one ``on`` key at most ``radius`` apart. Exact."""
    cells = [f"_c{a}" for a in AXES]
    l = left.select(F.struct(*left.columns).alias("a"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(on)), *cell(radius))  # noqa: E741
    around = _around(right, radius)
    r = around.select(F.struct(*right.columns).alias("b"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(on)), *cells)
    d2 = squared_distance()
    near = d2 < radius * radius if strict else d2 <= radius * radius
    return l.join(r, [*(f"_k{i}" for i in range(len(on))), *cells]).filter(near).select("a", "b", d2.alias("d2"))


def _finite(df: DataFrame) -> DataFrame:
    """Rows whose three coordinates are numbers."""
    ok = F.lit(True)
    for a in AXES:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(a) < float("inf"))
    return df.filter(ok)


def _in_blocks(left: DataFrame, right: DataFrame, on: list[str], size: float, columns: list[Column], edge: float = 0.0):
    """Rows of both sides (``_side`` 0 and 1) grouped by block: a left row lies in one block of ``edge``, four ``size`` at least, a right one in
    each block that it is within ``size`` of (3.4 on average at most, where a join over cells would send 27). ``columns`` are taken of both."""
    edge = max(edge, 4.0 * size)
    at = [F.floor(F.col(a) / edge).cast("long").alias(f"_b{a}") for a in AXES]
    xyz = [F.col(a).cast("double").alias(a) for a in AXES]
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]
    l = left.select(*keys, F.lit(0).alias("_side"), *xyz, *columns, *at)  # noqa: E741
    r = right.select(*keys, F.lit(1).alias("_side"), *xyz, *columns)
    for a in AXES:
        r = r.select("*", F.explode(F.sequence(F.floor((F.col(a) - size) / edge).cast("long"), F.floor((F.col(a) + size) / edge).cast("long"))).alias(f"_b{a}"))
    return l.unionByName(r).groupBy(*(f"_k{i}" for i in range(len(on))), *(f"_b{a}" for a in AXES))


def _cells(t: pa.Table, size: float):
    """Of one block: for each cell of width ``size`` with left rows (left rows, right rows of the 27 cells about it)."""
    side = t["_side"].to_numpy()
    xyz = np.stack([t[a].to_numpy() for a in AXES], 1)
    cell = np.floor(xyz / size).astype(np.int64)
    cell -= cell.min(0) - 1
    wide = cell.max(0) + 2
    key = (cell[:, 0] * wide[1] + cell[:, 1]) * wide[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    l, r = order[side[order] == 0], order[side[order] == 1]  # noqa: E741
    if not len(l) or not len(r):
        return
    head = np.flatnonzero(np.diff(key[l], prepend=-1))
    steps = [(x * wide[1] + y) * wide[2] for x in (-1, 0, 1) for y in (-1, 0, 1)]
    right = key[r]
    for a, b in zip(head, [*head[1:], len(l)]):
        k = key[l[a]]
        # Three neighbours in z are next to each other.
        lo, hi = np.searchsorted(right, [k + s - 1 for s in steps], "left"), np.searchsorted(right, [k + s + 1 for s in steps], "right")
        near = np.concatenate([r[x:y] for x, y in zip(lo, hi)])
        if len(near):
            yield l[a:b], near, xyz


#: About how many points a block of a search for the nearest gets, at the cloud's average density.
BLOCK_POINTS = 1 << 13
#: Distances that are held at a time.
STEP = 1 << 21


def _touching(low: float, size: float, strict: bool):
    """(a, b, n): how many left rows of object a have a right row of object b within the larger reach of the two, where that is over ``low``."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        coded = pc.dictionary_encode(t["_o"].combine_chunks())
        obj, names = coded.indices.to_numpy(), coded.dictionary
        reach = t["_g"].to_numpy()
        found: list[tuple] = []
        # A block of not too many objects sums its cells in one matrix.
        table = np.zeros((len(names), len(names))) if len(names) ** 2 <= STEP else None
        for l, r, xyz in _cells(t, size):  # noqa: E741
            # Rows at one place and of one reach have the same neighbours.
            spot, place = np.unique(np.column_stack([xyz[l], reach[l]]), axis=0, return_inverse=True)
            own, mine = np.unique(obj[l], return_inverse=True)
            count = np.zeros((len(spot), len(own)))
            np.add.at(count, (place.ravel(), mine), 1)
            r = r[np.argsort(obj[r], kind="stable")]
            head = np.flatnonzero(np.diff(obj[r], prepend=-1))
            step = max(1, STEP // len(r))
            total = np.zeros((len(own), len(head)))
            for i in range(0, len(spot), step):
                p = spot[i : i + step]
                d2 = sum((p[:, None, k] - xyz[r, k]) ** 2 for k in range(3))
                g = np.maximum(p[:, None, 3], reach[r])
                hit = (d2 < g * g if strict else d2 <= g * g) & (g > low)
                total += count[i : i + step].T @ np.logical_or.reduceat(hit, head, axis=1).astype(float)
            if table is not None:
                table[np.ix_(own, obj[r[head]])] += total
                continue
            x, y = np.nonzero(total)
            found.append((own[x], obj[r[head]][y], total[x, y].astype(np.int64)))
        if table is not None:
            x, y = np.nonzero(table)
            found.append((x, y, table[x, y].astype(np.int64)))
        a, b, n = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        pair, which = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
        n = np.bincount(which.ravel(), n, pair.shape[1]).astype(np.int64)
        keys = [pa.array([k.as_py()] * len(n), k.type) for k in key[:-3]]
        return pa.Table.from_arrays([*keys, names.take(pa.array(pair[0])), names.take(pa.array(pair[1])), pa.array(n)], names=[*(f"_k{i}" for i in range(len(keys))), "a", "b", "_m"])

    return run


def touching(left: DataFrame, right: DataFrame, obj: str, size: float, on: list[str] = [], reach: str | None = None, low: float = -1.0, strict: bool = False) -> DataFrame:  # noqa: B006
    """(on, a, b, n): rows of left object a that have a row of right object b within ``size``, or, with a column ``reach`` (at most ``size``), within the larger
    of both rows' reach if that is over ``low``. Objects of both sides have one type. Rows without coordinates count nowhere. Only counts leave a block."""
    left, right, edge, names = _finite(left), _finite(right), 0.0, list(on)
    span = F.greatest(*(F.max(a) - F.min(a) for a in AXES)).cast("double")
    n, wide = left.groupBy(*on, obj).agg(span.alias("_w")).agg(F.count("*"), F.avg("_w")).first()
    if n * n > STEP:
        # Many objects: each two groups of them meet in blocks that hold most objects whole, so that a pair leaves few blocks and a task holds few pairs.
        groups, edge = max(6, -(-2 * n // int(STEP**0.5))), 4 * wide
        own, every = F.pmod(F.xxhash64(obj), F.lit(groups)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        left, right = left.select("*", own.alias("_gi"), every.alias("_gj")), right.select("*", every.alias("_gi"), own.alias("_gj"))
        names += ["_gi", "_gj"]
    kind = {f.name: f.dataType.simpleString() for f in left.schema}
    columns = [F.col(obj).alias("_o"), (F.col(reach).cast("double") if reach else F.lit(float(size))).alias("_g")]
    schema = ", ".join([*(f"_k{i} {kind[k]}" for i, k in enumerate(names)), f"a {kind[obj]}, b {kind[obj]}, _m bigint"])
    parts = _in_blocks(left, right, names, size, columns, edge).applyInArrow(_touching(low, size, strict), schema)
    return parts.groupBy(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(on)), "a", "b").agg(F.sum("_m").alias("n"))


def overlap_ratios(points: DataFrame, obj: str, point: str, voxel: float, on: list[str] = [], other: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """(on, a, b, ratio): share of a's points with a point of b nearer than ``voxel``; directed, pairs that touch only.
    Points are rows: repeated ones count as often, on both sides of the share; those without coordinates don't count."""
    n = _finite(points).groupBy(*on, F.col(obj).alias("a")).agg(F.count("*").alias("_n"))
    near = touching(points, points if other is None else other, obj, voxel, on, strict=True)
    if other is None:
        near = near.filter("a <> b")
    return near.join(n, [*on, "a"]).select(*on, "a", "b", (F.col("n") / F.col("_n")).alias("ratio"))


def _closest(size: float, other: bool):
    """(left id, right id, d2) of left rows whose nearest right row is within ``size``; of equals the least id. ``other``: not the row's own id."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        coded = pc.dictionary_encode(t["_i"].combine_chunks())
        names = coded.dictionary
        rank = np.empty(len(names), np.int64)  # of ids in their order
        rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        code = coded.indices.to_numpy()
        ids = rank[code]
        rows, best, dist = [], [], []
        for l, r, xyz in _cells(t, size):  # noqa: E741
            r = r[np.argsort(ids[r], kind="stable")]
            if other:
                spot, place = xyz[l], np.arange(len(l))
            else:
                spot, place = np.unique(xyz[l], axis=0, return_inverse=True)
            step = max(1, STEP // len(r))
            for i in range(0, len(spot), step):
                d2 = sum((spot[i : i + step, None, k] - xyz[r, k]) ** 2 for k in range(3))
                if other:
                    d2[ids[l[i : i + step], None] == ids[r]] = np.inf
                at = d2.argmin(1)
                m = d2[np.arange(len(at)), at]
                own = np.flatnonzero((place.ravel() >= i) & (place.ravel() < i + step))
                p = place.ravel()[own] - i
                ok = m[p] <= size * size
                rows.append(l[own[ok]])
                best.append(r[at[p[ok]]])
                dist.append(m[p[ok]])
        rows, best, dist = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, best, dist))
        keys = [pa.array([k.as_py()] * len(rows), k.type) for k in key[:-3]]
        return pa.Table.from_arrays([*keys, names.take(pa.array(code[rows])), names.take(pa.array(code[best])), pa.array(dist, pa.float64())], names=[*(f"_k{i}" for i in range(len(keys))), "l", "r", "d2"])

    return run


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, start: float, on: list[str] = [], other: bool = False) -> DataFrame:  # noqa: B006
    """(on, left_id, right_id, d2): each left point's nearest right point of its ``on`` keys, the smaller id of equals; with ``other`` not the point of its own id. Exact.

    A point whose nearest neighbour within the 27 cells is no further than the cell width is settled; the rest goes on
    with cells twice as wide. The first width is that of a cell with about one right point, at least ``start``; the last one spans the
    cloud, so the rounds end whatever is left. Points without coordinates, or without any right point to go to, have no row; repeated left points have one.
    Ids of both sides have one type.
    """
    left, right = _finite(left), _finite(right)
    if on:  # points whose key has no right point at all have no neighbour
        left = left.join(right.select(*on).distinct(), on, "left_semi")
    l, r = left.select(*on, F.col(left_id).alias("_i"), *AXES), right.select(*on, F.col(right_id).alias("_i"), *AXES)  # noqa: E741
    box = l.select(*AXES).unionByName(r.select(*AXES)).agg(*(f(a).cast("double").alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    count = r.agg(F.count("*"), F.count_distinct(*on) if on else F.lit(1)).first()
    wide = [] if box.lox is None else [box[f"hi{a}"] - box[f"lo{a}"] for a in AXES if box[f"hi{a}"] > box[f"lo{a}"]]
    size, edge = float(start), 0.0
    if wide and count[0]:
        one = float(np.prod(wide) * max(1, count[1]) / count[0]) ** (1 / len(wide))
        size, edge = max(size, one), one * BLOCK_POINTS ** (1 / len(wide))
    kind = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = ", ".join([*(f"_k{i} {kind[k]}" for i, k in enumerate(on)), f"l {kind[left_id]}, r {dict((f.name, f.dataType.simpleString()) for f in right.schema)[right_id]}, d2 double"])
    keys = [*on, left_id]
    last = 2 * sum(w * w for w in wide) ** 0.5 if wide else 0.0
    todo, done = l, []
    while True:
        parts = _in_blocks(todo, r, on, size, [F.col("_i")], edge).applyInArrow(_closest(size, other), schema)
        named = parts.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(on)), F.col("l").alias(left_id), F.col("r").alias(right_id), "d2")
        best = named.groupBy(*keys).agg(F.min(F.struct("d2", right_id)).alias("_m")).select(*keys, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.d2").alias("d2"))
        done.append(materialize(best, "nearest"))
        if size >= last:
            break
        todo = materialize(todo.join(done[-1].withColumnRenamed(left_id, "_i").select(*on, "_i"), [*on, "_i"], "left_anti"), "nearest-open")
        if todo.isEmpty():
            break
        size *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def nearest_by_place(left: DataFrame, right: DataFrame, left_id: str, right_id: str, start: float, on: list[str] = []) -> DataFrame:  # noqa: B006
    """As :func:`nearest`, for clouds with many points at one place: places are searched, with the least right id of each, and the left points told apart
    afterwards, so a task holds places, not points."""
    xyz = [(F.col(a).cast("double") + 0.0).alias(a) for a in AXES]
    kind = dict(right.dtypes)[right_id]
    wide = "bigint" if kind in ("tinyint", "smallint", "int") else kind  # of both sides' ids: places are numbered
    left, right = _finite(left).select(*on, left_id, *xyz), _finite(right).select(*on, F.col(right_id).cast(wide).alias(right_id), *xyz)
    if on:
        left = left.dropna(subset=on)
    place = materialize(left.select(*on, *AXES).distinct().withColumn("_p", F.monotonically_increasing_id().cast(wide)), "places")
    spots = right.groupBy(*on, *AXES).agg(F.min(right_id).alias("_r"))
    found = place.join(nearest(place, spots, "_p", "_r", start, on).drop(*on), "_p").select(*on, *AXES, F.col("_r").cast(kind).alias(right_id), "d2")
    best = left.join(found, [*on, *AXES]).groupBy(*on, left_id).agg(F.min(F.struct("d2", right_id)).alias("_m"))
    return best.select(*on, left_id, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.d2").alias("d2"))


#: Most points of an object whose distances are all taken, many objects in a call.
WHOLE = 4096


def _gaps(keys: int):
    """(keys, median distance) of objects whose rows are sorted by their point's id."""

    def run(t: pa.Table, head: np.ndarray) -> pa.Table:
        xyz = np.stack(blocks.numbers(t, AXES), 1)
        point = blocks.heads(t, keys + 1)
        got, out = [], []
        for i, (a, b) in enumerate(zip(head, [*head[1:], t.num_rows])):
            first = point[np.searchsorted(point, a) : np.searchsorted(point, b)] - a
            if len(first) < 2:
                continue
            p = xyz[a:b]
            ident = np.repeat(np.arange(len(first)), np.diff(np.append(first, b - a)))
            best = np.empty(b - a)
            for s in range(0, b - a, max(1, (STEP >> 3) // (b - a))):
                e = s + max(1, (STEP >> 3) // (b - a))
                d2 = (p[s:e, None, 0] - p[:, 0]) ** 2
                d2 += (p[s:e, None, 1] - p[:, 1]) ** 2
                d2 += (p[s:e, None, 2] - p[:, 2]) ** 2
                if len(first) == b - a:
                    d2[np.arange(len(d2)), np.arange(s, s + len(d2))] = np.inf
                else:
                    d2[ident[s:e, None] == ident] = np.inf
                best[s:e] = d2.min(1)
            m = np.minimum.reduceat(best, first)
            m = m[m > 0]
            if len(m):
                got.append(a)
                out.append(float(np.median(np.sqrt(m))))
        rows = t.select(list(range(keys))).take(pa.array(got, pa.int64()))
        return rows.append_column("spacing", pa.array(out, pa.float64()))

    return run


def spacing(points: DataFrame, obj: str, point: str, start: float, on: list[str] = []) -> DataFrame:  # noqa: B006
    """(on, obj, spacing): median distance to the nearest other point of the object, zero distances left out. A point that is repeated counts
    once and is not another point; objects of a single one have no row.

    Objects of up to ``WHOLE`` points are done many at once in a sorted stream; larger ones are searched in blocks."""
    keys = [*on, obj]
    p = _finite(points).dropna(subset=keys).select(*keys, point, *AXES)
    size = materialize(p.groupBy(*keys).agg((F.count("*") > WHOLE).alias("_big")), "sizes")
    big = checked(size.filter("_big").select(*keys))
    kind = {f.name: f.dataType.simpleString() for f in p.schema}
    schema = ", ".join([*(f"{k} {kind[k]}" for k in keys), "spacing double"])
    out = blocks.by_key(p.join(big, keys, "left_anti"), keys, [point], _gaps(len(keys)), schema)
    if size.filter("_big").isEmpty():
        return out
    some = p.join(big, keys, "left_semi")
    near = nearest(some, some.withColumnRenamed(point, "_other"), point, "_other", start, keys, other=True)
    return out.unionByName(near.filter("d2 > 0").groupBy(*keys).agg(F.median(F.sqrt("d2")).alias("spacing")))


def even_sample(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows per key, evenly spaced in ``order``: positions floor(i * (n - 1) / (most - 1))."""
    w = W.partitionBy(*keys)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # Row i is taken iff floor(k * step) = i for a k about i / step.
    step = (F.col("_n") - 1) / F.lit(float(max(1, most - 1)))
    k = F.ceil(F.col("_i") / step)
    taken = F.lit(False)
    for j in (-1, 0, 1):
        taken = taken | ((k + j >= 0) & (k + j <= most - 1) & (F.floor((k + j) * step) == F.col("_i")))
    keep = (F.col("_n") <= most) | taken
    return d.filter(keep).drop("_i", "_n")


def dbscan_labels(xyz: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Cluster of each point, -1 for noise. Cells of width eps; clusters are numbered by their first point."""
    n = len(xyz)
    cells: dict[tuple[int, int, int], list[int]] = {}
    key = np.floor(xyz / eps).astype(np.int64)
    for i, k in enumerate(map(tuple, key.tolist())):
        cells.setdefault(k, []).append(i)
    offsets = list(itertools.product((-1, 0, 1), repeat=3))

    def around(i: int) -> np.ndarray:
        c = key[i]
        near = np.array([j for o in offsets for j in cells.get((int(c[0] + o[0]), int(c[1] + o[1]), int(c[2] + o[2])), ())])
        return near[((xyz[near] - xyz[i]) ** 2).sum(1) <= eps * eps]

    label, next_label = np.full(n, -1), 0
    core = {}
    for i in range(n):
        if label[i] >= 0:
            continue
        near = core[i] if i in core else around(i)
        if len(near) < min_points:
            core[i] = near
            continue
        stack = [i]
        label[i] = next_label
        while stack:
            j = stack.pop()
            reach = around(j)
            if len(reach) >= min_points:
                new = reach[label[reach] < 0]
                label[new] = next_label
                stack += new.tolist()
        next_label += 1
    return label


def keep_largest_cluster(points: DataFrame, keys: list[str], order: str, eps: float, min_points: int, least: int = 5) -> DataFrame:
    """Each key's points in its largest density cluster; all of them if that has fewer than ``least`` or there is none."""

    rest = [c for c in points.columns if c not in keys]

    def largest(t: pa.Table, head: np.ndarray) -> pa.Table:
        label, obj = _labels(t, head, eps, min_points), np.repeat(np.arange(len(head)), np.diff(np.append(head, t.num_rows)))
        some = label >= 0
        n = np.bincount(label[some], minlength=t.num_rows)
        # Of each key the first of the largest clusters; a cluster is numbered by its first core.
        root = np.flatnonzero(n)
        root = root[np.lexsort((root, -n[root], obj[root]))]
        root = root[np.flatnonzero(np.diff(obj[root], prepend=-1))]
        best = np.full(len(head), -2)
        best[obj[root]] = np.where(n[root] >= least, root, -2)
        return t.filter(pa.array((best[obj] < 0) | (label == best[obj])))

    d = points.select(*keys, *rest)
    return blocks.by_key(d, keys, [order], largest, d.schema).select(*points.columns)


def _labels(t: pa.Table, head: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Density clusters of many keys at once: the first core of each row's cluster, -1 for noise. Other points join the first cluster of a core
    near them. Keys are taken together as long as their candidate pairs are at most ``STEP``; one key with more goes point by point."""
    xyz = np.stack(blocks.numbers(t, AXES), 1)
    label = np.full(t.num_rows, -1)
    ok = np.flatnonzero(np.isfinite(xyz).all(1))
    obj = np.repeat(np.arange(len(head)), np.diff(np.append(head, t.num_rows)))[ok]
    if not len(ok):
        return label
    cell = np.floor(xyz[ok] / eps).astype(np.int64)
    cell -= cell.min(0) - 1
    wide = [int(v) + 2 for v in cell.max(0)]
    if wide[0] * wide[1] * wide[2] * (int(obj[-1]) + 1) >= 1 << 62:  # keys too far apart to share numbers
        if obj[0] == obj[-1]:
            label[ok] = _first_core(dbscan_labels(xyz[ok], eps, min_points), xyz[ok], eps, min_points, ok)
            return label
        for h, e in zip(head, [*head[1:], t.num_rows]):
            one = _labels(t.slice(h, e - h), np.zeros(1, np.int64), eps, min_points)
            label[h:e] = np.where(one >= 0, one + h, -1)
        return label
    key = ((obj * wide[0] + cell[:, 0]) * wide[1] + cell[:, 1]) * wide[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    held = key[order]
    steps = [(x * wide[1] + y) * wide[2] for x in (-1, 0, 1) for y in (-1, 0, 1)]
    lo = np.stack([np.searchsorted(held, key + s - 1) for s in steps], 1)
    hi = np.stack([np.searchsorted(held, key + s + 1, "right") for s in steps], 1)
    each = np.bincount(obj, (hi - lo).sum(1), minlength=len(head)).astype(np.int64)
    edge = np.searchsorted(obj, np.arange(len(head) + 1))
    i = 0
    while i < len(head):
        j = i + 1
        total = each[i]
        while j < len(head) and total + each[j] <= STEP:
            total += each[j]
            j += 1
        r = np.arange(edge[i], edge[j])
        if total > 8 * STEP:
            label[ok[r]] = _first_core(dbscan_labels(xyz[ok[r]], eps, min_points), xyz[ok[r]], eps, min_points, ok[r])
        elif len(r):
            n = (hi[r] - lo[r]).ravel()
            a = np.repeat(np.repeat(r, len(steps)), n)
            b = order[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[r].ravel(), n)]
            near = ((xyz[ok[b]] - xyz[ok[a]]) ** 2).sum(1) <= eps * eps
            a, b = a[near] - edge[i], b[near] - edge[i]
            core = np.bincount(a, minlength=len(r)) >= min_points
            link = core[a] & core[b] & (a < b)
            first = np.where(core, blocks.least_label(len(r), a[link], b[link]), len(r))
            rim = ~core[a] & core[b]
            np.minimum.at(first, a[rim], first[b[rim]])
            got = first < len(r)
            label[ok[r[got]]] = ok[r[first[got]]]
        i = j
    return label


def _first_core(label: np.ndarray, xyz: np.ndarray, eps: float, min_points: int, rows: np.ndarray) -> np.ndarray:
    """Labels by the row of each cluster's first core: the first of its rows with enough points near."""
    out = np.full(len(label), -1)
    for c in range(int(label.max(initial=-1)) + 1):
        own = np.flatnonzero(label == c)
        first = next(i for i in own if (((xyz - xyz[i]) ** 2).sum(1) <= eps * eps).sum() >= min_points)
        out[own] = rows[first]
    return out


def denoise(points: DataFrame, keys: list[str], order: str, voxel: float, eps: float, min_points: int) -> DataFrame:
    """Voxels, then the largest cluster; a key with fewer than 4 points left keeps its points as they were."""
    small = voxel_downsample(points, keys, voxel).withColumn(order, F.row_number().over(W.partitionBy(*keys).orderBy("x", "y", "z")))
    kept = keep_largest_cluster(small.select(*keys, order, *AXES), keys, order, eps, min_points)
    counted = kept.withColumn("_m", F.count("*").over(W.partitionBy(*keys)))
    poor = kept.groupBy(*keys).count().filter("count < 4").select(*keys)
    return counted.filter("_m >= 4").select(*keys, *AXES).unionByName(points.join(poor, keys, "left_semi").select(*keys, *AXES))
