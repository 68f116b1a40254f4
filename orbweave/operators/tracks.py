"""Track identity: pair metrics over shared frames, duplicates, fragments, canonical tracks, quality.

Overlaps come in as rows (scene, a, b, frame, area_a, area_b, inter) with a < b, made by
:func:`orbweave.operators.masks.intersections` or any other measure of two masks in one frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Carve, IdentityQuality, TrackMerge
from ..storage import materialize
from . import graphs


#: Rows of whole pairs that are measured together.
STEP = 1 << 18


def _medians(row: np.ndarray, place: np.ndarray, size: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Exact medians of each row's values, several kinds at once; ``place`` numbers a row's values."""
    out = [np.zeros(len(size)) for _ in values]
    # Rows of like size are sorted as one padded matrix.
    kind = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for k in np.unique(kind):
        some = np.flatnonzero(kind == k)
        number = np.full(len(size), -1)
        number[some] = np.arange(len(some))
        at = np.flatnonzero(number[row] >= 0)
        r, c, n, i = number[row[at]], place[at], size[some], np.arange(len(some))
        for v, o in zip(values, out):
            m = np.full((len(some), int(n.max())), np.inf)
            m[r, c] = v[at]
            m.sort(1)
            o[some] = (m[i, (n - 1) // 2] + m[i, n // 2]) / 2
    return out


def _measure(t: pa.Table, cfg: TrackMerge) -> pa.RecordBatch:
    """Metrics of all pairs of a table (scene, a, b, inter, area_a, area_b) whose pairs lie together."""
    head = _heads(t)
    size = np.diff(np.append(head, t.num_rows))
    row = np.repeat(np.arange(len(head)), size)
    place = np.arange(t.num_rows) - head[row]
    inter, one, two = (t.column(i).to_numpy() for i in (3, 4, 5))
    iou, ab, ba = inter / (one + two - inter), inter / one, inter / two
    med = _medians(row, place, size, [iou, ab, ba, one / two, one, two])
    part = lambda v, least: np.add.reduceat((v >= least).astype(np.int64), head) / size
    cols = {"shared": size.astype(np.int64), "median_iou": med[0], "iou_share": part(iou, cfg.frame_iou), "duplicate_share": part(iou, cfg.duplicate_frame_iou), "median_ab": med[1], "median_ba": med[2],
            "share_ab": part(ab, cfg.fragment_frame), "share_ba": part(ba, cfg.fragment_frame), "median_ratio": med[3], "median_area_a": med[4], "median_area_b": med[5]}
    names = t.select([0, 1, 2]).take(pa.array(head)).combine_chunks()
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in names.columns), *(pa.array(v) for v in cols.values())], names=[*t.column_names[:3], *cols])


def _heads(t: pa.Table) -> np.ndarray:
    """The first row of each run of equal (scene, a, b)."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for i in range(3):
        code = pc.dictionary_encode(t.column(i).combine_chunks(), "encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _measured(cfg: TrackMerge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= STEP:
                t = pa.Table.from_batches(held)
                cut = int(_heads(t)[-1])  # the last pair may go on
                if cut:
                    yield _measure(t.slice(0, cut), cfg)
                held, n = t.slice(cut).to_batches(), 0 if cut else -n
        if any(b.num_rows for b in held):
            yield _measure(pa.Table.from_batches(held), cfg)

    return run


def pair_metrics(overlaps: DataFrame, frames: DataFrame, forbidden: DataFrame | None = None, scene: str = "scene", track: str = "track", cfg: TrackMerge = TrackMerge()) -> DataFrame:
    """Per pair: shared frames, coverage of the shorter track, medians and shares of IoU and both containments.

    ``frames``: (scene, track, n) non-empty frames of each track. Empty aggregates are 0.
    """
    # Pairs come sorted to a kernel that takes exact medians of many at once.
    o = overlaps.filter("area_a > 0 and area_b > 0").select(scene, "a", "b", *(F.col(c).cast("double").alias(c) for c in ("inter", "area_a", "area_b")))
    kind = {f.name: f.dataType.simpleString() for f in o.schema}
    out = ", ".join([*(f"{c} {kind[c]}" for c in (scene, "a", "b")), "shared bigint", *(f"{c} double" for c in ("median_iou", "iou_share", "duplicate_share", "median_ab", "median_ba", "share_ab", "share_ba", "median_ratio", "median_area_a", "median_area_b"))])
    m = o.repartition(scene, "a", "b").sortWithinPartitions(scene, "a", "b").mapInArrow(_measured(cfg), out)
    na = frames.select(scene, F.col(track).alias("a"), F.col("n").alias("_na"))
    nb = frames.select(scene, F.col(track).alias("b"), F.col("n").alias("_nb"))
    m = m.join(na, [scene, "a"]).join(nb, [scene, "b"]).withColumn("coverage", F.col("shared") / F.least("_na", "_nb")).drop("_na", "_nb")
    return _forbid(m, forbidden, scene)


#: Values (pair and frame) that are held at a time; fewest and most tracks of a block.
CELLS, BLOCK = 1 << 19, (64, 1024)
_METRICS = ("median_iou", "iou_share", "duplicate_share", "median_ab", "median_ba", "share_ab", "share_ba", "median_ratio", "max_ratio", "median_area_a", "median_area_b")


class _Block:
    """Tracks of one block, those with early frames first: per run its track and frame by number, line and ends."""

    def __init__(self, t: pa.Table, frames: pa.Array, rank: np.ndarray):
        lists = t["_r"].combine_chunks()
        flat = lists.flatten()
        self.frame = pc.index_in(flat.field("f"), frames).to_numpy()
        track = np.repeat(np.arange(t.num_rows), pc.list_value_length(lists).to_numpy())
        first = np.full(t.num_rows, len(frames))
        np.minimum.at(first, track, self.frame)
        order = np.argsort(first, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.track, self.rank = back[track], rank[order]
        self.y, self.start, self.stop = flat.field("y").to_numpy(), flat.field("x0").to_numpy().astype(float), flat.field("x1").to_numpy().astype(float)
        o = np.lexsort((self.y, self.frame, self.track))
        self.frame, self.track, self.y, self.start, self.stop = (v[o] for v in (self.frame, self.track, self.y, self.start, self.stop))
        self.n = len(order)
        self.edge = np.searchsorted(self.track, np.arange(self.n + 1))

    def part(self, lo: int, hi: int):
        r = slice(self.edge[lo], self.edge[hi])
        return self.track[r] - lo, self.frame[r], self.y[r], self.start[r], self.stop[r]


def _overlaps(p, q, na: int, nb: int, seen: np.ndarray):
    """(area of a, area of b, shared) of all pairs in the frames ``seen``, frame first; an area is NaN where a track has no mask."""
    num = np.full(int(seen.max()) + 1 if len(seen) else 0, -1)
    num[seen] = np.arange(len(seen))

    def own(r, n):
        track, frame, y, lo, hi = r
        ok = np.flatnonzero(frame < len(num))
        ok = ok[num[frame[ok]] >= 0]
        track, frame, y, lo, hi = track[ok], num[frame[ok]], y[ok], lo[ok], hi[ok]
        area = np.zeros((len(seen), n))
        np.add.at(area, (frame, track), hi - lo)
        area[area == 0] = np.nan
        return (track, frame, y, lo, hi), area

    (p, one), (q, two) = own(p, na), own(q, nb)
    single = all(len(np.unique(r[1] * n + r[0])) == len(r[0]) for r, n in ((p, na), (q, nb)))
    lines = np.union1d(p[2], q[2])
    if single and len(lines) == 1:
        ends = []
        for (track, frame, _, lo, hi), n in ((p, na), (q, nb)):
            for v in (lo, hi):
                e = np.full((len(seen), n), np.nan)
                e[frame, track] = v
                ends.append(e)
        inter = np.minimum(ends[1][:, :, None], ends[3][:, None, :])
        inter -= np.maximum(ends[0][:, :, None], ends[2][:, None, :])
        np.maximum(inter, 0, out=inter)
        return one, two, inter
    inter = np.zeros((len(seen), na, nb))
    code = lambda r: r[1] * np.int64(len(lines)) + np.searchsorted(lines, r[2])
    kp, kq = code(p), code(q)
    op, oq = np.lexsort((p[0], kp)), np.lexsort((q[0], kq))
    kp, kq = kp[op], kq[oq]
    for k in np.intersect1d(kp, kq):
        i, j = op[np.searchsorted(kp, k) : np.searchsorted(kp, k, "right")], oq[np.searchsorted(kq, k) : np.searchsorted(kq, k, "right")]
        both = np.maximum(np.minimum(p[4][i, None], q[4][j]) - np.maximum(p[3][i, None], q[3][j]), 0)
        hi, hj = np.flatnonzero(np.diff(p[0][i], prepend=-1)), np.flatnonzero(np.diff(q[0][j], prepend=-1))
        inter[k // len(lines)][np.ix_(p[0][i][hi], q[0][j][hj])] += np.add.reduceat(np.add.reduceat(both, hi, 0), hj, 1)
    return one, two, inter


def _median_rows(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Exact median of each row's first ``size`` values; the others are infinite."""
    v.sort(1)
    i = np.arange(len(size))
    return (v[i, (size - 1) // 2] + v[i, size // 2]) / 2


def _paired(cfg: TrackMerge, keep: tuple[str, ...], columns: tuple[str, ...]):
    """Metrics of the pairs between two blocks. Pairs that cannot pass any of ``keep`` are left out before medians are taken."""

    def possible(one, two, inter, n, coverage):
        if not keep:
            return n > 0
        enough, covered = n >= max(1, cfg.min_shared), coverage >= cfg.min_coverage
        iou = inter / (one[:, :, None] + two[:, None, :] - inter)
        out = np.zeros(n.shape, bool)
        # A median reaches a value only if half of all values do.
        half = lambda least: 2 * (iou >= least).sum(0) >= n
        if "duplicates" in keep:
            out |= covered & ((((iou >= cfg.frame_iou).sum(0) / n >= cfg.frame_iou_share) & half(cfg.min_median_iou)) | (((iou >= cfg.duplicate_frame_iou).sum(0) / n >= cfg.duplicate_share) & half(cfg.duplicate_median_iou)))
        if "conflicts" in keep:
            out |= half(cfg.duplicate_median_iou)
        if "fragments" in keep:
            ab, ba = inter / one[:, :, None], inter / two[:, None, :]
            for v in (ab, ba):
                out |= covered & ((v >= cfg.fragment_frame).sum(0) / n >= cfg.fragment_share) & (2 * (v >= cfg.fragment_median).sum(0) >= n)
        return out & enough

    def run(key: tuple, t: pa.Table) -> pa.Table:
        names = t["_t"].combine_chunks()
        rank = np.empty(len(names), np.int64)
        rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        side = t["_side"].to_numpy()
        frames = t["_r"].combine_chunks().flatten().field("f").unique()
        frames = frames.take(pc.array_sort_indices(frames))
        one_block = key[1].as_py() == key[2].as_py()
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        a = _Block(t.take(pa.array(at[0])), frames, rank[at[0]]) if len(at[0]) else None
        b = a if one_block else _Block(t.take(pa.array(at[1])), frames, rank[at[1]]) if len(at[1]) else None
        got: list[dict] = []
        if a and b:
            size = [np.bincount(np.unique(x.track * np.int64(len(frames)) + x.frame) // len(frames), minlength=x.n) for x in (a, b)]
            wide = max(1, min(b.n, CELLS // max(1, len(frames))))
            step = max(1, CELLS // (wide * max(1, len(frames))))
            for j in range(0, b.n, wide):
                jj = min(b.n, j + wide)
                q = b.part(j, jj)
                has = np.unique(q[1])
                for i in range(0, a.n, step):
                    ii = min(a.n, i + step)
                    if one_block and i >= jj:
                        continue
                    p = a.part(i, ii)
                    seen = np.intersect1d(p[1], has)
                    if len(seen):
                        with np.errstate(all="ignore"):
                            got += some(a, b, i, ii, j, jj, p, q, seen, size, one_block)
        cols = {c: np.concatenate([g[c] for g in got]) if got else np.zeros(0, np.int64 if c in ("a", "b", "shared") else float) for c in ("a", "b", "shared", "coverage", *columns)}
        back = np.argsort(rank)
        ids = [names.take(pa.array(back[cols[c]])) for c in ("a", "b")]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(ids[0]), key[0].type), *ids, *(pa.array(cols[c]) for c in ("shared", "coverage", *columns))], names=["_s", "a", "b", "shared", "coverage", *columns])

    def some(a, b, i, ii, j, jj, p, q, seen, size, one_block):
        one, two, inter = _overlaps(p, q, ii - i, jj - j, seen)
        n = (~np.isnan(one)).astype(float).T @ (~np.isnan(two)).astype(float)
        coverage = n / np.minimum(size[0][i:ii, None], size[1][None, j:jj])
        ok = possible(one, two, inter, n, coverage) & (n > 0)
        if one_block:
            ok &= np.arange(i, ii)[:, None] < np.arange(j, jj)
        x, y = np.nonzero(ok)
        out = []
        for s in range(0, len(x), max(1, CELLS // len(seen))):
            xs, ys = x[s : s + max(1, CELLS // len(seen))], y[s : s + max(1, CELLS // len(seen))]
            u, v, w = one[:, xs].T, two[:, ys].T, np.ascontiguousarray(inter[:, xs, ys].T)
            ra, rb = a.rank[i + xs], b.rank[j + ys]
            turn = ra > rb
            u, v = np.where(turn[:, None], v, u), np.where(turn[:, None], u, v)
            there = ~np.isnan(u + v)
            c = there.sum(1)
            fill = lambda m: np.where(there, m, np.inf)
            part = lambda m, least: (m >= least).sum(1, where=there) / c
            iou, ab, ba = w / (u + v - w), w / u, w / v
            kinds = {
                "iou_share": lambda: part(iou, cfg.frame_iou), "duplicate_share": lambda: part(iou, cfg.duplicate_frame_iou), "share_ab": lambda: part(ab, cfg.fragment_frame), "share_ba": lambda: part(ba, cfg.fragment_frame),
                "max_ratio": lambda: np.where(there, u / v, -np.inf).max(1), "median_iou": lambda: _median_rows(fill(iou), c), "median_ab": lambda: _median_rows(fill(ab), c), "median_ba": lambda: _median_rows(fill(ba), c),
                "median_ratio": lambda: _median_rows(fill(u / v), c), "median_area_a": lambda: _median_rows(fill(u), c), "median_area_b": lambda: _median_rows(fill(v), c),
            }
            out.append({"a": np.where(turn, rb, ra), "b": np.where(turn, ra, rb), "shared": c.astype(np.int64), "coverage": coverage[xs, ys], **{k: kinds[k]() for k in columns}})
        return out

    return run


def run_metrics(runs: DataFrame, scene: str = "scene", track: str = "track", frame: str = "frame", cfg: TrackMerge = TrackMerge(), keep: tuple[str, ...] = (), columns: tuple[str, ...] = _METRICS, forbidden: Column | DataFrame | None = None) -> DataFrame:
    """As :func:`pair_metrics`, from the masks themselves (scene, track, frame, y, x0, x1; runs of a line don't overlap): every pair of tracks that
    have a frame in common, and the largest ratio of areas (``max_ratio``).

    Tracks are put in blocks and each two blocks meet in one task, so no row per pair and frame is ever made: a track is sent once to every
    block. ``keep``: of 'duplicates', 'fragments' and 'conflicts', leaves out pairs that can be none of these.
    ``forbidden``: a condition on a and b, or pairs (scene, a, b).
    """
    spark = runs.sparkSession
    item = F.struct(F.col(frame).alias("f"), F.col("y").alias("y"), F.col("x0").alias("x0"), F.col("x1").alias("x1"))
    packed = materialize(runs.filter("x1 > x0").groupBy(scene, track).agg(F.collect_list(item).alias("_r")), "packed")
    most = packed.groupBy(scene).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks = max(1, -(-most // min(BLOCK[1], max(BLOCK[0], most // 24))))
    one = packed.select(F.col(scene).alias("_s"), F.col(track).alias("_t"), "_r", F.pmod(F.xxhash64(track), F.lit(blocks)).cast("int").alias("_g"))
    sides = one.select("_s", "_t", "_r", F.lit(0).alias("_side"), F.col("_g").alias("_i"), F.explode(F.sequence("_g", F.lit(blocks - 1))).alias("_j"))
    if blocks > 1:
        sides = sides.unionByName(one.filter("_g > 0").select("_s", "_t", "_r", F.lit(1).alias("_side"), F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_i"), F.col("_g").alias("_j")))
    # Few bytes make much work here: the number of tasks must not follow the bytes.
    tasks = max(spark.sparkContext.defaultParallelism, min(blocks * (blocks + 1) // 2, 2000))
    kind = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = f"_s {kind[scene]}, a {kind[track]}, b {kind[track]}, shared bigint, coverage double, " + ", ".join(f"{c} double" for c in columns)
    m = sides.repartition(tasks, "_s", "_i", "_j").groupBy("_s", "_i", "_j").applyInArrow(_paired(cfg, keep, columns), schema).withColumnRenamed("_s", scene)
    return _forbid(m, forbidden, scene)


def _forbid(m: DataFrame, forbidden: Column | DataFrame | None, scene: str) -> DataFrame:
    if not isinstance(forbidden, DataFrame):
        return m.withColumn("forbidden", F.lit(False) if forbidden is None else forbidden)
    bad = forbidden.select(scene, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("_f")).distinct()
    return m.join(bad, [scene, "a", "b"], "left").withColumn("forbidden", F.coalesce("_f", F.lit(False))).drop("_f")


def duplicate_flags(pairs: DataFrame, same_label, cfg: TrackMerge = TrackMerge()) -> DataFrame:
    """Same-label match, stricter cross-label duplicate, and conflict of forbidden pairs that overlap all the same."""
    enough = F.col("shared") >= cfg.min_shared
    covered = F.col("coverage") >= cfg.min_coverage
    same = same_label & ~F.col("forbidden") & enough & covered & (F.col("median_iou") >= cfg.min_median_iou) & (F.col("iou_share") >= cfg.frame_iou_share)
    cross = F.lit(cfg.cross_label) & ~same_label & ~F.col("forbidden") & enough & covered & (F.col("median_iou") >= cfg.duplicate_median_iou) & (F.col("duplicate_share") >= cfg.duplicate_share)
    conflict = F.col("forbidden") & same_label & enough & (F.col("median_iou") >= cfg.duplicate_median_iou)
    return pairs.withColumns({"same_label_match": same, "cross_label_duplicate": cross, "forbidden_conflict": conflict, "merge_kind": F.when(same, "same_label_duplicate").when(cross, "cross_label_duplicate")})


def fragment_candidates(pairs: DataFrame, cfg: TrackMerge = TrackMerge()) -> DataFrame:
    """(child, parent, ...): tracks that lie almost wholly in a larger one of the same label, both directions.
    The reverse ratio is the inverse of the median ratio."""
    base = pairs.filter(~F.col("forbidden") & (F.col("shared") >= cfg.min_shared) & (F.col("coverage") >= cfg.min_coverage))
    cols = [c for c in pairs.columns if c not in ("a", "b")]
    # Both directions of a pair at once: two branches would measure all pairs twice.
    names = ("child", "parent", "containment", "containment_share", "area_ratio", "child_area", "parent_area")
    back = F.coalesce(1 / F.nullif(F.col("median_ratio"), F.lit(0.0)), F.lit(float("inf")))
    both = [[F.col("a"), F.col("b"), F.col("median_ab"), F.col("share_ab"), F.col("median_ratio"), F.col("median_area_a"), F.col("median_area_b")],
            [F.col("b"), F.col("a"), F.col("median_ba"), F.col("share_ba"), back, F.col("median_area_b"), F.col("median_area_a")]]
    d = base.select(*cols, F.explode(F.array(*(F.struct(*(c.alias(n) for c, n in zip(v, names))) for v in both))).alias("_d"))
    return d.select(*cols, *(F.col(f"_d.{n}").alias(n) for n in names)).filter(
        (F.col("child_area") > 0) & (F.col("parent_area") > F.col("child_area")) & (F.col("containment") >= cfg.fragment_median)
        & (F.col("containment_share") >= cfg.fragment_share) & (F.col("area_ratio") <= cfg.fragment_area)
    )


def best_parent(candidates: DataFrame, scene: str = "scene") -> DataFrame:
    """Each fragment's best parent: most strong frames, containment, larger parent, smaller ratio, more frames, greater id."""
    order = [F.desc("containment_share"), F.desc("containment"), F.desc("parent_area"), F.asc("area_ratio"), F.desc("shared"), F.desc("parent")]
    return candidates.withColumn("_r", F.row_number().over(W.partitionBy(scene, "child").orderBy(*order))).filter("_r = 1").drop("_r")


def area_stats(areas: DataFrame, keys: list[str]) -> DataFrame:
    """Non-empty frames, mean, median and coefficient of variation (population) of areas; infinite if undefined."""
    a = areas.filter("area > 0").groupBy(*keys).agg(
        F.count("*").alias("frames"), F.avg("area").alias("area_mean"), F.median("area").alias("area_median"), (F.stddev_pop("area") / F.avg("area")).alias("_cv")
    )
    return areas.select(*keys).distinct().join(a, keys, "left").select(
        *keys, F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("area_mean", F.lit(0.0)).alias("area_mean"), F.coalesce("area_median", F.lit(0.0)).alias("area_median"), F.coalesce("_cv", F.lit(float("inf"))).alias("area_cv")
    )


def canonical(members: DataFrame, keys: list[str], track: str = "track") -> DataFrame:
    """Each cluster's canonical track: most frames, steadiest area, highest confidence, smallest id."""
    order = [F.desc("frames"), F.asc("area_cv"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc(F.col(track).cast("string"))]
    return members.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def roots(attachments: DataFrame, tracks: DataFrame, scene: str, track: str) -> DataFrame:
    """(scene, track, root) along child -> parent links, by doubling; a cycle raises."""
    up = tracks.select(scene, track).join(attachments.select(scene, F.col("child").alias(track), F.col("parent").alias("root")), [scene, track], "left").withColumn("root", F.coalesce("root", track))
    up = materialize(up, "roots")
    for _ in range(64):
        nxt = up.select(scene, F.col(track).alias("root"), F.col("root").alias("_top"))
        new = materialize(up.join(nxt, [scene, "root"]).select(scene, track, F.col("_top").alias("root"), (F.col("_top") != F.col("root")).alias("_moved")), "roots")
        moved = not new.filter("_moved").isEmpty()
        up = new.drop("_moved")
        if not moved:
            loops = attachments.join(up.select(scene, F.col(track).alias("child"), "root"), [scene, "child"]).filter("root = child")
            if not loops.isEmpty():
                break
            return up
    raise ValueError("fragment attachments contain a cycle")


#: What duplicates and fragments are told by.
_RESOLVED = tuple(c for c in _METRICS if c != "max_ratio")


def resolve(tracks: DataFrame, overlaps: DataFrame, frames: DataFrame | None, forbidden: DataFrame | None = None, scene: str = "scene", track: str = "track", label: str = "label", cfg: TrackMerge = TrackMerge()) -> DataFrame:
    """(scene, track, cluster, root): complete-link clusters of duplicates; fragments point to their parents' roots.

    Without ``frames``, ``overlaps`` are the masks as :func:`run_metrics` takes them. Fragment evidence is taken between the canonical tracks of the clusters. ``tracks`` has scene, track, label, confidence, frames, area_cv.
    """
    from ..functions.text import normalize_label

    la = tracks.select(scene, F.col(track).alias("a"), normalize_label(F.col(label)).alias("_la"))
    lb = tracks.select(scene, F.col(track).alias("b"), normalize_label(F.col(label)).alias("_lb"))
    # Written once, as clusters and fragments both start from it.
    m = pair_metrics(overlaps, frames, forbidden, scene, track, cfg) if frames is not None else run_metrics(overlaps, scene, track, cfg=cfg, keep=("duplicates", "fragments"), columns=_RESOLVED, forbidden=forbidden)
    pairs = materialize(m.join(la, [scene, "a"]).join(lb, [scene, "b"]), "pairs")
    flagged = duplicate_flags(pairs, F.col("_la") == F.col("_lb"), cfg)
    clusters = materialize(graphs.complete_link(tracks, flagged.filter("merge_kind is not null"), scene, track), "clusters")
    top = canonical(tracks.join(clusters, [scene, track]), [scene, "cluster"], track).select(scene, "cluster", F.col(track).alias("_canonical"))
    of = clusters.join(top, [scene, "cluster"])
    keep = top.select(scene, F.col("_canonical").alias("_k"))
    among = pairs.filter("_la = _lb").join(keep.withColumnRenamed("_k", "a"), [scene, "a"]).join(keep.withColumnRenamed("_k", "b"), [scene, "b"])
    parents = best_parent(fragment_candidates(among, cfg), scene)
    top_roots = roots(parents, top.select(scene, F.col("_canonical").alias(track)), scene, track).select(scene, F.col(track).alias("_canonical"), "root")
    return of.join(top_roots, [scene, "_canonical"]).select(scene, track, "cluster", F.col("_canonical").alias("canonical"), "root")


def merged_masks(runs: DataFrame, groups: DataFrame, scene: str = "scene", track: str = "track", frame: str = "frame", keep_canonical: bool = False) -> DataFrame:
    """Masks of each group's union per frame; with ``keep_canonical`` only frames the root lacks take the others' masks."""
    from .masks import normalize

    g = runs.join(groups.select(scene, track, "root"), [scene, track])
    if keep_canonical:
        own = g.filter(F.col(track) == F.col("root"))
        have = own.select(scene, "root", frame).distinct()
        g = own.unionByName(g.filter(F.col(track) != F.col("root")).join(have, [scene, "root", frame], "left_anti"))
    return normalize(g.select(scene, F.col("root").alias(track), frame, "y", "x0", "x1"), [scene, track, frame])


def carve_decisions(overlaps: DataFrame, keys: list[str], cfg: Carve = Carve()) -> DataFrame:
    """(keys, containment, ratio, carve): carve a child out of its parent if it lies in it and never is large beside it.
    ``overlaps``: (keys, area_child, area_parent, inter) per frame."""
    return overlaps.groupBy(*keys).agg(
        F.coalesce(F.median(F.col("inter") / F.nullif("area_child", F.lit(0))), F.lit(0.0)).alias("containment"), F.max(F.col("area_child") / F.nullif("area_parent", F.lit(0))).alias("ratio")
    ).withColumn("carve", (F.col("containment") >= cfg.min_containment) & (F.col("ratio") <= cfg.max_area_ratio))


def carve_of(metrics: DataFrame, cfg: Carve = Carve()) -> DataFrame:
    """As :func:`carve_decisions` of a in b, from :func:`run_metrics`."""
    m = metrics.withColumns({"containment": F.col("median_ab"), "ratio": F.col("max_ratio")})
    return m.withColumn("carve", (F.col("containment") >= cfg.min_containment) & (F.col("ratio") <= cfg.max_area_ratio))


def step_ratios(areas: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Larger over smaller area of neighbouring non-empty frames."""
    before = F.lag("area").over(W.partitionBy(*keys).orderBy(frame))
    return areas.filter("area > 0").withColumn("_b", before).withColumn("step", F.when(F.col("_b").isNotNull(), F.greatest("_b", "area") / F.least("_b", "area"))).drop("_b")


def identity_quality(areas: DataFrame, keys: list[str], frame: str, expected: int, cfg: IdentityQuality = IdentityQuality()) -> DataFrame:
    """Coverage, mean area, variation, largest step and issues of every identity."""
    steps = step_ratios(areas, keys, frame)
    q = steps.groupBy(*keys).agg(
        F.count_distinct(frame).alias("frames"), F.avg("area").alias("area_mean"), (F.stddev_pop("area") / F.avg("area")).alias("area_cv"), F.coalesce(F.max("step"), F.lit(1.0)).alias("max_step")
    ).withColumn("coverage", F.col("frames") / F.lit(float(expected)))
    q = areas.select(*keys).distinct().join(q, keys, "left").na.fill({"frames": 0, "area_mean": 0.0, "max_step": 1.0, "coverage": 0.0})
    issues = F.filter(
        F.array(
            F.when(F.col("frames") == 0, F.lit("empty_track")), F.when(F.col("frames") < cfg.min_frames, F.lit("short_track")), F.when(F.col("coverage") < cfg.min_coverage, F.lit("low_coverage")),
            F.when(F.col("area_cv") > cfg.max_cv, F.lit("unstable_area")), F.when(F.col("max_step") > cfg.max_step, F.lit("area_jump")),
        ), lambda x: x.isNotNull(),
    )
    return q.withColumn("issues", issues)


def normalize_manifest(dets: DataFrame, scene: str = "scene") -> DataFrame:
    """Seeds of a detection manifest (scene, frame, label, idx, score, x1..y2): beds absorb mattresses and keep one best
    detection; of every other label the two best frames give at most eight seeds. Ids get suffixes by rank."""
    from ..functions.text import normalize_label

    d = dets.withColumn("_l", normalize_label(F.col("label"))).withColumn("_l", F.when(F.col("_l").isin("bed", "mattress"), "bed").otherwise(F.col("_l")))
    best = d.filter("_l = 'bed'").withColumn("_r", F.row_number().over(W.partitionBy(scene).orderBy(F.desc("score"), "idx"))).filter("_r = 1").drop("_r")
    rest = seeds(d.filter("_l <> 'bed'"), [scene, "_l"], "frame", "score", "idx")
    out = best.unionByName(rest)
    n = F.row_number().over(W.partitionBy(scene, "_l").orderBy("frame", "idx"))
    return out.withColumn("object_id", F.concat_ws("-", "_l", n)).withColumnRenamed("_l", "object_label")


def seeds(dets: DataFrame, keys: list[str], frame: str, score: str, idx: str, anchors: int = 2, most: int = 8) -> DataFrame:
    """Detections of each key's best frames (by best score, then frame), at most ``most`` by score."""
    top = F.max(score).over(W.partitionBy(*keys, frame))
    d = dets.withColumn("_top", top).withColumn("_f", F.dense_rank().over(W.partitionBy(*keys).orderBy(F.desc("_top"), frame))).filter(F.col("_f") <= anchors)
    return d.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), frame, idx))).filter(F.col("_r") <= most).drop("_top", "_f", "_r")


