"""Pose and frame readers of ten dataset layouts, each giving frames (scene_id, frame_idx, path, pose).

Poses are read as text or JSON by Spark; a registry maps layout names to readers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import poses as P

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    def wrap(fn):
        READERS[name] = fn
        return fn

    return wrap


def read_frames(spark: SparkSession, layout: str, folder: str, start: int = 0, end: int = -1, stride: int = 1, relative: bool = False, **options) -> DataFrame:
    """Frames of a dataset: ``layout`` (any case) picks the reader, then [start:end:stride], then poses relative to the first kept one."""
    fn = READERS.get(layout.lower())
    if fn is None:
        raise ValueError(f"unknown dataset: {layout}")
    if start < 0 or (end != -1 and end <= start):
        raise ValueError("need start >= 0 and end > start (or -1)")
    i = F.col("frame_idx")
    df = fn(spark, folder, **options)
    df = df.filter((i >= start) & (F.lit(end == -1) | (i < end)) & ((i - start) % stride == 0))
    if relative:
        first = F.first("pose").over(W.partitionBy("scene_id").orderBy("frame_idx"))
        df = df.withColumn("pose", P.multiply(P.rigid_inverse(first), F.col("pose")))
    return df


def natural(path: str = "path"):
    """Sort key of a path whose numbers count as numbers: the last number in the name, then the name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.struct(F.regexp_extract(name, r"(\d+)(?!.*\d)", 1).cast("bigint").alias("n"), name.alias("name"))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, modificationTime, frame_idx) of matching files in natural order; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern.rpartition("/")[2]).load(pattern.rpartition("/")[0]).select("path", "length", "modificationTime")
    return _numbered(files)


def _numbered(files: DataFrame) -> DataFrame:
    """Files (path, ...) with ``frame_idx``, their rank in natural order. Only the paths are sorted, in ranges; contents join them."""
    from ..operators.views import global_rank
    from ..storage import checked

    ranks = global_rank(files.select("path"), natural(), name="frame_idx").select("path", F.col("frame_idx").cast("int").alias("frame_idx"))
    return files.join(checked(ranks, 256), "path")


def check_counts(color: DataFrame, depth: DataFrame) -> None:
    a, b = color.count(), depth.count()
    if a != b:
        raise ValueError(f"{a} colour images but {b} depth images")


def numbers(c):
    return F.transform(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x.cast("double"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, value): a pose file's lines by number; a pose file is small and read as one row."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "value"))


def _scene(df: DataFrame, folder: str) -> DataFrame:
    return df.withColumn("scene_id", F.lit(folder.rstrip("/").rpartition("/")[2])).select("scene_id", "frame_idx", "pose")


def _per_line(spark: SparkSession, folder: str, path: str) -> DataFrame:
    return _scene(_lines(spark, path).select(F.col("i").alias("frame_idx"), numbers(F.col("value")).alias("pose")), folder)


def _grouped(lines: DataFrame, size: int, skip: int = 0) -> DataFrame:
    g = lines.groupBy(F.floor(F.col("i") / size).cast("int").alias("frame_idx")).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("x"))
    return g.select("frame_idx", F.flatten(F.transform(F.slice("x", skip + 1, size - skip), lambda r: numbers(r["value"]))).alias("v"))


def _per_file(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """One 4x4 per file, files in natural order."""
    t = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return _numbered(t).select("frame_idx", numbers(F.col("value")).alias("pose"))


@reader("icl")
def icl(spark: SparkSession, folder: str, poses: str = "traj.gt.sim", compat: bool = False) -> DataFrame:
    """Three lines of four numbers per pose; ``compat`` puts 3 in the last corner, as some tools do."""
    g = _grouped(_lines(spark, f"{folder}/{poses}"), 3)
    return _scene(g.select("frame_idx", F.concat("v", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(3.0 if compat else 1.0))).alias("pose")), folder)


@reader("replica")
def replica(spark: SparkSession, folder: str, poses: str = "traj.txt") -> DataFrame:
    """Sixteen numbers per line."""
    return _per_line(spark, folder, f"{folder}/{poses}")


@reader("scannet")
def scannet(spark: SparkSession, folder: str) -> DataFrame:
    return _scene(_per_file(spark, f"{folder}/pose", "*.txt"), folder)


@reader("ai2thor")
def ai2thor(spark: SparkSession, folder: str) -> DataFrame:
    return _scene(_per_file(spark, f"{folder}/pose", "*.txt"), folder)


@reader("azure")
@reader("azurekinect")
def azure(spark: SparkSession, folder: str, poses: str | None = "poses_global.txt", frames: int | None = None) -> DataFrame:
    """A ``.log`` file of five lines per pose (the first is a header), or sixteen numbers a line; without poses, identity."""
    if poses is None:
        return _scene(spark.range(frames or 0).select(F.col("id").cast("int").alias("frame_idx"), P.matrix(*P.IDENTITY).alias("pose")), folder)
    path = f"{folder}/{poses}"
    if not poses.endswith(".log"):
        return _per_line(spark, folder, path)
    lines = _lines(spark, path)
    if lines.count() % 5:
        raise ValueError("a .log pose file has five lines per pose")
    return _scene(_grouped(lines, 5, 1).select("frame_idx", F.col("v").alias("pose")), folder)


def _npy(spark: SparkSession, folder: str) -> DataFrame:
    import pandas as pd

    def decode(batches):
        import io

        import numpy as np

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "pose": [np.load(io.BytesIO(c), allow_pickle=False).astype(float).ravel().tolist() for c in pdf["content"]]})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content")
    out = raw.mapInPandas(decode, "path string, pose array<double>")
    return _numbered(out).select("frame_idx", P.conjugate_yz(F.col("pose")).alias("pose"))


@reader("realsense")
def realsense(spark: SparkSession, folder: str) -> DataFrame:
    return _scene(_npy(spark, f"{folder}/poses"), folder)


@reader("record3d")
def record3d(spark: SparkSession, folder: str) -> DataFrame:
    return _scene(_npy(spark, f"{folder}/poses"), folder)


@reader("multiscan")
def multiscan(spark: SparkSession, folder: str, poses: str = "poses.jsonl", frames: int = 1) -> DataFrame:
    """JSON lines with column-major ``transform``, one kept for each frame, axes flipped, scaled by the corner."""
    lines = _lines(spark, f"{folder}/{poses}")
    step = max(1, round(lines.count() / max(1, frames)))
    v = F.from_json("value", "transform array<double>")["transform"]
    kept = lines.filter(F.col("i") % step == 0).select((F.col("i") / step).cast("int").alias("frame_idx"), P.from_column_major(v).alias("p")).filter(F.col("frame_idx") < frames)
    turned = P.flip_axes(F.col("p"), 1, 2)
    return _scene(kept.select("frame_idx", F.transform(turned, lambda x: x / F.col("p")[15]).alias("pose")), folder)


@reader("hm3d")
def hm3d(spark: SparkSession, folder: str) -> DataFrame:
    j = spark.read.option("pathGlobFilter", "*.json").text(f"{folder}/pose", wholetext=True).select(F.input_file_name().alias("path"), F.flatten(F.from_json("value", "pose array<array<double>>")["pose"]).alias("p"))
    return _scene(_numbered(j).select("frame_idx", P.conjugate_yz(F.col("p")).alias("pose")), folder)


@reader("hm3d-openeqa")
def hm3d_openeqa(spark: SparkSession, folder: str) -> DataFrame:
    return _scene(_per_file(spark, folder, "*.txt").select("frame_idx", P.conjugate_yz(F.col("pose")).alias("pose")), folder)


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Pose rows of a simulator's trajectory file (``agent_logs`` of positions and rotations)."""
    kind = "agent_logs array<struct<position: struct<x: double, y: double, z: double>, rotation: struct<x: double, y: double, z: double>, cameraHorizon: double>>"
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)["agent_logs"]).alias("frame_idx", "log"))
    return t.select("frame_idx", "log.position", "log.rotation", F.greatest(F.lit(-30.0), F.least(F.lit(60.0), "log.cameraHorizon")).alias("horizon"))


def sample_poses(positions: DataFrame, n: int, seed: int = 0, yaws: int = 8, replace: bool = False) -> DataFrame:
    """``n`` reachable positions (by a hash of x, z and seed), each looking ``yaws`` ways; with ``replace`` positions may repeat and yaws vary."""
    from ..operators.filters import hash32
    from ..operators.views import global_rank

    mark = hash32(F.concat_ws(",", F.col("x").cast("double"), F.col("z").cast("double")), seed)
    if not replace:
        chosen = positions.orderBy(mark, "x", "z").limit(n)
        return chosen.withColumn("yaw", F.explode(F.array(*(F.lit(360.0 / yaws * k) for k in range(yaws)))))
    indexed = global_rank(positions, F.col("x"), F.col("z"), name="_r")
    total = positions.count()
    draws = positions.sparkSession.range(n).select("id", F.pmod(hash32(F.col("id"), seed), F.lit(max(1, total))).alias("_r"), (hash32(F.col("id"), seed + 1) / 2**32 * 360).alias("yaw"))
    return draws.join(indexed, "_r").drop("_r")


def depth_meters(c, limit: float = 15.0):
    """Simulator depth: beyond ``limit`` nothing, then whole millimetres."""
    return F.bround(F.when(c > limit, 0.0).otherwise(c), 3)
