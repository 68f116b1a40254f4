"""Sinks: object maps, scene graphs, manifests, masks, exports. Data go through Spark's commit protocol; manifests through atomic files."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import by_key
from ..operators.constraints import Violation, enforce, map_rules
from ..operators.models import png


def save_bytes(path: str, data: bytes, replace: bool = True) -> None:
    """Write whole or not at all: a temporary file beside it, synced, then renamed; without ``replace`` an existing file is an error."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(part, 0o600)
        if replace:
            os.replace(part, path)
        else:
            os.link(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def save_json(path: str, value, replace: bool = True) -> None:
    save_bytes(path, (json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n").encode(), replace)


def save_map(tables: dict[str, DataFrame], folder: str, manifest: dict | None = None, replace: bool = False) -> None:
    """An object map: Parquet tables (objects, observations, points ...) and a manifest. Objects are checked first."""
    if "objects" in tables and {"geometry_type", "point_count", "bbox", "object_id"} <= set(tables["objects"].columns):
        enforce(tables["objects"], map_rules())
    for name, df in tables.items():
        df.write.mode("overwrite" if replace else "errorifexists").parquet(f"{folder}/{name}")
    text = json.dumps({"tables": sorted(tables), **(manifest or {})}, sort_keys=True)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_map")


def load_map(spark: SparkSession, folder: str, background: bool | None = None) -> dict[str, DataFrame]:
    """Tables of a saved map; ``background`` False or True keeps that part of the objects."""
    names = json.loads(spark.read.text(f"{folder}/_map").first()[0])["tables"]
    out = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    if background is not None and "objects" in out:
        out["objects"] = out["objects"].filter(F.col("is_background") == background)
    return out


def save_snapshot(objects: DataFrame, frame: str, path: str, detections: str, least: int = 1) -> None:
    """A frame's objects with enough detections, partitioned by frame."""
    objects.filter(F.col(detections) >= least).write.mode("append").partitionBy(frame).parquet(path)


def save_graph(graph: DataFrame, path: str) -> None:
    """(key, value JSON) rows as one JSON object per line, read back and compared."""
    lines = graph.select(F.concat(F.lit("{"), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(":"), F.col("value"), F.lit("}")).alias("value"))
    lines.write.mode("overwrite").text(path)
    back = graph.sparkSession.read.text(path)
    if not lines.exceptAll(back).isEmpty() or not back.exceptAll(lines).isEmpty():
        raise Violation("the graph read back differs from the one written")


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(path)


def save_evidence(pairs: DataFrame, path: str, most: int) -> None:
    """Candidate pairs as JSON; more than ``most`` are written for diagnosis and then raise."""
    pairs.write.mode("overwrite").json(path)
    n = pairs.count()
    if n > most:
        raise Violation(f"{n} candidate pairs, {most} allowed; they are in {path}")


def export_masks(runs: DataFrame, folder: str, width: int, height: int) -> DataFrame:
    """Masks as ``folder/object/frame.png`` (shared folder); returns (object_id, frame_id, area)."""
    root = folder.removeprefix("file://")

    def write(t: pa.Table, head: np.ndarray) -> pa.Table:
        area = []
        names = t.select([0, 1]).take(pa.array(head))
        y, x0, x1 = (t[c].to_pylist() for c in ("y", "x0", "x1"))
        for a, b, obj, frame in zip(head, [*head[1:], t.num_rows], names[0].to_pylist(), names[1].to_pylist()):
            image = np.zeros((height, width), np.uint8)
            for i in range(a, b):
                image[y[i], x0[i] : x1[i]] = 255
            save_bytes(f"{root}/{obj}/{frame}.png", png(image))
            area.append(int((image > 0).sum()))
        return names.append_column("area", pa.array(area, pa.int64()))

    # Few bytes make many files: left to itself one task would write them all.
    d = runs.select(F.col("object_id").cast("string").alias("object_id"), F.col("frame_id").cast("string").alias("frame_id"), "y", "x0", "x1")
    return by_key(d, ["object_id", "frame_id"], [], write, "object_id string, frame_id string, area bigint", 4 * runs.sparkSession.sparkContext.defaultParallelism)


def export_sens(frames: DataFrame, folder: str, skip: int = 1) -> int:
    """Depth (PNG, 16 bit as two bytes), colour and poses of every ``skip``-th frame of a sensor stream."""
    root = folder.removeprefix("file://")

    def write(rows):
        for r in rows:
            save_bytes(f"{root}/depth/{r.frame_idx}.raw", bytes(r.depth))
            save_bytes(f"{root}/color/{r.frame_idx}.jpg", bytes(r.color))
            save_bytes(f"{root}/pose/{r.frame_idx}.txt", "\n".join(" ".join(f"{v:.9g}" for v in r.pose[i : i + 4]) for i in (0, 4, 8, 12)).encode())

    kept = frames.filter(F.col("frame_idx") % skip == 0)
    kept.foreachPartition(write)
    return kept.count()


def export_ply(points: DataFrame, folder: str, name: str) -> DataFrame:
    """Coloured points (``name``, x, y, z, r, g, b; colours in [0, 1]) as ``folder/name.ply``, binary little endian; returns (name, n). On any file system that Arrow knows."""
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in points.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        at.create_dir(root, recursive=True)
        row = np.zeros(len(pdf), [(c, "<f4") for c in "xyz"] + [(c, "u1") for c in ("r", "g", "b")])
        for c in "xyz":
            row[c] = pdf[c]
        for c in "rgb":
            row[c] = np.clip(np.rint(pdf[c] * 255), 0, 255)
        props = "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
        with at.open_output_stream(f"{root}/{pdf[name].iloc[0]}.ply") as f:
            f.write(f"ply\nformat binary_little_endian 1.0\nelement vertex {len(pdf)}\n{props}end_header\n".encode() + row.tobytes())
        return pd.DataFrame({name: [pdf[name].iloc[0]], "n": [len(pdf)]})

    return points.select(name, "x", "y", "z", "r", "g", "b").groupBy(name).applyInPandas(one, f"{name} {kind[name]}, n bigint")


def run_id(stamp) -> str:
    """An id of a run from a UTC time."""
    return f"{stamp:%Y%m%dT%H%M%SZ}"


def file_sha(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while b := f.read(1 << 20):
            h.update(b)
    return h.hexdigest()


def tree_sha(spark: SparkSession, folder: str) -> str:
    """One digest of all files below a folder, by relative path and content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rel = F.regexp_replace("path", f"^.*?{folder.removeprefix('file://').rstrip('/')}/", "")
    g = f.select(rel.alias("p"), F.sha2("content", 256).alias("h")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "h"))).alias("x"))
    return g.select(F.sha2(F.array_join("x", "\n"), 256)).first()[0]


def conversion_report(objects: DataFrame, path: str) -> dict:
    """Counts of accepted and rejected objects by reason, written as JSON."""
    n = objects.agg(F.count("*").alias("total"), F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.col("is_background") & (F.size("reasons") == 0)).alias("background")).first().asDict()
    why = {r["reason"]: r["count"] for r in objects.select(F.explode("reasons").alias("reason")).groupBy("reason").count().collect()}
    report = {**n, "foreground": n["accepted"] - n["background"], "rejections": why}
    save_json(path, report)
    return report
