"""Files with checks: strict JSON, frames manifests, camera files, masks, images, point clouds, sensor streams, configuration."""

from __future__ import annotations

import copy
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.constraints import Violation, enforce, frame_rules
from ..operators.models import read_png


def strict_json(text: str):
    """JSON without repeated keys, NaN or infinities."""

    def pairs(items):
        out = {}
        for k, v in items:
            if k in out:
                raise ValueError(f"repeated key {k!r}")
            out[k] = v
        return out

    def constant(name):
        raise ValueError(f"{name} is not JSON")

    got = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(got, dict):
        raise ValueError("expected an object")
    return got


def read_strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file, parsed by ``schema``; files that are not strict JSON raise."""

    def check(batches):
        for pdf in batches:
            for t in pdf["value"]:
                strict_json(t)
            yield pdf

    t = spark.read.text(path, wholetext=True).mapInPandas(check, "value string")
    return t.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def read_frames_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a manifest, checked: digits as ids, unique ids and source indices that increase, the stated count."""
    kind = "written_frame_count int, source_width int, source_height int, frames array<struct<frame_id: string, source_frame_index: bigint, source_time_sec: double, path: string>>"
    j = read_strict_json(spark, path, kind)
    f = j.select("written_frame_count", F.col("source_width").alias("width"), F.col("source_height").alias("height"), F.posexplode("frames").alias("frame_idx", "f")).select("written_frame_count", "width", "height", "frame_idx", "f.*")
    f = f.withColumn("previous", F.lag("source_frame_index").over(W.orderBy("frame_idx")))
    n, stated, ids = f.agg(F.count("*"), F.max("written_frame_count"), F.count_distinct("frame_id")).first()
    if n and (stated != n or ids != n):
        raise Violation(f"{n} frames, {ids} ids, {stated} stated")
    return enforce(f, frame_rules()).drop("previous", "written_frame_count")


def read_camera_info(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, fx, fy, cx, cy, w, h, extrinsic_type, extrinsic), every extrinsic a pose."""
    from ..functions.poses import is_pose

    kind = "extrinsic_type string, intrinsic struct<w: int, h: int, fx: double, fy: double, cx: double, cy: double>, extrinsic map<string, array<array<double>>>"
    j = read_strict_json(spark, path, kind)
    c = j.select("extrinsic_type", "intrinsic.*", F.explode("extrinsic").alias("frame_id", "m")).withColumn("extrinsic", F.flatten("m")).drop("m")
    return enforce(c, {"extrinsic_type": F.col("extrinsic_type").isin("world_to_camera", "camera_to_world"), "pose": is_pose(F.col("extrinsic")), "focal": (F.col("fx") > 0) & (F.col("fy") > 0)})


def frame_aliases(frames: DataFrame) -> DataFrame:
    """(alias, frame_id): every id and its form without leading zeros; ambiguous aliases raise."""
    a = frames.select(F.col("frame_id").alias("alias"), "frame_id").unionByName(frames.select(F.col("frame_id").cast("bigint").cast("string").alias("alias"), "frame_id")).distinct()
    if not a.groupBy("alias").count().filter("count > 1").isEmpty():
        raise Violation("ambiguous frame alias")
    return a


def mask_runs(mask: np.ndarray) -> list[tuple[int, int, int]]:
    """(y, x0, x1) of a boolean image."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return list(zip(y.tolist(), x0.tolist(), np.nonzero(edge == -1)[1].tolist()))


def read_masks(spark: SparkSession, folder: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """Runs (object_id, frame_id, y, x0, x1) of ``folder/object/frame.png``; folders that begin with '_' are skipped.
    Masks must be two-dimensional, of the given size, with values 0 and 255 only."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                m = read_png(content)
                if m.ndim != 2 or (width and m.shape[1] != width) or (height and m.shape[0] != height) or not np.isin(m, (0, 255)).all():
                    raise ValueError(f"not a binary mask of the right size: {path}")
                obj, name = path.split("/")[-2:]
                rows += [(obj, name.rpartition(".")[0], *r) for r in mask_runs(m > 0)]
            yield pd.DataFrame(rows, columns=["object_id", "frame_id", "y", "x0", "x1"])

    root = folder.removeprefix("file://")
    if not os.path.isdir(root) and "://" not in folder:
        return spark.createDataFrame([], "object_id string, frame_id string, y int, x0 int, x1 int")
    if "://" not in root:
        # A folder for each object: the driver lists only their names, the tasks look into them.
        shown = lambda name: not name.startswith(("_", "."))

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = []
                for name in pdf["name"]:
                    for at, below, files in os.walk(os.path.join(root, name) if name else root):
                        below[:] = [b for b in below if name and shown(b)]
                        found += [os.path.join(at, f) for f in sorted(files) if f.endswith(".png") and shown(f)]
                for i in range(0, len(found), 256):
                    data = []
                    for path in found[i : i + 256]:
                        with open(path, "rb") as f:
                            data.append(f.read())
                    yield from decode(iter([pd.DataFrame({"path": found[i : i + 256], "content": data})]))

        with os.scandir(root) as entries:
            names = [e.name for e in entries if e.is_dir() and shown(e.name)]
        if shown(os.path.basename(os.path.abspath(root))):
            names.append("")  # files of the folder itself
        listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(4 * spark.sparkContext.defaultParallelism)
        return listed.mapInPandas(read, "object_id string, frame_id string, y int, x0 int, x1 int")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder).select("path", "content")
    raw = raw.filter(~F.element_at(F.split("path", "/"), -2).startswith("_"))
    return raw.mapInPandas(decode, "object_id string, frame_id string, y int, x0 int, x1 int")


def read_depth(spark: SparkSession, pattern: str, scale: float = 1000.0) -> DataFrame:
    """(path, v, u, depth) of depth images (16-bit PNG or NPY), pixels of depth 0 left out."""
    import io

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                d = np.load(io.BytesIO(content), allow_pickle=False) if path.endswith(".npy") else read_png(content)
                v, u = np.nonzero(d > 0)
                yield pd.DataFrame({"path": path, "v": v.astype("int32"), "u": u.astype("int32"), "depth": d[v, u].astype(float) / scale})

    folder, _, glob = pattern.rpartition("/")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content").mapInPandas(decode, "path string, v int, u int, depth double")


_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and colours in [0, 1] of the vertices of a PLY file (ascii, little or big endian)."""
    end = data.find(b"end_header", 0, 4 << 20)
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file, or its header is too long")
    head = data[:end].decode("ascii").split("\n")
    body = data[data.index(b"\n", end) + 1 :]
    form, count, props, element, before = None, None, [], None, False
    for line in head:
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            form = w[1]
        elif w[0] == "element":
            element = w[1]
            if element == "vertex":
                count = int(w[2])
            elif count is None and int(w[2]):
                before = True
        elif w[0] == "property" and element == "vertex":
            if w[1] == "list":
                raise ValueError("list properties of vertices are not supported")
            props.append((w[2], _PLY[w[1]]))
    names = [p[0] for p in props]
    if count is None or before or any(n not in names for n in ("x", "y", "z", "red", "green", "blue")):
        raise ValueError("vertices need x, y, z, red, green, blue and must come first")
    if form == "ascii":
        rows = np.array([line.split()[: len(names)] for line in body.decode("ascii").split("\n")[:count]], float).reshape(count, len(names))
        col = {n: rows[:, i] for i, n in enumerate(names)}
    elif form in ("binary_little_endian", "binary_big_endian"):
        kind = np.dtype([(n, ("<" if "little" in form else ">") + t) for n, t in props])
        v = np.frombuffer(body, kind, count)
        col = {n: v[n].astype(float) for n in names}
    else:
        raise ValueError(f"unknown PLY format {form}")
    xyz, rgb = (np.stack([col[n] for n in ns], 1) for ns in (("x", "y", "z"), ("red", "green", "blue")))
    if dict(props)["red"] == "u1":
        rgb = rgb / 255
    if not np.isfinite(xyz).all() or not ((rgb >= 0) & (rgb <= 1)).all():
        raise ValueError("positions must be finite and colours in [0, 1]")
    return xyz, rgb


class _PathPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _FilesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [_PathPartition(p) for p in matching(self.path)] or [_PathPartition("")]


def matching(pattern: str) -> list[str]:
    """Files of a folder on any file system that Arrow knows, by a pattern of names."""
    import fnmatch

    from pyarrow import fs

    base, _, name = pattern.rpartition("/")
    at, root = fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (fs.LocalFileSystem(), base or ".")
    found = at.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f"{base}/{f.base_name}" for f in found if f.is_file and fnmatch.fnmatch(f.base_name, name))


def open_file(path: str):
    """A file of any such file system, to be read from its start."""
    from pyarrow import fs

    at, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return at.open_input_stream(name)


class _PlyReader(_FilesReader):
    def read(self, partition):
        if not partition.path:
            return
        with open_file(partition.path) as f:
            xyz, rgb = parse_ply(f.read())
        for i, (p, c) in enumerate(zip(xyz.tolist(), rgb.tolist())):
            yield (partition.path, i, *p, *c)


class PlySource(DataSource):
    """``spark.read.format("ply").load(glob)``: (path, point_id, x, y, z, r, g, b), one partition per file."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        return "path string, point_id bigint, x double, y double, z double, r double, g double, b double"

    def reader(self, schema):
        return _PlyReader(self.options)


def parse_sens(f) -> Iterator[tuple[int, np.ndarray, int, int, bytes, np.ndarray]]:
    """(index, pose, colour time, depth time, colour JPEG, depth) of a sensor stream, version 4."""
    version, n = struct.unpack("<IQ", f.read(12))
    if version != 4:
        raise ValueError("unsupported sensor stream")
    f.read(n)
    f.read(16 * 4 * 4)
    _, depth_kind = struct.unpack("<ii", f.read(8))
    _, _, dw, dh, _ = struct.unpack("<IIIIf", f.read(20))
    (frames,) = struct.unpack("<Q", f.read(8))
    for i in range(frames):
        pose = np.frombuffer(f.read(64), "<f4").astype(float)
        tc, td, nc, nd = struct.unpack("<QQQQ", f.read(32))
        color, depth = f.read(nc), f.read(nd)
        raw = zlib.decompress(depth) if depth_kind == 1 else depth
        yield i, pose, tc, td, color, np.frombuffer(raw, "<u2").reshape(dh, dw)


class _SensReader(_FilesReader):
    def read(self, partition):
        if not partition.path:
            return
        with open_file(partition.path) as f:
            for i, pose, tc, td, color, depth in parse_sens(f):
                yield (partition.path, i, pose.tolist(), tc, td, color, depth.tobytes(), depth.shape[1], depth.shape[0])


class SensSource(DataSource):
    """``spark.read.format("sens").load(glob)``: frames of sensor streams, one partition per file."""

    @classmethod
    def name(cls):
        return "sens"

    def schema(self):
        return "path string, frame_idx int, pose array<double>, color_time bigint, depth_time bigint, color binary, depth binary, width int, height int"

    def reader(self, schema):
        return _SensReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)
    spark.dataSource.register(SensSource)


def record3d_frames(spark: SparkSession, path: str) -> DataFrame:
    """(frame_idx, pose, fx, fy, cx, cy) of a Record3D metadata file: quaternions xyzw with positions, K scaled by 1 / 7.5."""
    from ..functions.poses import quaternion

    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "K array<double>, poses array<array<double>>").alias("j"))
    p = t.select("j.K", F.posexplode("j.poses").alias("frame_idx", "p"))
    q = F.col("p")
    k = [F.col("K")[i] / 7.5 for i in (0, 4, 6, 7)]
    return p.select("frame_idx", quaternion(q[0], q[1], q[2], q[3], [q[4], q[5], q[6]]).alias("pose"), *(v.alias(n) for v, n in zip(k, ("fx", "fy", "cx", "cy"))))


def raw_tracks(prompts: DataFrame, masks: DataFrame) -> DataFrame:
    """(object_id, label): every object with masks, labelled by the first non-empty of its prompt's name and category, or its id."""
    from ..functions.text import first_nonempty

    o = masks.select("object_id").distinct().join(prompts, "object_id", "left")
    return o.select("object_id", first_nonempty(F.col("name"), F.col("category"), F.col("object_id")).alias("label"))


def class_list(spark: SparkSession, path: str, background: tuple[str, ...]) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).filter((F.col("name") != "") & ~F.lower("name").isin(*background))


def merge_config(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, dictionaries merged at every depth; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_config(path: str, _seen: tuple[str, ...] = ()) -> dict:
    """A JSON or YAML file, laid on those it names in ``inherit_from`` (relative to it)."""
    if path in _seen:
        raise ValueError("configuration files inherit in a circle")
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        own = strict_json(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML configuration needs the yaml package; use JSON") from e
        own = yaml.safe_load(text) or {}
    parent = own.pop("inherit_from", None)
    if not parent:
        return own
    return merge_config(load_config(os.path.join(os.path.dirname(path), parent), (*_seen, path)), own)


def expand_variables(value, variables: dict[str, str]):
    """``${NAME}`` replaced in all strings of a configuration; an unknown name is an error."""
    if isinstance(value, dict):
        return {k: expand_variables(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_variables(v, variables) for v in value]
    if not isinstance(value, str):
        return value

    def one(m):
        if m.group(1) not in variables:
            raise ValueError(f"unknown variable {m.group(1)}")
        return variables[m.group(1)]

    return re.sub(r"\$\{(\w+)\}", one, value)


def uniform_indices(start: int, end: int, stride: int, most: int | None = None) -> list[int]:
    """start, start + stride ... up to end; at most ``most`` of them at half-even rounded even steps."""
    all_ = list(range(start, end + 1, stride))
    if most is None or len(all_) <= most:
        return all_
    n = len(all_)
    return [all_[round(i * (n - 1) / (most - 1))] for i in range(most)] if most > 1 else all_[:1]
