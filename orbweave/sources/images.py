"""Frames as pixels: decoding, distortion, resizing. Decoders beyond PNG and NPY are optional plug-ins."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import png, read_png


def decode(path: str, data: bytes) -> np.ndarray:
    low = path.lower()
    if low.endswith(".npy"):
        return np.load(io.BytesIO(data), allow_pickle=False)
    if low.endswith(".png"):
        return read_png(data)
    if low.endswith(".exr"):
        return _plugin("OpenEXR", low)
    return _plugin("PIL", low, lambda m: np.asarray(m.open(io.BytesIO(data))))


def _plugin(module: str, path: str, use: Callable | None = None) -> np.ndarray:
    import importlib

    try:
        m = importlib.import_module(module if module != "PIL" else "PIL.Image")
    except ImportError as e:
        raise RuntimeError(f"decoding {path} needs {module}") from e
    if use is None:
        raise RuntimeError(f"no decoder is set up for {path}")
    return use(m)


def resize_nearest(a: np.ndarray, width: int, height: int) -> np.ndarray:
    y = np.minimum((np.arange(height) * a.shape[0] / height).astype(int), a.shape[0] - 1)
    x = np.minimum((np.arange(width) * a.shape[1] / width).astype(int), a.shape[1] - 1)
    return a[y][:, x]


def resize_linear(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with half-pixel centres."""
    y = np.clip((np.arange(height) + 0.5) * a.shape[0] / height - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * a.shape[1] / width - 0.5, 0, a.shape[1] - 1)
    return _sample(a, *np.meshgrid(x, y))


def _sample(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, a.shape[1] - 1), np.minimum(y0 + 1, a.shape[0] - 1)
    fx, fy = (x - x0), (y - y0)
    if a.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy


def undistort(a: np.ndarray, fx: float, fy: float, cx: float, cy: float, k: tuple[float, ...]) -> np.ndarray:
    """Radial (k1, k2, k3) and tangential (p1, p2) distortion taken out; ``k`` = (k1, k2, p1, p2, k3)."""
    k1, k2, p1, p2, k3 = (*k, *[0.0] * (5 - len(k)))
    u, v = np.meshgrid((np.arange(a.shape[1]) - cx) / fx, (np.arange(a.shape[0]) - cy) / fy)
    r = u * u + v * v
    radial = 1 + r * (k1 + r * (k2 + r * k3))
    x = u * radial + 2 * p1 * u * v + p2 * (r + 2 * u * u)
    y = v * radial + p1 * (r + 2 * v * v) + 2 * p2 * u * v
    px, py = x * fx + cx, y * fy + cy
    out = _sample(a.astype(float), np.clip(px, 0, a.shape[1] - 1), np.clip(py, 0, a.shape[0] - 1))
    out[(px < 0) | (py < 0) | (px > a.shape[1] - 1) | (py > a.shape[0] - 1)] = 0
    return out


def read_images(files: DataFrame, width: int | None = None, height: int | None = None, depth_scale: float | None = None, distortion: dict | None = None) -> DataFrame:
    """(path, width, height, channels, pixels) of files (path, content): colour is undistorted and resized linearly to 8 bits;
    with ``depth_scale`` images are depth, resized to the nearest pixel and divided by it (pixels are DOUBLE then)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                a = decode(path, content)
                if depth_scale is None and distortion:
                    a = undistort(a, **distortion)
                if width and height:
                    a = (resize_nearest if depth_scale else resize_linear)(a, width, height)
                a = a / depth_scale if depth_scale else np.clip(np.rint(a), 0, 255)
                rows.append((path, a.shape[1], a.shape[0], 1 if a.ndim == 2 else a.shape[2], a.astype(float).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "pixels"])

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, channels int, pixels array<double>")


def read_rgbd(spark: SparkSession, layout: str, folder: str, color: str, depth: str, camera: tuple[float, float, float, float], size: tuple[int, int], width: int, height: int, depth_scale: float = 1000.0, distortion: tuple[float, ...] | None = None, **options) -> DataFrame:
    """(scene_id, frame_idx, color, depth, pose, fx, fy, cx, cy) of a dataset: images in natural order, undistorted, resized to ``width`` and ``height``, with the camera
    (fx, fy, cx, cy of images of ``size``) scaled alike; as many colour images as depth images are required. Further options are those of
    :func:`orbweave.sources.poses.read_frames`."""
    from .poses import check_counts, list_files, read_frames

    of_color, of_depth = list_files(spark, f"{folder}/{color}"), list_files(spark, f"{folder}/{depth}")
    check_counts(of_color, of_depth)
    kx, ky = width / size[0], height / size[1]
    fx, fy, cx, cy = camera
    bent = {"fx": fx, "fy": fy, "cx": cx, "cy": cy, "k": distortion} if distortion else None

    def pixels(pattern: str, files: DataFrame, name: str, **how) -> DataFrame:
        base, _, glob = f"{folder}/{pattern}".rpartition("/")
        raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(base).select("path", "content")
        return files.select("path", "frame_idx").join(read_images(raw, width, height, **how).select("path", F.col("pixels").alias(name)), "path").drop("path")

    images = pixels(color, of_color, "color", distortion=bent).join(pixels(depth, of_depth, "depth", depth_scale=depth_scale), "frame_idx")
    scaled = {"fx": fx * kx, "fy": fy * ky, "cx": cx * kx, "cy": cy * ky}
    return read_frames(spark, layout, folder, **options).join(images, "frame_idx").select("scene_id", "frame_idx", "color", "depth", "pose", *(F.lit(v).alias(n) for n, v in scaled.items()))


__all__ = ["decode", "png", "read_images", "read_rgbd", "resize_linear", "resize_nearest", "undistort"]
