"""Slots for external models (embedders, captioners, judges): protocols, deterministic stand-ins, cached calls."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class Embedder(Protocol):
    """Turns images (bytes) or texts into unit rows of one width."""

    dimension: int

    def images(self, data: list[bytes]) -> np.ndarray: ...

    def texts(self, data: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A deterministic stand-in: a unit vector drawn from the SHA-256 of the input."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def images(self, data: list[bytes]) -> np.ndarray:
        rows = []
        for x in data:
            seed = int.from_bytes(hashlib.sha256(x).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(self.dimension)
            rows.append(v / np.linalg.norm(v))
        return np.array(rows).reshape(-1, self.dimension)

    def texts(self, data: list[str]) -> np.ndarray:
        return self.images([x.encode() for x in data])


def embed_texts(df: DataFrame, column: str, make: Callable[[], Embedder], out: str = "embedding") -> DataFrame:
    """Embeds each distinct text once and joins the vectors back; the model is made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            v = model.texts(pdf[column].tolist())
            yield pdf.assign(**{out: [r.astype("float32") for r in v]})

    once = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return df.join(once.mapInPandas(run, f"{column} string, {out} array<float>"), column, "left")


def call_model(requests: DataFrame, schema: str, answer: Callable[[dict], dict], retries: int = 2) -> DataFrame:
    """Calls ``answer`` for each request row; failures are retried, then recorded in column ``error`` without the message's details."""
    names = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                got, error = {}, None
                for _ in range(retries + 1):
                    try:
                        got, error = answer(r), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of an outside service is data here
                        error = type(e).__name__
                rows.append({**r, **got, "error": error})
            yield pd.DataFrame(rows, columns=[*names, *(s.split()[0] for s in schema.split(",")), "error"])

    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInPandas(run, f"{base}, {schema}, error string")


def rule_judge(request: dict) -> dict:
    """A stand-in for the relation judge: answers from the evidence."""
    for key, text in (("on_ab", "a on b"), ("on_ba", "b on a"), ("in_ab", "a in b"), ("in_ba", "b in a")):
        if request.get(key):
            return {"answer": text}
    return {"answer": "none of these"}


def prompt(system: str, shots: list[tuple[str, str]], user: Column) -> Column:
    """A chat request as an array of (role, content)."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), (content if isinstance(content, Column) else F.lit(content)).alias("content"))
    turns = [turn("system", system)]
    for q, a in shots:
        turns += [turn("user", q), turn("assistant", a)]
    return F.array(*turns, turn("user", user))


def nfkc(c: Column) -> Column:
    """Unicode compatibility form; ASCII texts stay on the JVM's path when the column is filtered first."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(c)


def png(image: np.ndarray) -> bytes:
    """An 8-bit grey or RGB array as PNG."""
    import struct
    import zlib

    h, w = image.shape[:2]
    color = 2 if image.ndim == 3 else 0
    lines = b"".join(b"\0" + image[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """8- or 16-bit grey, RGB or RGBA, not interlaced."""
    import struct
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    pos, body, head = 8, b"", None
    while pos < len(data):
        n, kind = struct.unpack(">I4s", data[pos : pos + 8])
        part = data[pos + 8 : pos + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        pos += 12 + n
    w, h, depth, color, _, _, lace = head
    planes = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if planes is None or lace or depth not in (8, 16):
        raise ValueError("unsupported PNG")
    size = planes * depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * size)
    out = np.zeros((h, w * size), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * size, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            cur = np.zeros(w * size, np.int64)
            for x in range(w * size):
                a = cur[x - size] if x >= size else 0
                b, c = up[x], up[x - size] if x >= size else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    p = min(((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c)))[2]
                cur[x] = (line[x] + p) & 255
            out[y] = cur
    if depth == 16:
        out = out.reshape(h, w * planes, 2).astype(np.uint16)
        out = out[:, :, 0] << 8 | out[:, :, 1]
    return out.reshape(h, w) if planes == 1 else out.reshape(h, w, planes)


def data_url(data: bytes, kind: str = "image/png") -> str:
    return f"data:{kind};base64,{base64.b64encode(data).decode()}"


def outline(image: np.ndarray, mask: np.ndarray, color: tuple[int, int, int] = (255, 0, 0), width: int = 2) -> np.ndarray:
    """The image with the mask's border drawn."""
    grown = mask.copy()
    for _ in range(width):
        g = grown.copy()
        g[1:] |= grown[:-1]
        g[:-1] |= grown[1:]
        g[:, 1:] |= grown[:, :-1]
        g[:, :-1] |= grown[:, 1:]
        grown = g
    out = image.copy()
    out[grown & ~mask] = color
    return out


def blackout(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[~mask] = 0
    return out


def crop_both(image: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int], padding: int) -> tuple[np.ndarray, np.ndarray]:
    h, w = image.shape[:2]
    x1, y1, x2, y2 = max(0, box[0] - padding), max(0, box[1] - padding), min(w, box[2] + padding), min(h, box[3] + padding)
    return image[y1:y2, x1:x2], mask[y1:y2, x1:x2]


def scrub(message: str) -> str:
    """A service's error message without anything that looks like a key."""
    return re.sub(r"[A-Za-z0-9_-]{20,}", "***", message)


