"""Icons from saved images: files read as bytes, hashed by their pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a pixel by colour type: grey, RGB, palette, grey and alpha, RGBA.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray | None:
    """Brightness (height x width, 0 to 255) of a PNG of 8 bits a sample that isn't interlaced, over black; None for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, palette = 8, b"", None
    try:
        while at < len(data):
            (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(float)
            elif kind == b"IDAT":
                packed += body
            at += 12 + size
        if depth != 8 or interlaced or colour not in SAMPLES or not width or not height:
            return None
        n = SAMPLES[colour]
        lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n)
    except (struct.error, zlib.error, ValueError, UnboundLocalError):
        return None
    out = np.zeros((height + 1, width + 1, n), np.int64)
    for y in range(height):
        way, line, up = int(lines[y, 0]), lines[y, 1:].reshape(width, n).astype(np.int64), out[y]
        if way in (0, 2):
            out[y + 1, 1:] = (line + (up[1:] if way else 0)) & 255
        elif way == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        else:
            row = out[y + 1]
            for x in range(width):
                a, b, c = row[x], up[x + 1], up[x]
                if way == 3:
                    guess = (a + b) // 2
                else:
                    da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                row[x + 1] = (line[x] + guess) & 255
    pixels = out[1:, 1:].astype(float)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            return None
        pixels = palette[pixels[..., 0].astype(int)]
    alpha = pixels[..., -1] / 255 if colour in (4, 6) else 1.0
    grey = pixels[..., 0] if colour in (0, 4) else pixels[..., :3] @ [0.299, 0.587, 0.114]
    return grey * alpha


def shrink(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over ``height`` x ``width`` equal parts, pixels on an edge counting for their share."""

    def shares(size: int, parts: int) -> np.ndarray:
        edges = np.linspace(0, size, parts + 1)
        low, high = np.arange(size), np.arange(size) + 1
        cover = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
        return np.clip(cover, 0, None) * parts / size

    return shares(pixels.shape[0], height) @ pixels @ shares(pixels.shape[1], width).T


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 parts is brighter than its left neighbour. Size, brightness and contrast change none of them."""
    small = shrink(pixels, 8, 9)
    bits = (np.diff(small, axis=1) > 1e-6 * max(1.0, np.ptp(small))).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def hash_pictures(pictures: DataFrame) -> DataFrame:
    """(icon_id, hash) of ``pictures`` (icon_id, pixels: array of rows of doubles); null where there are none."""

    def run(batches):
        for batch in batches:
            rows = [np.array(x, float) if x and x[0] else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else difference_hash(r) for r in rows], pa.int64())], names=["icon_id", "hash"])

    kind = pictures.schema["icon_id"].dataType.simpleString()
    return pictures.select("icon_id", F.col("pixels").cast("array<array<double>>").alias("pixels")).mapInArrow(run, f"icon_id {kind}, hash long")


def read_icons(spark: SparkSession, path: str) -> DataFrame:
    """(icon_id, name, hash) of the images below a folder: icon_id is the file's path, name its own name without the ending; hash is null where a file is no such image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            pixels = [decode_png(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if p is None else difference_hash(p) for p in pixels], pa.int64())], names=["icon_id", "hash"])

    return files.mapInArrow(run, "icon_id string, hash long").select("icon_id", F.regexp_extract("icon_id", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "hash")
