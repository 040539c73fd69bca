"""Images as DataFrames (image_id, data, width, height): files, bytes and rasters of other programs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that a directory scan takes, in any case.
EXTENSIONS = ("png", "jpg", "jpeg", "webp")
IMAGES = "image_id string, data binary, width int, height int, error string"


def has_image_extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*EXTENSIONS) & F.contains(path, F.lit("."))


def image_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """PNG and JPEG files, decoded by Spark's image source to rows of red, green and blue bytes.

    A file that can't be decoded, WebP among them, keeps its row with an error and null data.
    """
    rows = spark.read.format("image").option("dropInvalid", "false").load(paths).select("image.*")
    rows = rows.where(has_image_extension(F.col("origin")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.height <= 0:
                    out.append((r.origin, None, None, None, "can't be decoded"))
                    continue
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                # The source gives blue, green, red, and alpha if there is one.
                rgb = np.repeat(pixels, 3, axis=2) if r.nChannels == 1 else pixels[..., 2::-1]
                out.append((r.origin, np.ascontiguousarray(rgb).tobytes(), r.width, r.height, None))
            yield pd.DataFrame(out, columns=["image_id", "data", "width", "height", "error"])

    return rows.mapInPandas(run, IMAGES)


def image_bytes(spark: SparkSession, data: bytes, image_id: str = "-") -> DataFrame:
    """One PNG file held in memory, such as what came by standard input."""
    pixels = decode_png(data)
    rgb = np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels[..., :3]
    row = (image_id, np.ascontiguousarray(rgb).tobytes(), rgb.shape[1], rgb.shape[0], None)
    return spark.createDataFrame([row], IMAGES)


def drop_alpha(data: bytes) -> bytes:
    """Red, green, blue and alpha bytes without the alpha."""
    return np.frombuffer(data, np.uint8).reshape(-1, 4)[:, :3].tobytes()


def decode_png(data: bytes) -> np.ndarray:
    """[h, w, c] of a PNG of 8 bits a channel that isn't interlaced; a palette becomes colours."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace:
        raise ValueError("only 8 bits a channel and no interlacing are supported")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above & 255
        elif kind:
            line = line.copy()
            for x in range(len(line)):
                left = line[x - channels] if x >= channels else 0
                corner = above[x - channels] if x >= channels else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                line[x] = line[x] + guess & 255
        out[y] = line
        above = line
    pixels = out.reshape(height, width, channels)
    return palette[pixels[..., 0]] if colour == 3 else pixels


def search(read: DataFrame, needle: str) -> DataFrame:
    """Images whose text holds the needle, in any case: read has image_id and text."""
    return read.where(F.contains(F.lower("text"), F.lit(needle.lower()))).select("image_id")
