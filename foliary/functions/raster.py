"""Dense pixel kernels in float32: greyscale, padding, bilinear resizing and painting."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from foliary.functions.arrays import BLACK, LUMINANCE


class ImageSourceError(ValueError):
    """A buffer or tensor that isn't an image of 1, 3 or 4 channels."""


def image_from_bytes(data: bytes, width: int, height: int) -> np.ndarray:
    """[h, w, c] of bytes; the channel count follows from the length."""
    area = width * height
    if area == 0 or len(data) // area not in (1, 3, 4):
        raise ImageSourceError("UnsupportedChannelCount")
    if len(data) % area:
        raise ImageSourceError("InvalidDataLength")
    return np.frombuffer(data, np.uint8).reshape(height, width, -1)


def image_from_tensor(pixels: np.ndarray, order: str) -> np.ndarray:
    """[h, w, c] of a tensor whose order is HWC or CHW."""
    hwc = pixels if order == "HWC" else np.moveaxis(pixels, 0, 2)
    if hwc.shape[2] not in (1, 3, 4):
        raise ImageSourceError("UnsupportedChannelCount")
    return hwc


def image_from_buffer(data: bytes, width: int, height: int, order: str = "HWC", dtype: str = "uint8") -> np.ndarray:
    """[h, w, c] of the bytes or float32 of a tensor; the channel count follows from the length."""
    if order not in ("HWC", "CHW") or dtype not in ("uint8", "float32"):
        raise ImageSourceError("UnsupportedLayout")
    step = 4 if dtype == "float32" else 1
    if len(data) % step:
        raise ImageSourceError("InvalidDataLength")
    pixels = image_from_bytes(data, width * step, height).reshape(-1)
    pixels = pixels.view("<f4") if step > 1 else pixels
    return image_from_tensor(pixels.reshape((-1, height, width) if order == "CHW" else (height, width, -1)), order)


def greyscale(image: np.ndarray) -> np.ndarray:
    """[h, w, c] of bytes or of floats in [0, 1] to [h, w] of float32 around BLACK; a fourth channel is left out."""
    weights = np.array(LUMINANCE if image.shape[2] >= 3 else (1.0,), np.float32)
    if image.dtype == np.uint8:
        weights = weights / np.float32(255)
    return (image[..., : len(weights)].astype(np.float32) @ weights + np.float32(BLACK)).astype(np.float32)


def pad_to(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Padded with BLACK at the bottom and the right, if it is smaller."""
    h, w = max(0, height - image.shape[0]), max(0, width - image.shape[1])
    return np.pad(image, ((0, h), (0, w)), constant_values=np.float32(BLACK)) if h or w else image


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres at halves."""
    if image.shape == (height, width):
        return image

    def axis(new: int, old: int):
        x = np.clip((np.arange(new) + 0.5) * (old / new) - 0.5, 0, old - 1).astype(np.float32)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, old - 1), (x - low).astype(np.float32)

    y0, y1, fy = axis(height, image.shape[0])
    x0, x1, fx = axis(width, image.shape[1])
    rows = image[y0] * (1 - fy)[:, None] + image[y1] * fy[:, None]
    return (rows[:, x0] * (1 - fx) + rows[:, x1] * fx).astype(np.float32)


def draw_line(canvas: np.ndarray, start, end, colour) -> None:
    """A segment of (x, y) on [h, w, c], clipped to it."""
    n = int(max(abs(end[0] - start[0]), abs(end[1] - start[1]), 1)) + 1
    x, y = (np.rint(np.linspace(start[k], end[k], n)).astype(int) for k in (0, 1))
    ok = (x >= 0) & (y >= 0) & (x < canvas.shape[1]) & (y < canvas.shape[0])
    canvas[y[ok], x[ok]] = colour


def draw_ring(canvas: np.ndarray, ring: np.ndarray, colour) -> None:
    for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        draw_line(canvas, a, b, colour)


def to_bytes(image: np.ndarray) -> np.ndarray:
    """[0, 1] to 0..255, clamped, towards zero."""
    return (np.clip(np.nan_to_num(image), 0, 1) * 255).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """[h, w], or [h, w, c] with 1, 3 or 4 channels, of bytes as a PNG file."""
    image = image[..., None] if image.ndim == 2 else image
    kind = {1: 0, 3: 2, 4: 6}.get(image.shape[2])
    if kind is None:
        raise ValueError("a PNG has 1, 3 or 4 channels")
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image).reshape(height, -1)], axis=1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
