"""Lines of words to text: line images, batches of like width, decoding and character boxes."""

from __future__ import annotations

import numpy as np

from foliary.functions import ctc, raster
from foliary.functions import geometry as G
from foliary.functions.arrays import BLACK, MAX_WIDTH, MIN_WIDTH, WIDTH_STEP
from foliary.operators.models import Model, ModelRunError, WrongOutput

DEFAULT_LINE_HEIGHT = 50


def run_model(model: Model, tensor: np.ndarray, rank: int) -> np.ndarray:
    try:
        out = np.asarray(model.run(tensor))
    except Exception as e:
        raise ModelRunError(str(e)) from e
    if out.ndim != rank:
        raise WrongOutput(f"the output has {out.ndim} dimensions, not {rank}")
    return out


def text_pixels(model: Model, grey: np.ndarray) -> np.ndarray:
    """[h, w] text probabilities of a grey image: padded and resized to the model's input, and back."""
    height, width = (int(x) for x in model.input_shape()[2:4])
    padded = raster.pad_to(grey, height, width)
    fitted = raster.resize(padded, height, width)
    out = run_model(model, fitted[None, None].astype(np.float32), 4)[0, 0]
    return raster.resize(raster.resize(out, *padded.shape)[: grey.shape[0], : grey.shape[1]], *grey.shape)


def line_height(model: Model) -> int:
    size = model.input_shape()[2]
    return size if isinstance(size, int) else DEFAULT_LINE_HEIGHT


def line_polygon(boxes: np.ndarray) -> np.ndarray:
    """Whole (x, y) points along the upper ends of the words' sides from left to right, and back along the lower ones."""
    left, right = G.edges_by_x(boxes)
    sides = np.stack([left, right], axis=1).reshape(-1, 2, 2)
    low_first = np.argsort(sides[..., 1], axis=1, kind="stable")
    sides = np.take_along_axis(sides, low_first[..., None], axis=1)
    return np.trunc(np.concatenate([sides[:, 0], sides[::-1, 1]])).astype(int)


def resized_width(width: float, height: float, target: int) -> int:
    scaled = np.float32(target) * (np.float32(width) / np.float32(height)) if height > 0 else np.float32(MAX_WIDTH)
    return int(np.clip(scaled, MIN_WIDTH, MAX_WIDTH))


def group_width(width: int) -> int:
    return -(-width // WIDTH_STEP) * WIDTH_STEP


def line_image(grey: np.ndarray, ring: np.ndarray, height: int, width: int) -> np.ndarray:
    """The pixels within a ring on a ground of BLACK, resized. Pixels beyond the page's size stay ground."""
    left, top = ring.min(axis=0)
    right, bottom = ring.max(axis=0)
    canvas = np.full((max(1, bottom - top), max(1, right - left)), np.float32(BLACK))
    y, x = G.polygon_pixels(ring)
    to_y, to_x = y - top, x - left
    # A line's own place is held against the page too, as published; it matters for lines larger than the page.
    ok = (y >= 0) & (x >= 0) & (y < grey.shape[0]) & (x < grey.shape[1]) & (to_y < grey.shape[0]) & (to_x < grey.shape[1])
    ok &= (to_y < canvas.shape[0]) & (to_x < canvas.shape[1])
    canvas[to_y[ok], to_x[ok]] = grey[y[ok], x[ok]]
    return raster.resize(canvas, height, width)


def stack_lines(images: list[np.ndarray], width: int) -> np.ndarray:
    """NCHW batch of line images, padded with BLACK at the right."""
    return np.stack([np.pad(i, ((0, 0), (0, width - i.shape[1])), constant_values=np.float32(BLACK)) for i in images])[:, None]


def recognise(model: Model, batch: np.ndarray, classes: int) -> np.ndarray:
    """[n, steps, classes] log probabilities of a batch; classes is the alphabet's size and the blank."""
    out = run_model(model, batch.astype(np.float32), 3).transpose(1, 0, 2)
    if out.shape[2] != classes:
        raise WrongOutput(f"the model has {out.shape[2]} classes; the alphabet and the blank make {classes}")
    return out


def decode(scores: np.ndarray, excluded: list[int], beam: int | None) -> list[tuple[int, int]]:
    scores = ctc.mask(scores, excluded)
    return ctc.beam(scores, beam) if beam else ctc.greedy(scores)


def place_characters(
    steps: list[tuple[int, int]], ring: np.ndarray, width: int, input_width: int, n_steps: int, alphabet: str
) -> list[tuple[str, tuple[int, int, int, int] | None]]:
    """(character, box) of each decoded step on the page; steps in the padding are left out.

    A box is None where the ring has no part between its sides. width: of the line image, input_width: with padding.
    """
    left, right = int(ring[:, 0].min()), int(ring[:, 0].max())
    scale = np.float32(right - left) / np.float32(width)
    factor = int(np.floor(input_width / n_steps + 0.5))
    out = []
    for i, (label, pos) in enumerate(steps):
        assert label >= 1, "the decoder returned a blank"
        end = steps[i + 1][1] * factor if i + 1 < len(steps) else width
        x0, x1 = (left + int(np.float32(x) * scale) for x in (pos * factor, end))
        if x0 < right:
            out.append((alphabet[label - 1] if label <= len(alphabet) else "?", G.slice_bounds(ring, x0, x1)))
    return out
