"""Where results go: text, JSON and PNG files, each written by the tasks that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions import raster
from foliary.functions import geometry as G

# Fixed values of the published pipeline: CSS colours in bytes. Lines; words by line; words that were read, by line.
LINE_COLOUR = (200, 200, 200)
WORD_COLOURS = ((255, 127, 80), (143, 188, 143), (100, 149, 237))
READ_COLOURS = ((220, 20, 60), (0, 100, 0), (0, 0, 139))
FILES = "path string, data binary"


def annotate(image: np.ndarray, lines: list[np.ndarray], read: list[list[tuple[int, int, int, int]] | None]) -> np.ndarray:
    """[h, w, 3] bytes with boxes drawn: each line's, its words' and, darker, the words' that were read.

    lines are arrays of boxes, read the words' (top, left, bottom, right) by line, None without text; a line's colour is
    by its place among all lines, so lines without text use one up.
    """
    canvas = image.astype(np.float32) / 255

    def draw(box: np.ndarray, colour: tuple[int, int, int]) -> None:
        raster.draw_ring(canvas, np.trunc(G.corners(box)), np.array(colour, np.float32) / 255)

    for boxes in lines:
        box = G.smallest_box(G.corners(boxes).reshape(-1, 2)) if len(boxes) else None
        if box is not None:
            draw(box, LINE_COLOUR)
    for k, boxes in enumerate(lines):
        for box in boxes:
            draw(box, WORD_COLOURS[k % 3])
    for k, words in enumerate(read):
        for rect in words or []:
            draw(G.upright(*rect), READ_COLOURS[k % 3])
    return raster.to_bytes(canvas)


def probability_files(maps: DataFrame, threshold: float | None = None) -> DataFrame:
    """(image_id, height, width, probability) to PNG rows: the map, or the mask of what is over a threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                values = np.frombuffer(r.probability, "<f4").reshape(r.height, r.width)
                values = values if threshold is None else (values > threshold).astype(np.float32)
                out.append((f"{r.image_id}.png", raster.png(raster.to_bytes(values))))
            yield pd.DataFrame(out, columns=["path", "data"])

    return maps.mapInPandas(run, FILES)


def line_files(images: DataFrame, height: int) -> DataFrame:
    """Line images to PNG rows lines/ID/line-N.png."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                values = np.frombuffer(r.image, "<f4").reshape(height, r.width) + np.float32(0.5)
                out.append((f"lines/{r.image_id}/line-{r.line_idx}.png", raster.png(raster.to_bytes(values))))
            yield pd.DataFrame(out, columns=["path", "data"])

    return images.mapInPandas(run, FILES)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (path, data) rows to a folder that all executors mount, and returns how many there were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            for r in b.itertuples():
                target = os.path.join(folder, r.path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write(r.data)
            yield pd.DataFrame({"n": [len(b)]})

    return files.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_text(texts: DataFrame, path: str) -> None:
    """(image_id, text) as text files, a part for each task."""
    texts.select("text").write.text(path)
