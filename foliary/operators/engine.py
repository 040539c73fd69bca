"""Text of images as DataFrames: each step takes and returns one, and may be used alone.

A page is a row until its line images are cut, which then are rows. get_text does so in the task that has the page;
of the single steps, line_images moves a page's pixels to its lines once. Lines without text keep their row, with nulls,
until the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions import arrays as A
from foliary.functions import raster
from foliary.functions import text as T
from foliary.operators import components, layout, recognition
from foliary.operators.models import Model

BOX = "struct<cx:float,cy:float,ux:float,uy:float,w:float,h:float>"
RECT = "struct<top:int,left:int,bottom:int,right:int>"
CHARS = f"array<struct<ch:string,rect:{RECT}>>"
FIELDS = ["cx", "cy", "ux", "uy", "w", "h"]
LINE_IMAGES = "line_idx int, ring array<int>, width int, group_width int, image binary"
#: Bytes of line images that a task keeps until it has enough of one width.
HELD = 1 << 26


@dataclass(frozen=True)
class PageReader:
    """detection and recognition: models, where their steps are used; beam: width of the search, None for greedy decoding."""

    detection: Model | None = None
    recognition: Model | None = None
    alphabet: str = A.DEFAULT_ALPHABET
    allowed_chars: str | None = None
    beam: int | None = None
    text_threshold: float = A.TEXT_THRESHOLD
    min_area: float = A.MIN_AREA

    def prepare_input(self, images: DataFrame) -> DataFrame:
        """images (image_id, data binary, width, height) to (image_id, height, width, grey, error).

        data holds rows of interleaved bytes; with a column order, "CHW" stands for a plane for each channel, and with a
        column dtype, "float32" for little-endian floats in [0, 1]; null in these is "HWC" and "uint8". What isn't an
        image of 1, 3 or 4 channels has a null grey and an error.
        """
        names = ["image_id", "data", "width", "height", "order", "dtype"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                grey, error = [], []
                for _, data, width, height, order, dtype in zip(*[b[c] for c in names], strict=True):
                    try:
                        image = raster.image_from_buffer(bytes(data), int(width), int(height), order or "HWC", dtype or "uint8")
                        grey.append(raster.greyscale(image).astype("<f4").tobytes())
                        error.append(None)
                    except (raster.ImageSourceError, TypeError, ValueError) as e:
                        grey.append(None)
                        error.append(str(e))
                yield pd.DataFrame({"image_id": b["image_id"], "height": b["height"], "width": b["width"], "grey": grey, "error": error})

        absent = F.lit(None).cast("string")
        layout_of = [F.col(c) if c in images.columns else absent.alias(c) for c in ("order", "dtype")]
        kept = images.select("image_id", F.col("data"), F.col("width").cast("int"), F.col("height").cast("int"), *layout_of)
        kind = kept.schema["image_id"].dataType.simpleString()
        return kept.mapInPandas(run, f"image_id {kind}, height int, width int, grey binary, error string")

    def detect_text_pixels(self, inputs: DataFrame) -> DataFrame:
        """(image_id, height, width, probability binary): float32 of each pixel."""
        model = self._need(self.detection, "detection")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                maps = [recognition.text_pixels(model, _grey(r)).astype("<f4").tobytes() for r in b.itertuples()]
                yield pd.DataFrame({"image_id": b["image_id"], "height": b["height"], "width": b["width"], "probability": maps})

        rows = inputs.where("grey is not null").select("image_id", "height", "width", "grey")
        return rows.mapInPandas(run, f"image_id {self._key(inputs)}, height int, width int, probability binary")

    def detect_words(self, inputs: DataFrame) -> DataFrame:
        """(image_id, word_idx, box); word_idx is the order of the words' first pixels."""
        threshold, area = self.text_threshold, self.min_area

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    found = components.word_boxes(np.frombuffer(r.probability, "<f4").reshape(r.height, r.width) > threshold, area)
                    yield pd.DataFrame({"image_id": [r.image_id] * len(found), "word_idx": range(len(found)), **{f: found[:, i] for i, f in enumerate(FIELDS)}})

        flat = ", ".join(f"{f} float" for f in FIELDS)
        words = self.detect_text_pixels(inputs).mapInPandas(run, f"image_id {self._key(inputs)}, word_idx int, {flat}")
        return words.select("image_id", "word_idx", F.struct(*FIELDS).alias("box"))

    def find_text_lines(self, words: DataFrame) -> DataFrame:
        """words (image_id, word_idx, box) to (image_id, para_idx, line_idx, words array of boxes), in reading order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                images, pages = batch.columns
                box = pages.flatten().field("box")
                values = np.stack([box.field(f).to_numpy(zero_copy_only=False) for f in FIELDS], axis=1) if len(box) else np.zeros((0, 6), np.float32)
                sizes = pages.value_lengths().to_numpy()
                starts = (np.cumsum(sizes) - sizes).tolist()
                page, para, line, order, offsets = [], [], [], [], [0]
                for k, (s, found) in enumerate(zip(starts, layout.reading_orders(values, sizes), strict=True)):
                    for p, i, words in found:
                        page.append(k)
                        para.append(p)
                        line.append(i)
                        order += [s + w for w in words]
                        offsets.append(len(order))
                lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), box.take(pa.array(order, pa.int64())))
                columns = [images.take(pa.array(page, pa.int64())), pa.array(para, pa.int32()), pa.array(line, pa.int32()), lines]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "para_idx", "line_idx", "words"])

        # One row for each page, many pages in a batch: a call for each page would cost more than its layout.
        pages = spread(words, "image_id").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", "box"))).alias("words"))
        return pages.mapInArrow(run, f"image_id {self._key(words)}, para_idx int, line_idx int, words array<{BOX}>")

    def line_images(self, inputs: DataFrame, lines: DataFrame) -> DataFrame:
        """(image_id, line_idx, ring, width, group_width, image): each line's polygon and its pixels at the model's height.

        A line without words, or of a page without pixels, keeps its row with nulls. The lines of a page are one row when
        they meet its pixels, so these are moved once.
        """
        height = recognition.line_height(self._need(self.recognition, "recognition"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, pages = batch.column("image_id"), _greys(batch)
                for k, (grey, lines) in enumerate(zip(pages, batch.column("lines"), strict=True)):
                    found = []
                    for line in lines.as_py():
                        boxes = np.array([[w[f] for f in FIELDS] for w in line["words"] or []], np.float32)
                        found.append((line["line_idx"], *_cut(grey, boxes, height)))
                    yield _line_batch(ids, k, found)

        whole = lines.groupBy("image_id").agg(F.collect_list(F.struct("line_idx", "words")).alias("lines"))
        rows = whole.join(inputs.select("image_id", "height", "grey"), "image_id", "left")
        return rows.select("image_id", "height", "grey", "lines").mapInArrow(run, f"image_id {self._key(lines)}, {LINE_IMAGES}")

    def page_lines(self, inputs: DataFrame) -> DataFrame:
        """line_images of the lines that are found on each page, all of a page's steps in one task: no pixels are shuffled.

        A page without lines, or without pixels, has one row of nulls.
        """
        detector, threshold, area = self._need(self.detection, "detection"), self.text_threshold, self.min_area
        height = recognition.line_height(self._need(self.recognition, "recognition"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("image_id")
                for k, grey in enumerate(_greys(batch)):
                    found = []
                    if grey is not None:
                        boxes = components.word_boxes(recognition.text_pixels(detector, grey).astype(np.float32) > threshold, area)
                        found = [(line, *_cut(grey, boxes[words], height)) for _, line, words in layout.reading_order(boxes)]
                    yield _line_batch(ids, k, found or [(None,) * 5])

        return inputs.select("image_id", "height", "grey").mapInArrow(run, f"image_id {self._key(inputs)}, {LINE_IMAGES}")

    def read_line_images(self, images: DataFrame) -> DataFrame:
        """line_images to (image_id, line_idx, text, chars); text and chars are null where nothing was read.

        Lines of like width are read together, whichever pages of a task they are of; a line's result doesn't depend on
        the others. No more than HELD bytes of lines wait for others of their width.
        """
        model, alphabet, beam = self._need(self.recognition, "recognition"), self.alphabet, self.beam
        height, excluded = recognition.line_height(model), A.excluded_labels(alphabet, self.allowed_chars)

        def read(rows: list[tuple], wide: int) -> list[tuple]:
            images = [np.frombuffer(r[4], "<f4").reshape(height, r[3]) for r in rows]
            scores = recognition.recognise(model, recognition.stack_lines(images, wide), len(alphabet) + 1)
            out = []
            for (image_id, line, ring, width, _), s in zip(rows, scores, strict=True):
                steps = recognition.decode(s, excluded, beam)
                chars = recognition.place_characters(steps, np.array(ring).reshape(-1, 2), width, wide, len(s), alphabet)
                boxes = [{"ch": c, "rect": dict(zip(("top", "left", "bottom", "right"), b, strict=True)) if b else None} for c, b in chars]
                out.append((image_id, line, boxes or None))
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: dict[int, list[tuple]] = {}
            for batch in batches:
                done = []
                kind = batch.column("image_id").type
                columns = [batch.column(c).to_pylist() for c in ("image_id", "line_idx", "ring", "width", "image", "group_width")]
                for *row, wide in zip(*columns, strict=True):
                    if wide is None:
                        done.append((*row[:2], None))
                        continue
                    waiting.setdefault(wide, []).append(tuple(row))
                    if len(waiting[wide]) == A.BATCH_ROWS:
                        done += read(waiting.pop(wide), wide)
                    while sum(w * len(rows) for w, rows in waiting.items()) * height * 4 > HELD:
                        most = max(waiting, key=lambda w: w * len(waiting[w]))
                        done += read(waiting.pop(most), most)
                yield _read_batch(done, kind)
            for wide, rows in waiting.items():
                yield _read_batch(read(rows, wide), kind)

        found = images.select("image_id", "line_idx", "ring", "width", "group_width", "image")
        read_rows = found.mapInArrow(run, f"image_id {self._key(images)}, line_idx int, chars {CHARS}")
        return read_rows.select("image_id", "line_idx", F.when(F.col("chars").isNotNull(), T.text_of(F.col("chars"))).alias("text"), "chars")

    def recognize_text(self, inputs: DataFrame, lines: DataFrame) -> DataFrame:
        """(image_id, line_idx, text, chars): a row for each line; text and chars are null where nothing was read."""
        return self.read_line_images(self.line_images(inputs, lines))

    def get_text(self, images: DataFrame) -> DataFrame:
        """images to (image_id, text): lines in reading order, joined by newlines; empty where nothing was read.

        Only texts are shuffled. image_id names a page: rows of one id have one text.
        """
        return join_text(self.read_line_images(self.page_lines(self.prepare_input(images))))

    def get_text_lines(self, images: DataFrame) -> DataFrame:
        """images to (image_id, lines): array of (text, chars) in reading order, as null members where nothing was read."""
        read = self.read_line_images(self.page_lines(self.prepare_input(images)))
        line = F.struct("line_idx", F.when(F.col("text").isNotNull(), F.struct("text", "chars")).alias("line"))
        lines = F.array_sort(F.collect_list(F.when(F.col("line_idx").isNotNull(), line)))
        return read.groupBy("image_id").agg(F.transform(lines, lambda x: x["line"]).alias("lines"))

    def recognition_input(self, grey: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """What recognition sees of one line: its [height, width] image. For looking into what was read wrongly."""
        height = recognition.line_height(self._need(self.recognition, "recognition"))
        _, width, _, image = _cut(grey, np.asarray(boxes, np.float32), height)
        return np.frombuffer(image, "<f4").reshape(height, width)

    @staticmethod
    def _need(model: Model | None, name: str) -> Model:
        if model is None:
            raise ValueError(f"no {name} model is loaded")
        return model

    @staticmethod
    def _key(df: DataFrame) -> str:
        return df.schema["image_id"].dataType.simpleString()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to as many tasks as a shuffle has partitions.

    With a number of its own a shuffle isn't coalesced for the few bytes it has: what follows costs time, not bytes. A
    groupBy on key needs no other shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _grey(row) -> np.ndarray:
    size = len(row.grey) // 4
    return np.frombuffer(row.grey, "<f4").reshape(row.height, size // row.height)


def _greys(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """The pixels of each page of a batch, as they lie in it; None without any."""
    for height, grey in zip(batch.column("height").to_pylist(), batch.column("grey"), strict=True):
        yield np.frombuffer(grey.as_buffer(), "<f4").reshape(height, -1) if grey.is_valid and height else None


def _cut(grey: np.ndarray | None, boxes: np.ndarray, height: int) -> tuple:
    """(ring, width, group_width, image) of a line of boxes, all None without boxes or pixels."""
    if grey is None or not len(boxes):
        return (None,) * 4
    top, left, bottom, right = layout.G.union(layout.G.bounds(boxes))
    ring = recognition.line_polygon(boxes)
    width = recognition.resized_width(right - left, bottom - top, height)
    image = recognition.line_image(grey, ring, height, width).astype("<f4").tobytes()
    return ring.flatten().tolist(), width, recognition.group_width(width), image


def _line_batch(ids: pa.Array, page: int, lines: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)]
    pages = ids.take(pa.array([page] * len(lines), pa.int64()))
    return pa.RecordBatch.from_arrays([pages, *columns], names=["image_id", "line_idx", "ring", "width", "group_width", "image"])


def _read_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    rect = pa.struct([(side, pa.int32()) for side in ("top", "left", "bottom", "right")])
    kinds = [kind, pa.int32(), pa.list_(pa.struct([("ch", pa.string()), ("rect", rect)]))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["image_id", "line_idx", "chars"])


def join_text(read: DataFrame) -> DataFrame:
    """(image_id, line_idx, text) to (image_id, text)."""
    lines = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line_idx", "text"))))
    return read.groupBy("image_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def document_trees(pages: DataFrame, read: DataFrame) -> DataFrame:
    """pages (image_id, url, width, height) and lines to (image_id, document): JSON of one paragraph with lines and words.

    A page without text has a paragraph without lines. Vertices are whole [x, y], halves rounded away from zero.
    """

    def vertices(rect):
        return A.rounded_vertices(A.corners_of(rect["top"], rect["left"], rect["bottom"], rect["right"]))

    words = F.transform("words", lambda w: F.struct(w["text"].alias("text"), vertices(w["rect"]).alias("vertices")))
    line = F.struct("text", vertices(T.bounding_rect(F.col("chars"))).alias("vertices"), words.alias("words"))
    rows = read.where("text is not null").withColumn("words", T.words_of(F.col("chars"))).select("image_id", F.struct("line_idx", line.alias("line")).alias("x"))
    lines = rows.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("lines"))
    kind = lines.schema["lines"].dataType
    joined = pages.join(lines, "image_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(kind)))
    tree = F.struct("url", F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.array(F.struct("lines")).alias("paragraphs"))
    return joined.select("image_id", F.to_json(tree, {"pretty": "true"}).alias("document"))
