"""Text items as columns: characters, words and lines with boxes. All narrow: no shuffle; line_words, document_lines, char_extent and rotated_rect use Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from foliary.functions import geometry as G

#: Size of a character's box on the grid that plain text is laid out on.
CHAR_WIDTH, CHAR_HEIGHT = 10, 25


def characters(line: Column) -> Column:
    """Code points of a line; an empty line has none."""
    return F.when(F.length(line) > 0, F.split(line, "")).otherwise(F.array().cast("array<string>"))


def char_boxes(line: Column) -> Column:
    """array<struct<ch, rect>>: character i at left CHAR_WIDTH * i."""
    return F.transform(
        characters(line),
        lambda c, i: F.struct(
            c.alias("ch"),
            F.struct(
                F.lit(0).alias("top"), (i * CHAR_WIDTH).alias("left"), F.lit(CHAR_HEIGHT).alias("bottom"), ((i + 1) * CHAR_WIDTH).alias("right")
            ).alias("rect"),
        ),
    )


def bounding_rect(items: Column) -> Column:
    """The union of the rects of an array of items, null if there are none."""

    def over(best, side):
        return best(F.transform(items, lambda x: x["rect"][side])).alias(side)

    low, high = F.array_min, F.array_max
    return F.when(F.size(items) > 0, F.struct(over(low, "top"), over(low, "left"), over(high, "bottom"), over(high, "right")))


def text_of(items: Column) -> Column:
    """The characters of a line as a string."""
    return F.array_join(F.transform(items, lambda x: x["ch"]), "")


def words_of(chars: Column) -> Column:
    """array<struct<text, rect, chars>>: runs between spaces (U+0020 alone), empty ones left out."""
    size = F.size(chars)
    spaces = F.filter(F.transform(chars, lambda c, i: F.when(c["ch"] == " ", i)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.transform(spaces, lambda i: i + 1))
    ends = F.concat(spaces, F.array(size))
    spans = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: x["e"] > x["s"])

    def word(x):
        part = F.slice(chars, x["s"] + 1, x["e"] - x["s"])
        return F.struct(text_of(part).alias("text"), bounding_rect(part).alias("rect"), part.alias("chars"))

    return F.transform(spans, word)


RECT = StructType([StructField(side, IntegerType()) for side in ("top", "left", "bottom", "right")])
WORDS = ArrayType(StructType([StructField("text", StringType()), StructField("rect", RECT)]))


@F.arrow_udf(WORDS)
def line_words(lines: pa.Array) -> pa.Array:
    """Words of each line on the grid, as words_of its char_boxes but without making the characters.

    A word's place is a running sum over its line. Expressions have none but by an aggregate, which copies its state at
    each step: many times slower than an Arrow batch at once. A null line has null words.
    """
    return placed_words(lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines)


def placed_words(lines: pa.Array) -> pa.Array:
    parts = pc.split_pattern(lines, " ")
    texts = parts.flatten()
    size = pc.utf8_length(texts).to_numpy()
    count = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
    end = np.cumsum(count)
    left = np.cumsum(size + 1) - size - 1
    first = left[np.minimum(end - count, max(0, len(left) - 1))] if len(left) else np.zeros(len(count), np.int64)
    left = left - np.repeat(first, count)
    full = np.flatnonzero(size)
    kept = np.searchsorted(full, np.concatenate([[0], end]))
    left, right = left[full] * CHAR_WIDTH, (left[full] + size[full]) * CHAR_WIDTH
    sides = {"top": np.zeros(len(full)), "left": left, "bottom": np.full(len(full), CHAR_HEIGHT), "right": right}
    rects = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in sides.values()], names=list(sides))
    words = pa.StructArray.from_arrays([texts.take(pa.array(full)), rects], names=["text", "rect"])
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words, mask=pc.is_null(lines))


#: Bytes of text that are turned into words at once.
TEXT_BYTES = 1 << 22
LINES = "array<struct<line_idx:int,text:string,words:array<struct<text:string,rect:struct<top:int,left:int,bottom:int,right:int>>>>>"


def document_lines(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) to (doc_id, lines): the non-empty lines of each with their words; null without a text.

    A document stays a row, so nothing is shuffled to bring its lines together again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT_BYTES)) + 1).tolist(), len(sizes)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                yield pa.RecordBatch.from_arrays([ids.slice(s, e - s), placed_lines(texts.slice(s, e - s))], names=["doc_id", "lines"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, lines {LINES}")


def placed_lines(texts: pa.Array) -> pa.Array:
    parts = pc.split_pattern(texts, "\n")
    lines = parts.flatten()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy())
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    full = np.flatnonzero(pc.binary_length(lines).to_numpy())
    place = full - starts[np.searchsorted(ends, full, side="right")] if len(full) else full
    kept = lines.take(pa.array(full))
    items = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), kept, placed_words(kept)], names=["line_idx", "text", "words"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(full, np.concatenate([[0], ends])), pa.int32()), items, mask=pc.is_null(texts))


def placed_chars(lines: pa.Array) -> pa.ListArray:
    """char_boxes of lines of Arrow, none of them null."""
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = lines.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])) if at[-1] > at[0] else pa.py_buffer(b"")
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    ends = np.searchsorted(starts, at - at[0])
    count = np.diff(ends)
    texts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, at[-1] - at[0]).astype(np.int32)), data)
    left = ((np.arange(len(starts)) - np.repeat(ends[:-1], count)) * CHAR_WIDTH).astype(np.int32)
    sides = [np.zeros(len(starts), np.int32), left, np.full(len(starts), CHAR_HEIGHT, np.int32), left + np.int32(CHAR_WIDTH)]
    rects = pa.StructArray.from_arrays(list(map(pa.array, sides)), names=RECT.names)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([texts, rects], names=["ch", "rect"]))


EXTENT = StructType([StructField("n", IntegerType()), StructField("first", StringType()), StructField("last", StringType()), StructField("rect", RECT), StructField("sum_left", LongType())])
#: Bytes of lines whose characters are held at once.
CHARS_BYTES = 1 << 20


@F.arrow_udf(EXTENT)
def char_extent(lines: pa.Array) -> pa.Array:
    """Of the characters of each line with their boxes: number, first, last, bounding rect and the sum of their left sides.

    The characters, many times larger than the text, stay in the batch. A null line is null; one without characters has
    neither first nor last nor a rect.
    """
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    full = pc.fill_null(lines.cast(pa.string()), "")
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(pc.binary_length(full).to_numpy()) // CHARS_BYTES)) + 1).tolist(), len(full)]
    parts = [_extent(full.slice(s, e - s)) for s, e in zip(cuts, cuts[1:], strict=False)]
    columns = [pa.concat_arrays(c) for c in zip(*parts, strict=True)]
    return pa.StructArray.from_arrays(columns, names=EXTENT.names, mask=pc.is_null(lines))


def _extent(lines: pa.Array) -> list[pa.Array]:
    chars = placed_chars(lines)
    ends = chars.offsets.to_numpy()
    texts, rects = chars.values.field("ch"), chars.values.field("rect")
    count = np.diff(ends)
    some = count > 0
    at = ends[:-1][some]
    sides = []
    for side, best in zip(RECT.names, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True):
        values = np.zeros(len(count), np.int32)
        values[some] = best.reduceat(rects.field(side).to_numpy(), at) if len(at) else 0
        sides.append(pa.array(values))
    total = np.concatenate([[0], np.cumsum(rects.field("left").to_numpy(), dtype=np.int64)])
    first, last = (texts.take(pa.array(i, mask=~some)) for i in (ends[:-1], ends[1:] - 1))
    rect = pa.StructArray.from_arrays(sides, names=RECT.names, mask=pa.array(~some))
    return [pa.array(count.astype(np.int32)), first, last, rect, pa.array(total[ends[1:]] - total[ends[:-1]])]


BOX = StructType([StructField(f, FloatType()) for f in G.BOX_FIELDS])


@F.arrow_udf(BOX)
def rotated_rect(points: pa.Array) -> pa.Array:
    """The box of least area around each row's corners, array<struct<x, y>>, its up axis as near to upwards as it can be.

    Null without an area. Of items that share a line, give the corners of all.
    """
    if isinstance(points, pa.ChunkedArray):
        points = points.combine_chunks()
    flat = points.flatten()
    xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)
    sizes = pc.fill_null(pc.list_value_length(points), 0).to_numpy()
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), len(G.BOX_FIELDS)), np.float32)
    found = np.zeros(len(sizes), bool)
    four = np.flatnonzero(sizes == 4)
    upright, boxes = G.upright_boxes(xy[starts[four][:, None] + np.arange(4)])
    out[four[upright]], found[four[upright]] = boxes, True
    other = sizes > 0
    other[four[upright]] = False
    for k in np.flatnonzero(other).tolist():
        box = G.smallest_box(xy[starts[k] : starts[k] + sizes[k]])
        if box is not None:
            out[k], found[k] = box, True
    return pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(out.T)], names=list(G.BOX_FIELDS), mask=pa.array(~found))


def text_or_empty(text: Column) -> Column:
    """The text of a line, empty where nothing was read."""
    return F.coalesce(text, F.lit(""))


def words_or_empty(words: Column) -> Column:
    """The words of a line, none where nothing was read."""
    return F.coalesce(words, F.array())


def by_width(lines: Column) -> Column:
    """Lines, array<struct<rect, ...>>, from narrow to wide; equal ones keep their order."""
    width = F.transform(lines, lambda x, i: F.struct((x["rect"]["right"] - x["rect"]["left"]).alias("w"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(width), lambda x: x["x"])


def upright_tree(lines: Column, texts: bool = False) -> Column:
    """JSON of lines, array<struct<text, words>>: each word's [left, top, right, bottom], and the texts if wanted."""

    def word(w):
        rect = F.array(*[w["rect"][side] for side in ("left", "top", "right", "bottom")]).alias("rect")
        return F.struct(w["text"].alias("text"), rect) if texts else F.struct(rect)

    def line(x):
        words = F.transform(words_or_empty(x["words"]), word).alias("words")
        return F.struct(text_or_empty(x["text"]).alias("text"), words) if texts else F.struct(words)

    return F.to_json(F.struct(F.transform(lines, line).alias("lines")))


def lines_of(text: Column) -> Column:
    """Lines of a document; null for the empty ones, which keep their place."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) > 0, x))


def join_lines(lines: Column) -> Column:
    """Lines joined by newlines, without the null ones and without a newline at the end."""
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def contains_folded(haystack: Column, needle: str) -> Column:
    return F.contains(F.lower(haystack), F.lit(needle.lower()))


def more_than_one_byte(text: Column) -> Column:
    """Lines of one byte are mostly noise; an accented letter alone has two and stays."""
    return F.octet_length(text) > 1
