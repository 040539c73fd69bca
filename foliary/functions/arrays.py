"""Pixels, probabilities and boxes as array columns, for tables whose arrays are small; bulk pixels use numpy kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published pipeline.
BLACK = -0.5
LUMINANCE = (0.299, 0.587, 0.114)
TEXT_THRESHOLD, MIN_AREA = 0.2, 100.0
MIN_WIDTH, MAX_WIDTH, WIDTH_STEP, BATCH_ROWS = 10.0, 2400.0, 50, 20
#: Label i+1 is character i; the E after ~ stands in for a euro sign.
DEFAULT_ALPHABET = " 0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~EABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def truncate(x: Column) -> Column:
    """To an integer towards zero, within its range; NaN is 0. A bare cast raises on these in ANSI mode."""
    return F.when(F.isnan(x), 0).otherwise(F.least(F.greatest(x, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int"))


def source_status(length: Column, width: Column, height: Column) -> Column:
    """null if a buffer of bytes can be an image of 1, 3 or 4 channels, else the name of the error."""
    area = width * height
    channels = F.when(area > 0, F.floor(length / area))
    return (
        F.when(channels.isNull() | ~channels.isin(1, 3, 4), "UnsupportedChannelCount")
        .when(length % F.nullif(area, F.lit(0)) != 0, "InvalidDataLength")
        .otherwise(F.lit(None).cast("string"))
    )


def tensor_status(shape: Column, order: Column) -> Column:
    channels = F.when(order == "HWC", F.get(shape, F.lit(2))).otherwise(F.get(shape, F.lit(0)))
    return F.when(channels.isin(1, 3, 4), F.lit(None).cast("string")).otherwise("UnsupportedChannelCount")


def greyscale(pixels: Column, channels: int, bytes_scale: bool = False) -> Column:
    """Interleaved pixels to BLACK + luminance; the fourth channel is left out, one channel is taken as it is."""
    weights = [w / 255 if bytes_scale else w for w in (LUMINANCE if channels >= 3 else (1.0,))]

    def one(i):
        total = F.lit(BLACK)
        for c, w in enumerate(weights):
            total = total + F.get(pixels, i * channels + c).cast("double") * F.lit(w)
        return total

    count = F.floor(F.size(pixels) / channels).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<double>"))


def text_mask(probabilities: Column, threshold: float = TEXT_THRESHOLD) -> Column:
    return F.transform(probabilities, lambda p: (p > threshold).cast("int"))


def to_byte(x: Column) -> Column:
    """[0, 1] to 0..255, clamped, towards zero; NaN is 0."""
    return F.when(F.isnan(x), 0).otherwise((F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def resized_width(width: Column, height: Column, target_height: float) -> Column:
    """Width of a line scaled to the recogniser's height, whole, within bounds; a line without height gets the largest."""
    scaled = F.when(height > 0, F.lit(target_height) * (width / F.nullif(height, F.lit(0.0)))).otherwise(MAX_WIDTH)
    return F.least(F.greatest(scaled, F.lit(MIN_WIDTH)), F.lit(MAX_WIDTH)).cast("int")


def group_width(width: Column) -> Column:
    """The next multiple of WIDTH_STEP."""
    return (F.ceil(width / WIDTH_STEP) * WIDTH_STEP).cast("int")


def steps_of(logits: Column, classes: int) -> Column:
    """A flat array to an array of steps of class scores."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(logits) / classes).cast("int") - 1), lambda i: F.slice(logits, i * classes + 1, classes))


def excluded_labels(alphabet: str, allowed: str | None) -> list[int]:
    """Labels of characters that aren't allowed; the blank is never excluded."""
    return [] if allowed is None else [i + 1 for i, c in enumerate(alphabet) if c not in allowed]


def mask_labels(steps: Column, excluded: list[int]) -> Column:
    if not excluded:
        return steps
    labels = F.array(*map(F.lit, excluded))
    return F.transform(steps, lambda row: F.transform(row, lambda v, i: F.when(F.array_contains(labels, i), F.lit(float("-inf"))).otherwise(v)))


def ctc_greedy(steps: Column) -> Column:
    """array<struct<label, pos>>: the first best class of each step; of a run its first step; blanks left out."""
    best = F.transform(steps, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)
    marked = F.transform(best, lambda x, i: F.struct(x.alias("label"), i.alias("pos"), F.get(best, i - 1).alias("before")))
    kept = F.filter(marked, lambda x: (x["label"] != 0) & (F.coalesce(x["before"], F.lit(0)) != x["label"]))
    return F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["pos"].alias("pos")))


def label_text(steps: Column, alphabet: str) -> Column:
    """Characters of decoded steps; a label beyond the alphabet is a question mark."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    return F.array_join(F.transform(steps, lambda x: F.coalesce(F.get(letters, x["label"] - 1), F.lit("?"))), "")


def step_spans(steps: Column, left: Column, resized: Column, factor: Column, scale: Column) -> Column:
    """array<struct<label, start, end>> in image columns; a step ends where the next begins, the last at the resized width."""

    def place(pos):
        return left + truncate(pos * factor * scale)

    return F.transform(
        steps,
        lambda x, i: F.struct(
            x["label"].alias("label"), place(x["pos"]).alias("start"),
            (left + truncate(F.coalesce(F.get(steps, i + 1)["pos"] * factor, resized) * scale)).alias("end"),
        ),
    )


def corners_of(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """array<struct<x, y>> of an upright box: bottom right, bottom left, top left, top right."""
    points = [(right, bottom), (left, bottom), (left, top), (right, top)]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def rounded_vertices(corners: Column) -> Column:
    """[x, y] of each of the four corners, halves away from zero.

    Each corner is named, so that what takes only some of them is compiled to their numbers alone.
    """
    return F.array(*[F.array(*[F.round(F.get(corners, F.lit(i))[c]).cast("int") for c in ("x", "y")]) for i in range(4)])


def flat_corners(corners: Column) -> Column:
    return F.flatten(F.transform(corners, lambda p: F.array(p["x"], p["y"])))


def upright_box(corners: Column) -> Column:
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return F.struct(F.array_min(ys).alias("top"), F.array_min(xs).alias("left"), F.array_max(ys).alias("bottom"), F.array_max(xs).alias("right"))


def upper_median(values: Column) -> Column:
    """The element at half the size of the sorted array, null of an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def file_name(url: Column) -> Column:
    """Last path segment of a URL without query and fragment; null without a scheme or a segment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def in_box(x: Column, y: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Left and top belong to a box (top, left, bottom, right), bottom and right don't."""
    top, left, bottom, right = box
    return (x >= left) & (x < right) & (y >= top) & (y < bottom)


def zoomed(corners: Column, zoom: Column) -> Column:
    """Corners on a page that is shown at a zoom, as places on the page itself."""
    return F.transform(corners, lambda p: F.struct((p["x"] / zoom).alias("x"), (p["y"] / zoom).alias("y")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Is the point in a polygon, array<struct<x, y>>: an odd number of its edges lies at or left of it."""
    size = F.size(ring)

    def met(p, i):
        q = F.get(ring, (i + 1) % size)
        at = p["x"] + (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (q["x"] - p["x"])
        return ((p["y"] <= y) != (q["y"] <= y)) & (at <= x)

    edges = F.transform(ring, lambda p, i: F.when(met(p, i), 1))
    return F.size(F.filter(edges, lambda e: e.isNotNull())) % 2 == 1
