import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.functions import arrays as A
from foliary.functions import geometry as G
from foliary.functions import raster
from foliary.functions import text as T
from foliary.sources import images, sinks
from foliary.streaming import requests as R


def test_files_and_bytes(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    (tmp_path / "a.PNG").write_bytes(raster.png(pixels))
    (tmp_path / "bad.webp").write_bytes(b"RIFF")
    (tmp_path / "notes.txt").write_bytes(b"x")
    got = {r["image_id"].rsplit("/", 1)[1]: r for r in images.image_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.PNG", "bad.webp"} and got["bad.webp"]["error"]
    assert bytes(got["a.PNG"]["data"]) == pixels.tobytes() and (got["a.PNG"]["width"], got["a.PNG"]["height"]) == (5, 7)
    row = images.image_bytes(spark, raster.png(pixels)).first()
    assert bytes(row["data"]) == pixels.tobytes()
    assert images.drop_alpha(bytes([1, 2, 3, 9, 4, 5, 6, 9])) == bytes([1, 2, 3, 4, 5, 6])
    with pytest.raises(ValueError):
        images.decode_png(b"GIF89a")


def test_annotated_image_and_files(spark, tmp_path):
    image = np.zeros((64, 64, 3), np.uint8)
    boxes = np.array([G.upright(10, 10, 20, 30)])
    out = sinks.annotate(image, [boxes, boxes], [[(10, 10, 20, 30)], None])
    assert out.shape == (64, 64, 3) and abs(out[10, 15].astype(int) - sinks.READ_COLOURS[0]).max() <= 1
    two = np.array([G.upright(10, 10, 20, 30), G.upright(10, 40, 20, 60)])
    out = sinks.annotate(image, [boxes[:0], two], [None, None]).astype(int)
    assert abs(out[10, 15] - sinks.WORD_COLOURS[1]).max() <= 1 and abs(out[10, 35] - sinks.LINE_COLOUR).max() <= 1 and not out[15, 35].any()
    maps = spark.createDataFrame([(1, 2, 2, np.array([0.1, 0.3, 0.2, 1], "<f4").tobytes())], "image_id long, height int, width int, probability binary")
    assert sinks.write_files(sinks.probability_files(maps, 0.2), str(tmp_path)) == 1
    assert images.decode_png((tmp_path / "1.png").read_bytes())[..., 0].tolist() == [[0, 255], [0 if np.float32(0.2) <= 0.2 else 255, 255]]
    with pytest.raises(ValueError):
        raster.png(np.zeros((2, 2, 2), np.uint8))


def test_rotated_rects_of_items(spark):
    turned = G.corners(np.array([50, 40, 0.6, -0.8, 30, 10], np.float32))
    points = [[dict(zip("xy", map(float, p), strict=True)) for p in ring] for ring in (turned, turned[:1], turned[:0])] + [None]
    df = spark.createDataFrame(list(enumerate(points)), "i int, c array<struct<x:double,y:double>>")
    got = [r["b"] for r in df.select("i", T.rotated_rect("c").alias("b")).orderBy("i").collect()]
    assert np.allclose(list(got[0].asDict().values()), [50, 40, 0.6, -0.8, 30, 10], atol=1e-3) and got[1:] == [None] * 3


def test_words_are_parted_by_spaces_alone(spark):
    df = spark.createDataFrame([("foo bar  baz ",), ("a\tb c",), ("  ",), ("",)], "line string")
    rows = df.select(T.char_boxes(F.col("line")).alias("c")).select(T.words_of(F.col("c")).alias("w")).collect()
    assert [[(w["text"], w["rect"]["left"]) for w in r["w"]] for r in rows] == [[("foo", 0), ("bar", 40), ("baz", 90)], [("a\tb", 0), ("c", 40)], [], []]


def test_words_of_lines_are_those_of_their_characters(spark):
    lines = [None, "", " ", "  a  b", "é中 x ", "word", "a " * 600 + "end", "tab\tstays one"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    kept = F.transform(T.words_of(T.char_boxes(F.col("line"))), lambda w: w.dropFields("chars"))
    rows = df.select("i", "line", T.line_words("line").alias("fast"), kept.alias("plain")).collect()
    assert all(r["fast"] == r["plain"] for r in rows if r["line"] is not None)
    assert [r["fast"] for r in rows if r["line"] is None] == [None]
    assert df.limit(0).select(T.line_words("line")).count() == 0


def test_column_forms(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    lit = F.lit
    assert [one(A.source_status(lit(a), lit(w), lit(h))) for a, w, h in [(100, 10, 10), (50, 10, 10), (128, 8, 8), (0, 0, 10)]] == [None, "UnsupportedChannelCount", "UnsupportedChannelCount", "UnsupportedChannelCount"]
    shape = lambda *s: F.array(*map(lit, s))
    assert [one(A.tensor_status(shape(*s), lit(o))) for s, o in [((1, 5, 5), "CHW"), ((1, 5, 5), "HWC"), ((0, 5, 5), "CHW")]] == [None, "UnsupportedChannelCount", "UnsupportedChannelCount"]
    assert [one(A.to_byte(lit(v))) for v in (-1.0, 0.999, 2.0, float("nan"))] == [0, 254, 255, 0]
    assert [one(A.resized_width(lit(w), lit(h), 64.0)) for w, h in [(100.0, 10.0), (1.0, 64.0), (1e6, 1.0), (5.0, 0.0)]] == [640, 10, 2400, 2400]
    assert [one(A.group_width(lit(w))) for w in (10, 50, 51)] == [50, 50, 100]
    assert [one(A.file_name(lit(u))) for u in ("https://a.b/c/d.rten?x=1#y", "d.rten", "https://a.b", "https://a.b/")] == ["d.rten", None, None, None]
    assert one(A.rounded_vertices(A.corners_of(lit(-2.5), lit(0.5), lit(1.5), lit(2.4)))) == [[2, 2], [1, 2], [1, -3], [2, -3]]
    assert A.excluded_labels("abc", "b") == [1, 3] and A.excluded_labels("abc", None) == [] and len(A.DEFAULT_ALPHABET) == 96
    assert one(A.label_text(F.array(F.struct(lit(1).alias("label")), F.struct(lit(9).alias("label"))), "ab")) == "a?"


def test_requests_are_read_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "image_id long, line_idx int, request_seq long, method string"
    calls = []

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    def read(asked):
        calls.append([(r["image_id"], r["line_idx"]) for r in asked.collect()])
        return asked.select("image_id", "line_idx", "request_seq", F.lit("text").alias("text"))

    def drain():
        stream = spark.readStream.schema(schema).parquet(str(source))
        R.serve(spark, stream, read, str(out), "image_id long, line_idx int, request_seq long, text string", str(tmp_path / "ck"), available_now=True).awaitTermination(60)

    send([(1, 0, 1, "recognizeText"), (1, 1, 2, "recognizeText"), (2, 0, 3, "recognizeText"), (2, 0, 4, "cancelRecognition"), (1, 0, 5, "recognizeText")])
    drain()
    send([(1, 0, 6, "recognizeText"), (2, 0, 7, "recognizeText")])
    drain()
    assert sorted(calls[0]) == [(1, 0), (1, 1)] and calls[1] == [(2, 0)]
    results = spark.read.parquet(str(out))
    assert results.count() == results.select("image_id", "line_idx").distinct().count() == 3
    twice = results.drop("batch").union(results.drop("batch").withColumn("request_seq", F.col("request_seq") + 50))
    assert R.first_results(twice).agg(F.max("request_seq")).first()[0] == 7
