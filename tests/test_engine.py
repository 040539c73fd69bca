import json
import random

import numpy as np
import pytest

from foliary.functions import arrays as A
from foliary.functions import ctc, raster
from foliary.functions import geometry as G
from foliary.operators import components, layout, recognition
from foliary.operators.engine import PageReader, document_trees, join_text
from foliary.operators.models import StandInDetector, StandInRecogniser, WrongOutput


def grid(top, left, rows, cols, h, w, gap_h, gap_w):
    return [(top + r * (h + gap_h), left + c * (w + gap_w), top + r * (h + gap_h) + h, left + c * (w + gap_w) + w) for r in range(rows) for c in range(cols)]


def boxes(rects):
    return np.array([G.upright(*r) for r in rects], np.float32).reshape(-1, 6)


@pytest.mark.parametrize("size,w,h,error", [(100, 10, 10, None), (50, 10, 10, "UnsupportedChannelCount"), (128, 8, 8, "UnsupportedChannelCount"), (150, 10, 10, "InvalidDataLength"), (0, 0, 10, "UnsupportedChannelCount")])
def test_byte_sources(size, w, h, error):
    if error:
        with pytest.raises(raster.ImageSourceError, match=error):
            raster.image_from_bytes(bytes(size), w, h)
    else:
        assert raster.image_from_bytes(bytes(size), w, h).shape == (h, w, size // (w * h))


def test_greyscale():
    for scale, kind in ((255, np.uint8), (1, np.float32)):
        rgba = np.array([[[100, 150, 200, 7]]], np.float32) * (1 if kind == np.uint8 else 1 / 255)
        rgba = rgba.astype(kind)
        want = -0.5 + (0.299 * float(rgba[0, 0, 0]) + 0.587 * float(rgba[0, 0, 1]) + 0.114 * float(rgba[0, 0, 2])) / scale
        assert abs(raster.greyscale(rgba)[0, 0] - want) < 1e-5
        assert abs(raster.greyscale(rgba[..., :3])[0, 0] - want) < 1e-5
        assert abs(raster.greyscale(rgba[..., :1])[0, 0] - (-0.5 + float(rgba[0, 0, 0]) / scale)) < 1e-5
    chw = np.zeros((3, 2, 5))
    assert raster.image_from_tensor(chw, "CHW").shape == (2, 5, 3)
    with pytest.raises(raster.ImageSourceError):
        raster.image_from_tensor(np.zeros((1, 5, 5)), "HWC")


def test_components():
    mask = np.zeros((400, 400), bool)
    for t, l, b, r in grid(10, 10, 5, 5, 10, 50, 10, 5):
        mask[t : b + 1, l : r + 1] = True
    found = components.word_boxes(mask, 100, expand=0)
    assert len(found) == 25 and np.allclose(np.sort(found[:, 4:], axis=1), [10, 50])
    ring = np.zeros((60, 60), bool)
    ring[5:50, 5:50] = True
    ring[10:40, 10:40] = False
    ring[20:30, 20:30] = True
    assert len(components.word_boxes(ring, 1)) == 1
    assert len(components.word_boxes(np.zeros((5, 5), bool))) == 0


def test_labels_equal_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(20):
        mask = rng.random((15, 17)) < 0.45
        labels = components.label_regions(mask)
        seen = np.zeros(mask.shape, int)
        n = 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if not seen[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    p, q = todo.pop()
                    if 0 <= p < 15 and 0 <= q < 17 and mask[p, q] and not seen[p, q]:
                        seen[p, q] = n
                        todo += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (labels == seen).all()


def test_separators_with_overlapping_words():
    assert len(layout.separators(boxes(grid(0, 0, 2, 2, 10, 20, 50, -5)))) == 2


def test_reading_order_of_two_columns():
    left, right = grid(0, 0, 10, 5, 5, 5, 3, 2), grid(0, 53, 10, 5, 5, 5, 3, 2)
    words = left + right
    random.Random(1234).shuffle(words)
    lines = layout.reading_order(boxes(words))
    assert len(lines) == 20 and all(len(w) == 5 for _, _, w in lines)
    for _, _, w in lines:
        rect = G.union(G.bounds(boxes([words[i] for i in w])))
        assert abs(rect[2] - rect[0] - 5) <= 1 and abs(rect[3] - rect[1] - 33) <= 1
    assert layout.reading_order(np.zeros((0, 6))) == []


def test_empty_rects():
    left, right = grid(0, 0, 10, 5, 5, 5, 3, 2), grid(0, 53, 10, 5, 5, 5, 3, 2)
    area = lambda w, h: w * h
    page = tuple(G.union(np.array(left + right)).tolist())
    gutter = next(layout.empty_rects(np.array(left + right), page, area, 0, 0))
    assert gutter == (page[0], 33, page[2], 53)
    assert list(layout.empty_rects(np.array([(0, 0, 5, 5)]), (0, 0, 5, 5), area, 0, 0)) == []
    assert list(layout.empty_rects(np.zeros((0, 4)), (0, 0, 0, 0), area, 0, 0)) == []


def test_line_polygon_is_in_order_and_holds_the_centres():
    words = boxes([(8, x - 5, 13, x + 5) for x in range(0, 100, 20)])
    words[1::2, 2:4] *= -1
    ring = recognition.line_polygon(words)
    assert len(ring) == 20 and ring[:10, 0].tolist() == sorted(ring[:10, 0].tolist())
    y, x = G.polygon_pixels(ring)
    assert {(10, int(c)) for c in words[:, 0]} <= set(zip(y.tolist(), x.tolist(), strict=True))


def test_corners_and_oriented_boxes():
    assert G.corners(G.upright(0, 0, 25, 30)).tolist() == [[30, 25], [0, 25], [0, 0], [30, 0]]
    angle = 0.3
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    box = G.smallest_box(np.array([[0, 0], [40, 0], [40, 10], [0, 10], [20, 5]]) @ turn.T)
    assert np.allclose(box[4:], [40, 10], atol=1e-3)
    assert G.smallest_box(np.array([[0, 0], [5, 5], [9, 9]])) is None


def test_ctc():
    score = lambda *labels: np.log(np.eye(4)[list(labels)] * 0.9 + 0.025)
    assert ctc.greedy(score(0, 1, 1, 0, 1, 2, 2)) == [(1, 1), (1, 4), (2, 5)]
    assert [c for c, _ in ctc.beam(score(0, 1, 1, 0, 1, 2, 2), 10)] == [1, 1, 2]
    # Alignments are summed: the best path is blank, the best labelling isn't.
    two = np.log(np.array([[0.6, 0.4], [0.6, 0.4]]))
    assert ctc.greedy(two) == [] and [c for c, _ in ctc.beam(two, 5)] == [1]
    assert ctc.mask(two, [1])[0, 1] == -np.inf


def test_beam_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(20):
        p = rng.dirichlet(np.ones(3), size=4)
        total = {}
        for path in product(range(3), repeat=4):
            text = tuple(c for i, c in enumerate(path) if c and (i == 0 or path[i - 1] != c))
            total[text] = total.get(text, 0) + np.prod([p[i, c] for i, c in enumerate(path)])
        assert tuple(c for c, _ in ctc.beam(np.log(p), 100)) == max(total, key=total.get)


def page(n_words=3):
    image = np.zeros((100, 200, 3), np.uint8)
    for k in range(n_words):
        image[30:50, 70 * k : 70 * k + 50] = 255
    return image


def images(spark, *arrays):
    rows = [(i, a.tobytes(), a.shape[1], a.shape[0]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image_id long, data binary, width int, height int")


def test_detection(spark):
    reader = PageReader(detection=StandInDetector())
    bad = spark.createDataFrame([(9, b"xx", 3, 3)], "image_id long, data binary, width int, height int")
    inputs = reader.prepare_input(images(spark, page()).union(bad))
    assert {r["image_id"]: r["error"] for r in inputs.collect()} == {0: None, 9: "UnsupportedChannelCount"}
    found = [[getattr(r["box"], f) for f in G.BOX_FIELDS] for r in reader.detect_words(inputs).collect()]
    rects = sorted(G.bounds(np.array(found)).round(2).tolist(), key=lambda r: r[1])
    assert [(r[0], r[1], r[2] - r[0], r[3] - r[1]) for r in rects] == [(27, -3, 25, 56), (27, 66, 25, 57), (27, 136, 25, 57)]
    lines = reader.find_text_lines(reader.detect_words(inputs)).collect()
    assert [(r["line_idx"], len(r["words"])) for r in lines] == [(0, 3)]


@pytest.mark.parametrize("rows,allowed,beam,want", [({2: 255}, None, None, "0"), ({2: 178, 3: 76}, None, None, "0"), ({2: 178, 3: 76}, "123456789", None, "1"), ({}, "", None, None)])
def test_recognition(spark, rows, allowed, beam, want):
    image = np.zeros((64, 32, 1), np.uint8)
    for y, value in rows.items():
        image[y] = value
    reader = PageReader(recognition=StandInRecogniser(), alphabet=A.DEFAULT_ALPHABET[:63], allowed_chars=allowed, beam=beam)
    inputs = reader.prepare_input(images(spark, image))
    line = [dict(zip(G.BOX_FIELDS, map(float, G.upright(0, 0, 64, 32)), strict=True))]
    lines = spark.createDataFrame([(0, 0, line), (0, 1, [])], f"image_id long, line_idx int, words array<struct<{','.join(f'{f}:float' for f in G.BOX_FIELDS)}>>")
    got = {r["line_idx"]: r["text"] for r in reader.recognize_text(inputs, lines).collect()}
    assert got[1] is None and len(got) == 2
    if want:
        assert got[0] == want


def test_class_count_and_missing_models(spark):
    with pytest.raises(WrongOutput):
        recognition.recognise(StandInRecogniser(), np.zeros((1, 1, 64, 8), np.float32), 97)
    with pytest.raises(ValueError, match="detection"):
        PageReader().detect_words(PageReader().prepare_input(images(spark, page())))


def test_whole_pipeline_keeps_pages_without_text(spark):
    reader = PageReader(detection=StandInDetector(), recognition=StandInRecogniser(), alphabet=A.DEFAULT_ALPHABET[:63])
    got = {r["image_id"]: r["text"] for r in reader.get_text(images(spark, page(), page(0))).collect()}
    assert set(got) == {0, 1} and got[1] == "" and got[0]


def test_document_and_text(spark):
    def chars(text):
        return [{"ch": c, "rect": {"top": 0, "left": 10 * i, "bottom": 25, "right": 10 * i + 10}} for i, c in enumerate(text)]

    rows = [(1, 0, "line one", chars("line one")), (1, 1, None, None), (1, 2, "line  two ", chars("line  two "))]
    read = spark.createDataFrame(rows, "image_id long, line_idx int, text string, chars array<struct<ch:string,rect:struct<top:int,left:int,bottom:int,right:int>>>")
    assert {r["image_id"]: r["text"] for r in join_text(read).collect()} == {1: "line one\nline  two "}
    pages = spark.createDataFrame([(1, "image.jpeg", 256, 256), (2, "empty.png", 5, 7)], "image_id long, url string, width int, height int")
    trees = {r["image_id"]: json.loads(r["document"]) for r in document_trees(pages, read).collect()}
    first = trees[1]["paragraphs"][0]["lines"]
    assert [x["text"] for x in first] == ["line one", "line  two "] and [w["text"] for w in first[1]["words"]] == ["line", "two"]
    assert first[0]["words"][1]["vertices"] == [[80, 25], [50, 25], [50, 0], [80, 0]]
    assert trees[2] == {"url": "empty.png", "image_width": 5, "image_height": 7, "paragraphs": [{"lines": []}]}
