"""Real ONNX graphs through every way a model may come, and the plan of the whole reader."""

import numpy as np
import pytest
from onnx_graph import detector, recogniser
from test_engine import images, page

from foliary.functions import arrays as A
from foliary.functions import geometry as G
from foliary.operators.engine import PageReader
from foliary.operators.expected import compare, error_count
from foliary.operators.models import OnnxModel, StandInDetector, StandInRecogniser

LETTERS = A.DEFAULT_ALPHABET[:63]


def reader(detection, recognition, **more):
    return PageReader(detection=detection, recognition=recognition, alphabet=LETTERS, **more)


def test_graphs_equal_the_stand_ins(spark, tmp_path):
    for name, data in (("detect.model", detector()), ("read.model", recogniser())):
        (tmp_path / name).write_bytes(data)
    x = np.random.default_rng(0).normal(size=(3, 1, 64, 50)).astype(np.float32)
    assert np.array_equal(OnnxModel(recogniser()).run(x), StandInRecogniser().run(x))
    assert OnnxModel(detector()).input_shape()[1:] == [1, 200, 100]
    pages = images(spark, page(), page(0), page(1))
    texts = lambda r: {x["image_id"]: x["text"] for x in r.get_text(pages).collect()}
    want = texts(reader(StandInDetector(), StandInRecogniser()))
    assert want[0] and want[2] and want[1] == ""
    assert texts(reader(OnnxModel(detector()), OnnxModel(recogniser()))) == want
    assert texts(reader(OnnxModel(str(tmp_path / "detect.model")), OnnxModel(str(tmp_path / "read.model")))) == want
    fetched = [OnnxModel.from_url(spark, f"file://{tmp_path}/{n}") for n in ("detect.model", "read.model")]
    assert texts(reader(*fetched)) == want


def test_get_text_equals_its_steps(spark):
    both = reader(StandInDetector(), StandInRecogniser())
    wide = np.concatenate([page(), page(2)])
    bad = spark.createDataFrame([(9, b"xx", 3, 3)], "image_id long, data binary, width int, height int")
    pages = images(spark, page(), page(0), page(1), wide).union(bad)
    inputs = both.prepare_input(pages)
    steps = both.recognize_text(inputs, both.find_text_lines(both.detect_words(inputs)))
    want = {}
    for r in sorted(steps.where("text is not null").collect(), key=lambda r: (r["image_id"], r["line_idx"])):
        want.setdefault(r["image_id"], []).append(r["text"])
    got = {r["image_id"]: r["text"] for r in both.get_text(pages).collect()}
    assert set(got) == {0, 1, 2, 3, 9} and {k: v for k, v in got.items() if v} == {k: "\n".join(v) for k, v in want.items()}
    lines = {r["image_id"]: [x and x["text"] for x in r["lines"]] for r in both.get_text_lines(pages).collect()}
    assert {k: [x for x in v if x] for k, v in lines.items() if any(v)} == want and lines[1] == [] and lines[9] == []


def test_reader_runs_each_python_step_once(spark):
    both = reader(StandInDetector(), StandInRecogniser())
    plan = both.get_text(images(spark, page()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("MapInArrow") == 2 and plan.count("Exchange") == 1


def test_lines_are_read_alike_in_any_company(spark):
    both = reader(None, StandInRecogniser())
    rng = np.random.default_rng(1)
    inputs = both.prepare_input(images(spark, *[rng.integers(0, 256, (64, 300, 3), dtype=np.uint8) for _ in range(3)]))
    rows = []
    for image in range(4):
        for line in range(30):
            left = 3 * line
            box = dict(zip(G.BOX_FIELDS, map(float, G.upright(0, left, 64, left + 32)), strict=True))
            rows.append((image, line, [box] if line % 7 else []))
    kind = f"image_id long, line_idx int, words array<struct<{','.join(f'{f}:float' for f in G.BOX_FIELDS)}>>"
    lines = spark.createDataFrame(rows, kind)
    together = {(r[0], r[1]): r[2] for r in both.recognize_text(inputs, lines.coalesce(1)).collect()}
    apart = {(r[0], r[1]): r[2] for r in both.recognize_text(inputs, lines.repartition(16, "line_idx")).collect()}
    assert together == apart and len(together) == 120
    # The fourth image has no pixels.
    assert all((together[i, k] is None) >= (i == 3 or k % 7 == 0) for i, k in together) and any(together.values())


def test_input_forms(spark):
    pixels = np.random.default_rng(2).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    floats = (pixels / np.float32(255)).astype("<f4")
    planes = lambda x: np.ascontiguousarray(np.moveaxis(x, 2, 0)).tobytes()
    rows = [
        (0, pixels.tobytes(), None, None), (1, planes(pixels), "CHW", None), (2, floats.tobytes(), "HWC", "float32"), (3, planes(floats), "CHW", "float32"),
        (4, pixels.tobytes()[:-1], "CHW", None), (5, pixels.tobytes(), "WHC", None), (6, floats.tobytes()[:-2], None, "float32"), (7, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 7, 5) for r in rows], "image_id long, data binary, order string, dtype string, width int, height int")
    got = {r["image_id"]: r for r in PageReader().prepare_input(df).collect()}
    grey = [np.frombuffer(got[i]["grey"], "<f4") for i in range(4)]
    assert all(np.allclose(g, grey[0], atol=1e-6) for g in grey)
    assert all(got[i]["grey"] is None and got[i]["error"] for i in (4, 5, 6, 7))


def test_one_line_as_recognition_sees_it():
    grey = np.full((64, 32), np.float32(0.25))
    image = reader(None, StandInRecogniser()).recognition_input(grey, np.array([G.upright(0, 0, 64, 32)]))
    assert image.shape == (64, 32) and np.allclose(image[8:-8, 4:-4], 0.25)
    with pytest.raises(ValueError, match="recognition"):
        PageReader().recognition_input(grey, np.array([G.upright(0, 0, 64, 32)]))


def test_expected_texts(spark):
    read = spark.createDataFrame([("a", " one\n"), ("b", "two"), ("c", None)], "image_id string, text string")
    want = spark.createDataFrame([("a", "one"), ("b", "2"), ("c", "x"), ("d", "unused")], "image_id string, text string")
    assert error_count(compare(read, want)).first() == (3, 2)
    with pytest.raises(Exception, match="no expected text for b"):
        compare(read, want.where("image_id <> 'b'")).collect()
