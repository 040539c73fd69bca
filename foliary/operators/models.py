"""Models are plugged in: anything with input_shape and run. They travel to tasks by pickle: as bytes, or as a path to load there."""

from __future__ import annotations

from functools import lru_cache
from typing import Protocol

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession


class Model(Protocol):
    def input_shape(self) -> list[int | str]:
        """NCHW; a name stands for a size that may vary."""

    def run(self, tensor: np.ndarray) -> np.ndarray:
        """NCHW float32 to the model's output."""


class ModelRunError(RuntimeError):
    """The model failed."""


class WrongOutput(ModelRunError):
    """The model's output hasn't the expected rank or size."""


@lru_cache(8)
def _session(source: str | bytes):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # tasks are what runs side by side
    return onnxruntime.InferenceSession(source, options, providers=["CPUExecutionProvider"])


class OnnxModel:
    """An ONNX model: a file that every executor can read, or its bytes; loaded once in each Python worker."""

    def __init__(self, source: str | bytes):
        self.source = source

    @classmethod
    def from_url(cls, spark: SparkSession, url: str) -> FetchedModel:
        """The model at a URL, which Spark fetches once for each executor."""
        spark.sparkContext.addFile(url)
        return FetchedModel(url.split("?")[0].split("#")[0].rstrip("/").rsplit("/", 1)[-1])

    def session(self):
        return _session(self.source)

    def input_shape(self) -> list[int | str]:
        return [x if isinstance(x, int) else str(x) for x in self.session().get_inputs()[0].shape]

    def run(self, tensor: np.ndarray) -> np.ndarray:
        session = self.session()
        return session.run(None, {session.get_inputs()[0].name: tensor})[0]


class FetchedModel(OnnxModel):
    """A model that Spark has fetched: its file is where each executor keeps such files."""

    def session(self):
        return _session(SparkFiles.get(self.source))


class StandInDetector:
    """For tests: the text probability of a pixel is its brightness. It doesn't detect text."""

    def __init__(self, height: int = 200, width: int = 100):
        self.size = (height, width)

    def input_shape(self) -> list[int | str]:
        return ["batch", 1, *self.size]

    def run(self, tensor: np.ndarray) -> np.ndarray:
        return tensor + np.float32(0.5)


class StandInRecogniser:
    """For tests: each column of the line image, the largest of four, is a step's class scores. It doesn't read text."""

    height, step = 64, 4

    def input_shape(self) -> list[int | str]:
        return ["batch", 1, self.height, "width"]

    def run(self, tensor: np.ndarray) -> np.ndarray:
        n, _, height, width = tensor.shape
        steps = width // self.step
        pooled = tensor[:, 0, :, : steps * self.step].reshape(n, height, steps, self.step).max(axis=3)
        return pooled.transpose(2, 0, 1)
