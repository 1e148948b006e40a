"""The boundary to recognition models: a factory makes one model for each Python worker, batches go through it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "engine bigint, answer string, confidence double, token_probabilities array<double>, error string"


class Recogniser(Protocol):
    def predict(self, images: Sequence[bytes]) -> Sequence[tuple[str, float, Sequence[float]]]:
        """Text, confidence and token probabilities of each image."""


_models: dict[str, Recogniser] = {}


def model(name: str, factory: Callable[[], Recogniser]) -> Recogniser:
    """The worker's model of that name, made on first use."""
    if name not in _models:
        _models[name] = factory()
    return _models[name]


def answers(engine: Recogniser, images: list[bytes]) -> list[tuple]:
    """(text, confidence, token probabilities, error) of each image: predicted together, or one by one if that fails."""

    def together(some: list[bytes]) -> list[tuple]:
        found = [(text, float(confidence), list(tokens), None) for text, confidence, tokens in engine.predict(some)]
        if len(found) != len(some):
            raise ValueError(f"{len(found)} answers to {len(some)} images")
        return found

    try:
        return together(images)
    except Exception as why:  # noqa: BLE001  one image's failure must not end the run
        if len(images) == 1:
            return [(None, None, None, f"{type(why).__name__}: {why}")]
    return [row for image in images for row in answers(engine, [image])]


def recognise(crops: DataFrame, name: str, factory: Callable[[], Recogniser], engine: int = 0, key: str = "key", image: str = "png") -> DataFrame:
    """(key, engine, answer, confidence, token_probabilities, error). An image that fails has an error and no confidence."""
    kinds = (pa.string(), pa.float64(), pa.list_(pa.float64()), pa.string())

    def run(batches):
        for batch in batches:
            rows = answers(model(name, factory), batch.column(1).to_pylist())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array([engine] * len(rows), pa.int64()), *columns], [key, "engine", "answer", "confidence", "token_probabilities", "error"])

    return crops.select(key, image).mapInArrow(run, f"`{key}` {crops.schema[key].dataType.simpleString()}, {SCHEMA}")


def panel(crops: DataFrame, engines: Sequence[tuple[str, Callable[[], Recogniser], float | None]], key: str = "key", image: str = "png") -> DataFrame:
    """Answers of several engines (name, factory, Brier score), as the panel's decision needs them."""
    if not engines:
        raise ValueError("a panel needs an engine")
    out = None
    for i, (name, factory, brier) in enumerate(engines):
        one = recognise(crops, name, factory, i, key, image).withColumn("brier", F.lit(brier).cast("double"))
        out = one if out is None else out.unionByName(one)
    return out
