"""Fitted models as Parquet, and estimators as stages of pyspark.ml pipelines.

A model's folder has a one-row table with its class and its attributes as JSON, and a table for each frame that it keeps (the rows of nearest
neighbours, labels, subtrees of large forests), so that nothing that grows with the rows passes through the driver.
"""

from __future__ import annotations

import copy
import dataclasses
import importlib
import inspect
import json
from typing import Any

import numpy as np
from pyspark.ml import Estimator as SparkEstimator
from pyspark.ml import Model as SparkModel
from pyspark.ml.util import DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Row, SparkSession

from millrace.core import Estimator

#: Attributes that name a table of the model's own.
TABLES = {("Forest", "path")}


def _name(kind: type) -> str:
    if kind.__module__.split(".")[0] != __name__.split(".")[0]:
        raise ValueError(f"{kind.__module__}.{kind.__qualname__} can't be saved")
    return f"{kind.__module__}:{kind.__qualname__}"


def _kind(name: str) -> type:
    module, _, own = name.partition(":")
    if module.split(".")[0] != __name__.split(".")[0]:
        raise ValueError(f"{name} is no class of this library")
    return getattr(importlib.import_module(module), own)


def _encoded(value: Any, spark: SparkSession, path: str, frames: list[str]) -> Any:
    """A value as JSON; frames are written below `path`."""
    again = lambda v: _encoded(v, spark, path, frames)
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "type": value.dtype.str, "shape": list(value.shape)}
    if isinstance(value, Row):
        return {"row": [[k, again(v)] for k, v in value.asDict().items()]}
    if isinstance(value, list | tuple):
        return {"list" if isinstance(value, list) else "tuple": [again(v) for v in value]}
    if isinstance(value, dict):
        return {"dict": [[again(k), again(v)] for k, v in value.items()]}
    if isinstance(value, DataFrame):
        frames.append(f"frame-{len(frames)}")
        own = frames[-1]
        value.write.parquet(f"{path}/{own}")
        return {"frame": own}
    if isinstance(value, Estimator) or dataclasses.is_dataclass(value):
        state = dict(vars(value))
        for name in state:
            if (type(value).__name__, name) in TABLES and state[name]:
                frames.append(f"frame-{len(frames)}")
                spark.read.parquet(state[name]).write.parquet(f"{path}/{frames[-1]}")
                state[name] = {"place": frames[-1]}
        return {"object": _name(type(value)), "state": {k: v if isinstance(v, dict) and set(v) == {"place"} else again(v) for k, v in state.items()}}
    raise ValueError(f"an attribute of type {type(value).__name__} can't be saved")


def _decoded(value: Any, spark: SparkSession, path: str) -> Any:
    again = lambda v: _decoded(v, spark, path)
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"], dtype=np.dtype(value["type"])).reshape(value["shape"])
    if "row" in value:
        return Row(**{k: again(v) for k, v in value["row"]})
    if "list" in value or "tuple" in value:
        return [again(v) for v in value["list"]] if "list" in value else tuple(again(v) for v in value["tuple"])
    if "dict" in value:
        return {again(k): again(v) for k, v in value["dict"]}
    if "frame" in value:
        return spark.read.parquet(f"{path}/{value['frame']}")
    if "place" in value:
        return f"{path}/{value['place']}"
    kind = _kind(value["object"])
    out = kind.__new__(kind)
    vars(out).update({k: again(v) for k, v in value["state"].items()})
    return out


def save_model(spark: SparkSession, model: Estimator, path: str) -> None:
    """Write a fitted model to a new folder. A model that keeps a function, such as a kernel of the caller's own, is a ValueError."""
    model._check_fitted()
    state = json.dumps(_encoded(model, spark, path, []))
    spark.createDataFrame([(_name(type(model)), state)], "class string, state string").coalesce(1).write.parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Estimator:
    """The model that `save_model` wrote; its frames are read where they lie."""
    row = spark.read.parquet(f"{path}/model").first()
    return _decoded(json.loads(row.state), spark, path)


# stages of pyspark.ml


class Stage(SparkEstimator):
    """An estimator of this library in a pyspark.ml Pipeline: fits a copy on the named columns."""

    def __init__(self, estimator: Estimator, features, label: str | None = None, id_col: str | None = None) -> None:
        super().__init__()
        self.estimator, self.features, self.label, self.id_col = estimator, features, label, id_col

    def _fit(self, dataset: DataFrame) -> FittedStage:
        model = copy.deepcopy(self.estimator)
        named = {"label": self.label, "id_col": self.id_col}
        taken = inspect.signature(model.fit).parameters
        return FittedStage(model.fit(dataset, self.features, **{k: v for k, v in named.items() if v is not None and k in taken}))


class _Writer(MLWriter):
    def __init__(self, stage: FittedStage) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:  # noqa: N802  named by pyspark
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        save_model(self.sparkSession, self.stage.model, f"{path}/fitted")


class _Reader(MLReader):
    def load(self, path: str) -> FittedStage:
        return FittedStage(load_model(self.sparkSession, f"{path}/fitted"))


class FittedStage(SparkModel, MLWritable, MLReadable):
    """A fitted model as a stage; it can be saved and loaded with its pipeline."""

    def __init__(self, model: Estimator | None = None) -> None:
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()
