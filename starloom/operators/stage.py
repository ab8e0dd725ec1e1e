"""Base of the fit/transform stages: ``pyspark.ml`` estimators with small, saved state."""

from __future__ import annotations

import json
from importlib import import_module
from typing import Any

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession

from .tables import BROADCAST_ROWS, SizedTable, rows_if_small


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        stage = self.stage
        extra = {"config": json.dumps(stage.config), "state": json.dumps(stage.state), "tables": sorted(stage.tables)}
        extra["models"] = {n: f"{type(m).__module__}.{type(m).__name__}" for n, m in stage.models.items()}
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata=extra)
        for name, table in stage.tables.items():
            table.df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        for name, model in stage.models.items():
            model.write().overwrite().save(f"{path}/models/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.builder.getOrCreate()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.cls.from_saved(json.loads(meta["config"]), json.loads(meta["state"]))
        for name in meta["tables"]:
            df = spark.read.parquet(f"{path}/tables/{name}")
            rows = rows_if_small(df, BROADCAST_ROWS)
            stage.tables[name] = SizedTable(df, None) if rows is None else SizedTable.from_rows(spark, rows, df.schema)
        for name, kind in meta["models"].items():
            module, cls = kind.rsplit(".", 1)
            stage.models[name] = getattr(import_module(module), cls).load(f"{path}/models/{name}")
        return stage


class Saved(MLWritable, MLReadable):
    """Configuration, state and lookup tables that survive save and load."""

    config: dict[str, Any]
    state: dict[str, Any]
    tables: dict[str, SizedTable]

    def _init_saved(self, config: dict, state: dict | None = None, tables: dict | None = None) -> None:
        self.config, self.state, self.tables = config, state or {}, tables or {}
        self.models: dict[str, Any] = {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def from_saved(cls, config: dict, state: dict):
        stage = cls(**config)
        stage.state = state
        return stage


class FeatureStage(Saved, Estimator):
    """An estimator described by a JSON-able configuration."""

    def __init__(self, **config):
        super().__init__()
        self._init_saved(config)


class FittedStage(Saved, Model):
    """A fitted stage: configuration plus what ``fit`` learned."""

    def __init__(self, config: dict, state: dict | None = None, tables: dict | None = None):
        super().__init__()
        self._init_saved(config, state, tables)

    @classmethod
    def from_saved(cls, config: dict, state: dict):
        return cls(config, state)


class PlainStage(Saved, Transformer):
    """A stage with nothing to learn."""

    def __init__(self, **config):
        super().__init__()
        self._init_saved(config)


def on_training_rows(model: Transformer, df):
    """What a fitted stage makes of the rows it was fitted on."""
    return model.transform_training(df) if hasattr(model, "transform_training") else model.transform(df)


class TrainingPipeline(Pipeline):
    """A ``Pipeline`` whose later stages are fitted on training values, such as leave-one-out means."""

    def _fit(self, dataset) -> PipelineModel:
        fitted, stages = [], self.getStages()
        for i, stage in enumerate(stages):
            model = stage.fit(dataset) if isinstance(stage, Estimator) else stage
            fitted.append(model)
            if i < len(stages) - 1:
                dataset = on_training_rows(model, dataset)
        return PipelineModel(fitted)
