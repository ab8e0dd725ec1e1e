"""Pipelines whose stage outputs are written once and reused.

A stage's output is kept in a folder named by a fingerprint of the input data and of every
stage up to it (configuration and source code of the stage and of the operators it may use).  A
later run reads the longest prefix that is still valid and fits only what comes after it.

The input's fingerprint is its logical plan together with the names, sizes and times of its files,
so two filters of one file differ, and so do two versions of it.  Input without files (rows in
memory, checkpoints) cannot be told apart and needs a ``version``.

Rows a stage was fitted on go on as its ``transform_training`` gives them, where it has one.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from functools import cache
from importlib import import_module
from pathlib import Path

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import on_training_rows
from ..sources.tables import path_exists


def data_fingerprint(df: DataFrame) -> str:
    """Hash of the schema, the logical plan and the input files' names, sizes and times."""
    files = df.inputFiles()
    if not files:
        raise ValueError("the input has no files to tell its version by: give a version")
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    text = f"{df.schema.json()} {df.semanticHash()} {plan}"
    listing = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    text += str(listing.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@cache
def library_code() -> str:
    """Hash of the source of all operators and functions, which stages call."""
    root = Path(inspect.getfile(import_module(__package__.rpartition(".")[0]))).parent
    sources = sorted(p for part in ("operators", "functions", "plans") for p in (root / part).glob("*.py"))
    return hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()


def stage_fingerprint(stage) -> str:
    """Hash of a stage's class, the source of its module and of the library, and its parameters."""
    config = getattr(stage, "config", None)
    if config is None:
        config = {p.name: str(v) for p, v in stage.extractParamMap().items()}
    try:
        code = inspect.getsource(inspect.getmodule(type(stage)))
    except (OSError, TypeError):
        code = type(stage).__qualname__
    text = json.dumps([type(stage).__qualname__, code, library_code(), config], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class StagedPipeline:
    """Steps fitted in order; the last may be a model.

    With ``folder`` set, outputs of all steps but the last are kept there, beside the fitted
    steps.  ``version`` names the input data when its files cannot be listed.
    """

    def __init__(self, stages: list, folder: str | None = None, version: str | None = None):
        self.stages, self.folder, self.version = stages, folder, version
        self.model: PipelineModel | None = None
        self.reused = 0

    def _paths(self, df: DataFrame) -> list[str]:
        mark = self.version or data_fingerprint(df)
        paths = []
        for stage in self.stages[:-1]:
            mark = hashlib.sha256((mark + stage_fingerprint(stage)).encode()).hexdigest()[:16]
            paths.append(f"{self.folder}/{mark}")
        return paths

    def fit(self, df: DataFrame) -> StagedPipeline:
        spark, fitted, start = df.sparkSession, [], 0
        paths = self._paths(df) if self.folder else []
        for path in paths:
            if not path_exists(spark, f"{path}/rows/_SUCCESS"):
                break
            fitted.append(PipelineModel.load(f"{path}/stage").stages[0])
            start += 1
        self.reused = start
        if start:
            df = spark.read.parquet(f"{paths[start - 1]}/rows")
        for i in range(start, len(self.stages)):
            stage = self.stages[i]
            model = stage.fit(df) if isinstance(stage, Estimator) else stage
            fitted.append(model)
            if i == len(self.stages) - 1:
                break
            df = on_training_rows(model, df)
            if self.folder:
                PipelineModel([model]).write().overwrite().save(f"{paths[i]}/stage")
                df.write.mode("overwrite").parquet(f"{paths[i]}/rows")
                df = spark.read.parquet(f"{paths[i]}/rows")
        self.model = PipelineModel(fitted)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit, and the training rows as fitting saw them."""
        model = self.fit(df).model
        for stage in model.stages:
            df = on_training_rows(stage, df)
        return df

    fit_predict = fit_transform

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        for stage in self.model.stages[:-1]:
            df = stage.transform(df)
        return self.model.stages[-1].log_probabilities(df)
