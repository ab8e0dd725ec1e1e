"""The whole run: tables -> child features -> stages -> boosted trees -> predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import CategoricalEncoder, Grouping, OneHot, Ordinal, TargetMean
from ..operators.impute import MissingValuesImputer
from ..operators.model import BoostedTrees, roc_auc
from ..operators.select import ImportanceSelect, VarianceSelect
from ..operators.tables import discard, materialise, owned_tables
from ..operators.validate import train_test_split
from ..session import tuned
from ..sources.tables import write_features, write_predictions, write_report
from .credit_application import CUSTOMER, ApplicationFeatures
from .credit_children import child_features
from .staged import StagedPipeline

# Which application columns are encoded, and how.  A column may appear twice.
ENCODED = [
    ("NAME_CONTRACT_TYPE", OneHot()),
    ("FLAG_OWN_CAR", Ordinal()),
    ("FLAG_OWN_REALTY", Ordinal()),
    ("EMERGENCYSTATE_MODE", Ordinal()),
    ("CODE_GENDER", Ordinal()),
    ("CODE_GENDER", TargetMean()),
    ("HOUSETYPE_MODE", OneHot()),
    ("FONDKAPREMONT_MODE", OneHot()),
    ("NAME_EDUCATION_TYPE", OneHot()),
    ("NAME_EDUCATION_TYPE", TargetMean()),
    ("NAME_FAMILY_STATUS", OneHot()),
    ("NAME_HOUSING_TYPE", OneHot()),
    ("NAME_TYPE_SUITE", Grouping(OneHot(), 3)),
    ("WEEKDAY_APPR_PROCESS_START", Ordinal()),
    ("WALLSMATERIAL_MODE", Ordinal()),
    ("NAME_INCOME_TYPE", OneHot()),
    ("NAME_INCOME_TYPE", TargetMean()),
    ("OCCUPATION_TYPE", Ordinal()),
    ("ORGANIZATION_TYPE", Grouping(OneHot(), 25)),
]


@dataclass
class CreditRun:
    pipeline: StagedPipeline
    predictions: DataFrame
    importance: DataFrame
    auc: float | None

    def discard(self) -> None:
        """Delete the written predictions; whatever was put out stays."""
        discard(self.predictions)


def application_stages(columns: list[str], label: str = "TARGET", rounds: int = 20, select_threshold: float = 0.762, **trees) -> list:
    """Imputation, encoding, selection and the model, for the columns the table has."""
    encoded = [(c, e) for c, e in ENCODED if c in columns]
    names, encoders = [c for c, _ in encoded], [e for _, e in encoded]
    return [
        MissingValuesImputer(numeric=-999, strings="NA", columns=[c for c in columns if c not in (label, CUSTOMER)]),
        CategoricalEncoder(names, encoders, label=label),
        VarianceSelect(3e-5, keep=[CUSTOMER, label]),
        ImportanceSelect(label, select_threshold, rounds=rounds, max_bins=64, columns=None, key=CUSTOMER),
        BoostedTrees(label=label, rounds=rounds, key=CUSTOMER, max_bins=64, **trees),
    ]


def run(
    tables: dict[str, DataFrame],
    train: DataFrame,
    test: DataFrame | None = None,
    label: str = "TARGET",
    folder: str | None = None,
    output: str | None = None,
    rounds: int = 20,
    **trees,
) -> CreditRun:
    """Train on ``train`` and score ``test``; without a test table a fifth is held out and the AUC given.

    Tables written on the way are deleted at the end; the predictions and what the fitted steps look up stay.
    """
    spark = train.sparkSession
    tuned(spark)
    validate = test is None
    with owned_tables(spark) as owned:
        if validate:
            train, test = train_test_split(train, CUSTOMER)
        target = train.select(CUSTOMER, F.col(label).alias("target"))
        children = child_features(tables, target)
        if output:
            write_features(children, f"{output}/features")
        features = ApplicationFeatures().with_children(children).fit(train)
        rows = features.transform_training(train)  # reads the rows written in the fit
        stages = application_stages(rows.columns, label, rounds, **trees)
        pipeline = StagedPipeline(stages, folder).fit(rows)
        scored = pipeline.predict(features.transform(test))
        predictions = materialise(scored.select(CUSTOMER, *([label] if validate else []), "prediction"))
        auc = roc_auc(predictions, label, "prediction").first()["auc"] if validate else None
        importance = pipeline.model.stages[-1].feature_importance(spark)
        if output:
            write_predictions(predictions, f"{output}/predictions")
            write_report(importance, f"{output}/importance")
        looked_up = [t.df for stage in pipeline.model.stages for t in getattr(stage, "tables", {}).values()]
        owned.keep(predictions, *looked_up)
    return CreditRun(pipeline, predictions, importance, auc)
