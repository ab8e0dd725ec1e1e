"""Stages that drop columns.  What they learn is a list of names."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.semantics import FLOATING, WHOLE, as_col
from .aggregate import column_profile, column_statistics, numeric_columns
from .moments import column_moments, null_counts
from .partition import one_to_one_pairs
from .stage import FeatureStage, FittedStage, PlainStage


class DroppedColumns(FittedStage):
    """Drops the columns found while fitting; names the table lacks are ignored."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.state["dropped"])


class DropListed(PlainStage):
    """Drops a known list of redundant columns."""

    def __init__(self, columns):
        super().__init__(columns=list(columns))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.config["columns"])


def counted_by_moments(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns of numbers, as Spark has them in Arrow batches; decimals are left to SQL."""
    return [c for c in columns if isinstance(df.schema[c].dataType, WHOLE + FLOATING)]


def null_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    rows, missing = null_counts(df, columns)
    return {c: n / rows if rows else None for c, n in missing.items()}


class NullShareSelect(FeatureStage):
    """Drops columns whose share of NULLs reaches (or only exceeds) the limit."""

    def __init__(self, limit=0.85, inclusive=True, keep=()):
        super().__init__(limit=limit, inclusive=inclusive, keep=list(keep))

    def _fit(self, dataset: DataFrame) -> DroppedColumns:
        cfg = self.config
        shares = null_shares(dataset, [c for c in dataset.columns if c not in cfg["keep"]])
        over = (lambda v: v >= cfg["limit"]) if cfg["inclusive"] else (lambda v: v > cfg["limit"])
        return DroppedColumns(cfg, {"dropped": [c for c, v in shares.items() if v is not None and over(v)]})


class ConstantDrop(FeatureStage):
    """Drops columns with one distinct value; ``drop_null`` also those without any.

    Minimum and maximum decide, so no values are counted: a column is constant exactly when
    they are equal.
    """

    def __init__(self, drop_null=True, keep=()):
        super().__init__(drop_null=drop_null, keep=list(keep))

    def _fit(self, dataset: DataFrame) -> DroppedColumns:
        columns = [c for c in dataset.columns if c not in self.config["keep"]]
        numbers = counted_by_moments(dataset, columns)
        rest = [c for c in columns if c not in set(numbers)]
        found = column_moments(dataset, numbers) | column_statistics(dataset, rest, {"same": "min(v) = max(v)"}, numbers_as_double=False)
        drop_null = self.config["drop_null"]
        dropped = [c for c in columns if found[c]["same"] or (drop_null and found[c]["same"] is None)]
        return DroppedColumns(self.config, {"dropped": dropped})


class VarianceSelect(FeatureStage):
    """Keeps numeric columns whose population variance is above the threshold."""

    def __init__(self, threshold=0.0, keep=()):
        super().__init__(threshold=threshold, keep=list(keep))

    def _fit(self, dataset: DataFrame) -> DroppedColumns:
        columns = [c for c in numeric_columns(dataset) if c not in self.config["keep"]]
        found = column_moments(dataset, columns)
        low = [c for c in columns if found[c]["variance"] is None or found[c]["variance"] <= self.config["threshold"]]
        return DroppedColumns(self.config, {"dropped": low})


def duplicate_groups(pairs: list[tuple[str, str]], order: list[str]) -> list[list[str]]:
    """Connected sets of columns in which every two are a pair, in table order."""
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    groups, seen = [], set()
    for start in (c for c in order if c in near):
        if start in seen:
            continue
        group, todo = set(), [start]
        while todo:
            c = todo.pop()
            if c not in group:
                group.add(c)
                todo += near[c] - group
        seen |= group
        if all(len(near[c] & group) == len(group) - 1 for c in group):
            groups.append([c for c in order if c in group])
    return groups


class DuplicateDrop(FeatureStage):
    """Keeps one column of every set of columns that map one-to-one onto each other."""

    def __init__(self, ignore=(), columns=None):
        super().__init__(ignore=list(ignore), columns=columns)

    def _fit(self, dataset: DataFrame) -> DroppedColumns:
        columns = [c for c in (self.config["columns"] or dataset.columns) if c not in self.config["ignore"]]
        groups = duplicate_groups(one_to_one_pairs(dataset, columns), columns)
        return DroppedColumns(self.config, {"dropped": [c for g in groups for c in g[1:]], "groups": groups})


def assembled(df: DataFrame, columns: list[str], out: str = "features", handle_invalid: str = "error") -> DataFrame:
    """Feature columns as one ML vector."""
    safe = {c: f"__f{i}" for i, c in enumerate(columns)}
    wide = df.selectExpr("*", *[f"CAST({sqltext.name(c)} AS DOUBLE) AS {s}" for c, s in safe.items()])
    vectors = VectorAssembler(inputCols=list(safe.values()), outputCol=out, handleInvalid=handle_invalid).transform(wide)
    return vectors.drop(*safe.values())


class L1Select(FeatureStage):
    """Drops columns to which a linear model with L1 penalty gives no weight."""

    def __init__(self, label, penalty=0.01, problem="regression", columns=None):
        super().__init__(label=label, penalty=penalty, problem=problem, columns=columns)

    def _fit(self, dataset: DataFrame) -> DroppedColumns:
        cfg = self.config
        columns = cfg["columns"] or [c for c in numeric_columns(dataset) if c != cfg["label"]]
        data = assembled(dataset.where(as_col(cfg["label"]).isNotNull()), columns)
        data = data.select("features", as_col(cfg["label"]).cast("double").alias("label"))
        if cfg["problem"] == "regression":
            model = LinearRegression(regParam=cfg["penalty"], elasticNetParam=1.0, standardization=False).fit(data)
            weights = [abs(float(w)) for w in model.coefficients]
        else:
            reg = 1.0 / (cfg["penalty"] * max(1, data.count()))
            model = LogisticRegression(regParam=reg, elasticNetParam=1.0, standardization=False, maxIter=100).fit(data)
            matrix = model.coefficientMatrix.toArray()
            weights = abs(matrix).mean(axis=0).tolist()
        state = {"dropped": [c for c, w in zip(columns, weights) if w == 0], "weights": dict(zip(columns, weights))}
        return DroppedColumns(cfg, state)


class ImportanceSelect(FeatureStage):
    """Keeps the top int(p x threshold) of p columns by the gain of boosted trees."""

    def __init__(self, label, threshold=0.75, problem="classification", rounds=20, columns=None, **tree_params):
        super().__init__(label=label, threshold=threshold, problem=problem, rounds=rounds, columns=columns, **tree_params)

    def _fit(self, dataset: DataFrame) -> DroppedColumns:
        from .model import BoostedTrees

        cfg = dict(self.config)
        label, threshold, columns = cfg.pop("label"), cfg.pop("threshold"), cfg.pop("columns")
        columns = columns or [c for c in numeric_columns(dataset) if c not in (label, cfg.get("key"))]
        model = BoostedTrees(label=label, columns=columns, select_rounds="none", **cfg).fit(dataset)
        ranked = model.importance_rows()
        kept = [r[0] for r in ranked[: int(len(columns) * threshold)]]
        return DroppedColumns(self.config, {"dropped": [c for c in columns if c not in kept], "importance": ranked})


def principal_components(df: DataFrame, columns: list[str], k: int = 7, keep: list[str] = ()) -> DataFrame:
    """The first k principal components of the columns, as an array column ``components``."""
    from pyspark.ml.functions import vector_to_array

    data = assembled(df, columns)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    return model.transform(data).select(*[as_col(c) for c in keep], vector_to_array("pc").alias("components"))


def selection_report(df: DataFrame, model: DroppedColumns, columns: list[str] | None = None) -> DataFrame:
    """(feature, kept, null_share, nb_distinct, variance) for the columns a selector saw."""
    dropped = model.state["dropped"]
    profile = column_profile(df, columns)
    kept = ~F.col("feature").isin(*dropped) if dropped else F.lit(True)
    return profile.select("feature", kept.cast("int").alias("kept"), "null_share", "nb_distinct", "variance")
