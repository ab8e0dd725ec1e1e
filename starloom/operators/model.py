"""Boosted trees on Spark ML, scoring, and metrics."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import as_col, hash_bucket, md5_of
from .aggregate import numeric_columns
from .newton import NewtonTrees, softmax
from .ordered import OrderedGroups, hash_ordered_position
from .select import assembled
from .stage import FeatureStage, FittedStage
from .tables import materialise


class BoostedTrees(FeatureStage):
    """Boosted trees for two classes, several classes, or a number.

    ``select_rounds``: "cv" picks the round with the least mean loss over folds and refits
    on all rows; "holdout" stops on a held-out share; "none" uses ``rounds`` as given.
    ``patience`` ends the search that many rounds after the last improvement.  With ``metric`` "auc"
    (two classes) the round with the best area under the curve is taken instead of the least loss.
    Folds are even, and for classes even within each class.  Labels of classes are 0, 1, 2, ...

    ``weight`` names a column of row weights.  ``class_weights`` has one for each class, or is "balanced" (the rows of all
    classes weigh alike); ``positive_weight`` is short for that of class 1 of two.  More than two classes share one softmax, with
    one tree a class and round; these trees, and all with a penalty on leaves (``leaf_l1``, ``leaf_l2``), follow
    ``NewtonTrees`` and take all rows and columns (``subsample`` and ``column_share`` 1).
    """

    def __init__(
        self,
        label,
        columns=None,
        problem="classification",
        rounds=20,
        select_rounds="cv",
        folds=5,
        patience=-1,
        test_share=0.15,
        key=None,
        seed=0,
        learning_rate=0.1,
        max_depth=5,
        max_bins=255,
        subsample=1.0,
        column_share=1.0,
        min_child_rows=1,
        min_split_gain=0.0,
        positive_weight=1.0,
        metric="loss",
        weight=None,
        class_weights=None,
        leaf_l1=0.0,
        leaf_l2=0.0,
    ):
        config = dict(locals())
        for name in ("self", "__class__"):
            config.pop(name, None)
        super().__init__(**config)

    def _trees(self, rounds: int):
        c = self.config
        kind = GBTRegressor if c["problem"] == "regression" else GBTClassifier
        trees = kind(
            featuresCol="features",
            labelCol="label",
            maxIter=rounds,
            stepSize=c["learning_rate"],
            maxDepth=c["max_depth"],
            maxBins=c["max_bins"],
            subsamplingRate=c["subsample"],
            minInstancesPerNode=c["min_child_rows"],
            minInfoGain=c["min_split_gain"],
            featureSubsetStrategy="all" if c["column_share"] >= 1 else str(c["column_share"]),
            seed=c["seed"],
            checkpointInterval=10,
        )
        return trees.setWeightCol("weight") if self._weighted() else trees

    def _weighted(self) -> bool:
        c = self.config
        return c["positive_weight"] != 1.0 or c["weight"] is not None or c["class_weights"] is not None

    def _row_weight(self, data: DataFrame, classed: bool) -> Column:
        c, label = self.config, as_col(self.config["label"])
        weight = F.coalesce(as_col(c["weight"]).cast("double"), F.lit(0.0)) if c["weight"] else F.lit(1.0)
        by_class = c["class_weights"]
        if by_class == "balanced" and classed:
            counts = {int(r[0]): r[1] for r in data.groupBy(label.cast("int")).count().collect()}  # one row a class
            by_class = [sum(counts.values()) / len(counts) / counts.get(k, 1) for k in range(max(counts, default=0) + 1)]
        if by_class:
            weight = weight * F.element_at(F.array(*[F.lit(float(w)) for w in by_class]), label.cast("int") + 1)
        return weight * F.when(label > 0, F.lit(float(c["positive_weight"]))).otherwise(F.lit(1.0))

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        c = self.config
        columns = c["columns"] or [x for x in numeric_columns(dataset) if x not in (c["label"], c["key"])]
        data = dataset.where(as_col(c["label"]).isNotNull())
        row_key = [c["key"]] if c["key"] else columns
        held = (hash_bucket(row_key, 10_000, c["seed"]) < F.lit(round(10_000 * c["test_share"]))).alias("held")
        classed = c["problem"] == "classification"
        label, weight = as_col(c["label"]).cast("double").alias("label"), self._row_weight(data, classed).alias("weight")
        hashed = md5_of(row_key, f"cv{c['seed']}").alias("__hash")
        vectors = assembled(data, columns).select("features", label, weight, held, hashed, F.lit(0).alias("__one"))
        if c["select_rounds"] == "cv":  # the only use of folds, which take a shuffle of all rows
            vectors = hash_ordered_position(materialise(vectors), ["label"] if classed else ["__one"], "__hash", "__fold")
            vectors = vectors.withColumn("fold", (F.col("__fold") % c["folds"]).cast("int"))
        vectors = materialise(vectors.drop("__hash", "__one", "__fold"))
        state = {"columns": columns, "rounds": c["rounds"], "history": []}
        classes = 2
        if classed:
            low, high, whole = vectors.agg(F.min("label"), F.max("label"), F.max(F.abs(F.col("label") - F.round("label")))).first()
            if (low or 0) < 0 or (whole or 0) > 0:
                raise ValueError("labels of classes must be 0, 1, 2, ...")
            classes = int(high or 0) + 1
        state["classes"] = classes
        if classes > 2 and c["positive_weight"] != 1.0:
            raise ValueError("with several classes give class_weights")
        newton = classes > 2 or c["leaf_l1"] or c["leaf_l2"]
        if newton and (c["subsample"] != 1.0 or c["column_share"] != 1.0):
            raise ValueError("several classes and penalties on leaves take all rows and columns")
        if c["metric"] not in ("loss", "auc") or c["metric"] == "auc" and (not classed or classes > 2):
            raise ValueError("metric is 'loss', or 'auc' for two classes")
        state["newton"] = newton = bool(newton)
        if newton:
            if c["metric"] == "auc":
                raise ValueError("metric 'auc' goes without penalties on leaves")
            model, learned = self._newton(vectors, classes if classed else 0, state)
            state |= learned
        elif c["select_rounds"] == "cv":
            losses = [
                self._losses(self._trees(c["rounds"]).fit(vectors.where(F.col("fold") != k)), vectors.where(F.col("fold") == k))
                for k in range(c["folds"])
            ]
            mean = [sum(v) / len(v) for v in zip(*losses)]
            state["history"], state["rounds"] = mean, best_round(mean, c["patience"])
            model = self._trees(state["rounds"]).fit(vectors)
        elif c["select_rounds"] == "holdout":
            rest = vectors.where("NOT held")
            losses = self._losses(self._trees(c["rounds"]).fit(rest), vectors.where("held"))
            state["history"], state["rounds"] = losses, best_round(losses, c["patience"])
            model = self._trees(state["rounds"]).fit(rest)
        else:
            model = self._trees(c["rounds"]).fit(vectors)
        out = BoostedTreesModel(c, state)
        out.models["trees"] = model
        return out

    def _newton(self, vectors: DataFrame, classes: int, state: dict):
        c, trees = self.config, NewtonTrees(self.config, classes)
        learning = lambda learn: vectors.withColumn("learn", learn)
        if c["select_rounds"] == "cv":
            losses = [trees.grow(learning(F.col("fold") != k), c["rounds"])[2] for k in range(c["folds"])]
            mean = [sum(v) / len(v) for v in zip(*losses, strict=True)]
            state["history"], state["rounds"] = mean, best_round(mean, c["patience"])
        elif c["select_rounds"] == "holdout":
            state["history"] = trees.grow(learning(~F.col("held")), c["rounds"])[2]
            state["rounds"] = best_round(state["history"], c["patience"])
        rest = ~F.col("held") if c["select_rounds"] == "holdout" else F.lit(True)
        return trees.grow(learning(rest), state["rounds"])[:2]

    def _losses(self, model, rows: DataFrame) -> list[float]:
        """What is to be small, after each round; with the area under the curve, its negative."""
        if self.config["problem"] == "regression":
            return list(model.evaluateEachIteration(rows, "squared"))
        if self.config["metric"] == "loss":
            return list(model.evaluateEachIteration(rows))
        margins, total = [], F.lit(0.0)
        scored = rows.select("features", "label")
        for i, tree in enumerate(model.trees):
            scored = tree.setPredictionCol(f"t{i}").transform(scored)
            total = total + F.lit(float(model.treeWeights[i])) * F.col(f"t{i}")
            margins.append(total.alias(f"m{i}"))
        scored = materialise(scored.select("label", *margins))
        return [-(roc_auc(scored, "label", f"m{i}").first()["auc"] or 0.0) for i in range(len(margins))]


def best_round(losses: list[float], patience: int = -1) -> int:
    """1-based round with the least loss, searched until ``patience`` rounds bring none."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif 0 < patience <= i - best:
            break
    return best + 1


class BoostedTreesModel(FittedStage):
    """Adds ``prediction`` and, for classes, ``probabilities``.

    Two classes: prediction is the probability of class 1.  Several: the most likely class.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.models["trees"].transform(assembled(dataset, self.state["columns"]))
        names = [as_col(c) for c in dataset.columns]
        regression = self.config["problem"] == "regression"
        if self.state.get("newton"):
            margins = NewtonTrees(self.config, 0 if regression else self.state["classes"]).margins(self.state)
            if regression:
                return scored.select(*names, margins[0].alias("prediction"))
            scored = scored.select(*names, softmax(margins).alias("probabilities"))
            likely = F.array_position("probabilities", F.array_max("probabilities")) - 1
            return scored.select(*names, (F.col("probabilities")[1] if self.state["classes"] == 2 else likely.cast("double")).alias("prediction"), "probabilities")
        if regression:
            return scored.select(*names, F.col("prediction"))
        p = vector_to_array("probability")
        return scored.select(*names, p[1].alias("prediction"), p.alias("probabilities"))

    def log_probabilities(self, dataset: DataFrame) -> DataFrame:
        out = self.transform(dataset)
        return out.withColumn("log_probabilities", F.transform("probabilities", lambda p: F.log(p)))

    def importance_rows(self) -> list[list]:
        """[feature, gain] by falling gain, then name."""
        trees = self.models["trees"]
        columns = self.state["columns"]
        if self.state.get("newton"):
            gains = [sum(float(t.featureImportances[i]) for t in trees.stages) / max(1, len(trees.stages)) for i in range(len(columns))]
        else:
            gains = [float(trees.featureImportances[i]) for i in range(len(columns))]
        return sorted(([c, g] for c, g in zip(columns, gains)), key=lambda r: (-r[1], r[0]))

    def feature_importance(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.importance_rows()], "feature string, gain double")


# -- metrics --------------------------------------------------------------------


def r2_percent(label: Column | str, prediction: Column | str) -> Column:
    """100 x R² as an aggregate; NULL when the label is constant."""
    y, p = as_col(label).cast("double"), as_col(prediction).cast("double")
    unexplained = F.sum((y - p) * (y - p))
    return F.lit(100.0) * (F.lit(1.0) - F.try_divide(unexplained, F.count(y) * F.var_pop(y)))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] = (), name: str = "auc", rows_per_task: int | None = None) -> DataFrame:
    """Area under the ROC curve, tied scores counting half; NULL when a class is missing.

    Rows are first counted per score, so only distinct scores are ordered.
    """
    by = list(by)
    y, s = as_col(label), as_col(score)
    counts = (
        df.where(y.isNotNull() & s.isNotNull())
        .groupBy(*[as_col(c) for c in by], s.alias("__score"))
        .agg(F.count(F.when(y > 0, 1)).alias("__pos"), F.count(F.when(y <= 0, 1)).alias("__neg"))
    )
    below = OrderedGroups(counts, by, ["__score"], rows_per_task).running_sum({"__below": F.col("__neg")}, inclusive=False)
    won = F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") / 2))
    pairs = F.sum("__pos").cast("double") * F.sum("__neg")
    return below.groupBy(*[as_col(c) for c in by]).agg(F.try_divide(won, pairs).alias(name))
