"""Boosted trees on first and second derivatives: one shared softmax for several classes, or squared error.

Each round takes the derivatives of the loss at the margins so far, fits one tree a class to the Newton steps -gradient /
curvature with the curvature as weight, and then sets every leaf to its own regularised step: the sum of gradients,
pulled towards zero by ``leaf_l1``, over the sum of curvatures plus ``leaf_l2``.  The classes' probabilities
come from one softmax of all margins, so each class's trees answer to what the others have learned.

The margins of all rows are a column of one written table a round, which also cuts the lineage; a few sums a leaf come
to the driver.  Rows that are not learned from are scored along with the others, which gives the loss after every round.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

# Curvature that a row has at least, so that steps stay finite.
LEAST_CURVATURE = 1e-6


def softmax(margins: Column) -> Column:
    shifted = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def leaf_value(gradient: float, curvature: float, config: dict) -> float:
    pulled = math.copysign(max(0.0, abs(gradient) - config["leaf_l1"]), gradient)
    return config["learning_rate"] * pulled / (curvature + config["leaf_l2"])


class NewtonTrees:
    """``config`` is that of ``BoostedTrees``; ``classes`` 0 means squared error."""

    def __init__(self, config: dict, classes: int):
        self.config, self.classes = config, classes
        self.size = classes or 1

    def start(self, rows: DataFrame) -> list[float]:
        """Margins without trees: logarithms of the classes' weights, or the mean."""
        learned = rows.where("learn")
        if not self.classes:
            return [learned.agg(F.try_divide(F.sum(F.col("label") * F.col("weight")), F.sum("weight"))).first()[0] or 0.0]
        weights = dict(learned.groupBy(F.col("label").cast("int")).agg(F.sum("weight")).collect())
        total = sum(weights.values()) + self.classes
        return [math.log((weights.get(k, 0.0) + 1.0) / total) for k in range(self.classes)]

    def derivatives(self, rows: DataFrame) -> DataFrame:
        """g0.. and h0..: what to follow and how fast it changes; z0.. their ratios."""
        if not self.classes:
            out = rows.withColumns({"g0": F.col("weight") * (F.col("label") - F.col("m")[0]), "h0": F.col("weight")})
        else:
            out = rows.withColumn("p", softmax(F.col("m")))
            for k in range(self.classes):
                p = F.col("p")[k]
                out = out.withColumns({f"g{k}": F.col("weight") * ((F.col("label") == k).cast("double") - p), f"h{k}": F.col("weight") * F.greatest(p * (1 - p), F.lit(LEAST_CURVATURE))})
        return out.withColumns({f"z{k}": F.try_divide(F.col(f"g{k}"), F.col(f"h{k}")) for k in range(self.size)})

    def _tree(self, k: int, number: int) -> DecisionTreeRegressor:
        c = self.config
        return DecisionTreeRegressor(
            featuresCol="features",
            labelCol=f"z{k}",
            weightCol=f"h{k}",
            maxDepth=c["max_depth"],
            maxBins=c["max_bins"],
            minInstancesPerNode=c["min_child_rows"],
            minInfoGain=c["min_split_gain"],
            seed=c["seed"],
            predictionCol="",
            leafCol=f"__leaf_{number}_{k}",
        )

    def grow(self, rows: DataFrame, rounds: int) -> tuple[PipelineModel, dict, list[float]]:
        """(trees, {start, values}, loss of the rows not learned from after each round); rows: features, label, weight, learn."""
        start = self.start(rows)
        rows = rows.withColumn("m", F.array(*[F.lit(s) for s in start]))
        trees, values, losses = [], [], []
        for r in range(rounds):
            sloped = self.derivatives(rows)
            learned = materialise(sloped.where("learn").select("features", *[f"{x}{k}" for k in range(self.size) for x in "zh"]))
            made = [self._tree(k, r).fit(learned) for k in range(self.size)]
            found = PipelineModel(made).transform(sloped)
            leaves = [f"__leaf_{r}_{k}" for k in range(self.size)]
            entries = ", ".join(f"struct({k} AS k, {leaf} AS leaf, g{k} AS g, h{k} AS h)" for k, leaf in enumerate(leaves))
            sums = found.where("learn").selectExpr(f"inline(array({entries}))").groupBy("k", "leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            steps = [[0.0] * ((t.numNodes + 1) // 2) for t in made]
            for s in sums:
                steps[s["k"]][int(s["leaf"])] = leaf_value(s["g"], s["h"], self.config)
            margins = F.array(*[F.col("m")[k] + leaf_step(leaf, steps[k]) for k, leaf in enumerate(leaves)])
            rows = materialise(found.select("features", "label", "weight", "learn", margins.alias("m")))
            trees += made
            values.append(steps)
            losses.append(self.loss(rows.where("NOT learn")))
        return PipelineModel(trees), {"start": start, "values": values}, losses

    def loss(self, rows: DataFrame) -> float:
        """Mean logarithmic loss, or mean squared error; nothing scored counts as no loss."""
        if self.classes:
            each = -F.log(F.greatest(F.element_at(softmax(F.col("m")), (F.col("label") + 1).cast("int")), F.lit(1e-15)))
        else:
            each = (F.col("label") - F.col("m")[0]) ** 2
        return rows.agg(F.try_divide(F.sum(each * F.col("weight")), F.sum("weight"))).first()[0] or 0.0

    def margins(self, state: dict) -> Column:
        """The margins of rows that the trees were applied to."""
        return F.array(*[sum((leaf_step(f"__leaf_{r}_{k}", steps[k]) for r, steps in enumerate(state["values"])), F.lit(state["start"][k])) for k in range(self.size)])


def leaf_step(leaf: str, steps: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(s)) for s in steps]), F.col(leaf).cast("int") + 1)
