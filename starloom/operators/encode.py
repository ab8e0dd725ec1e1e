"""Encoders of categorical columns.

All columns are fitted together: one pass turns them into narrow (column, level) rows,
counted before the shuffle, and every encoder derives its lookup table from those counts.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sqltext
from ..functions.semantics import as_col, flag
from .aggregate import MAX_LEVELS
from .ordered import OrderedGroups
from .stage import FeatureStage, FittedStage
from .tables import BROADCAST_ROWS, SizedTable, materialise, rows_if_small

# -- what an encoder is ---------------------------------------------------------


@dataclass
class Ordinal:
    """Sorted level -> 0..n-1, or a given map; unseen -> NULL."""

    mapping: dict | None = None
    suffix = "OrdinalEncoder"


@dataclass
class OneHot:
    """One 0/1 column per level; a single column when there are exactly two levels.

    ``sparse`` gives one sparse vector instead, as long as the levels are many, without any limit on them; its places
    are the levels in order, and an unseen level is the zero vector.
    """

    sparse: bool = False
    suffix = "LabelBinarizer"


@dataclass
class TargetMean:
    """Level -> mean label; unseen -> overall mean."""

    suffix = "TargetAvgEncoder"


@dataclass
class LeaveOneOut:
    """Training rows: mean label of the level's other rows, optionally with noise around 1.

    Scoring rows get the level mean, unseen levels and levels of one row the overall mean.
    """

    noise: bool = True
    sigma: float = 0.05
    seed: int = 0
    suffix = "LeaveOneOutEncoder"


@dataclass
class Grouping:
    """Keep the most frequent levels and pass the rest on as one level to another encoder.

    ``threshold``: how many levels (whole number from 2), or the share of rows (0 to 1)
    below which the running count of kept levels must stay.
    """

    inner: Ordinal | OneHot | TargetMean | LeaveOneOut
    threshold: int | float
    other: str = "OTHER"
    suffix = "GroupingEncoder"


_KINDS = {c.__name__: c for c in (Ordinal, OneHot, TargetMean, LeaveOneOut, Grouping)}


def _to_json(e) -> dict:
    out = asdict(e)
    if isinstance(e, Grouping):
        out["inner"] = _to_json(e.inner)
    return {"kind": type(e).__name__, **out}


def _from_json(d: dict):
    d = dict(d)
    kind = _KINDS[d.pop("kind")]
    if kind is Grouping:
        d["inner"] = _from_json(d["inner"])
    return kind(**d)


# -- level statistics -----------------------------------------------------------


def level_statistics(df: DataFrame, columns: list[str], label: str | None, missing: str | None) -> DataFrame:
    """(column, level, n, labelled, label_sum): one row per level of every column."""
    y = as_col(label).cast("double") if label else F.lit(None).cast("double")

    def level(c):
        text = as_col(c).cast("string")
        return F.coalesce(text, F.lit(missing)) if missing is not None else text

    entries = [F.struct(F.lit(i).alias("column"), level(c).alias("level")) for i, c in enumerate(columns)]
    rows = df.select(y.alias("y"), F.inline(F.array(*entries))).where(F.col("level").isNotNull())
    return rows.groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n"), F.count("y").alias("labelled"), F.sum("y").alias("label_sum")
    )


def ordinal_codes(levels: DataFrame) -> SizedTable:
    """(level, code) with codes 0..n-1 in sorted order."""
    rows = rows_if_small(levels.select("level"))
    spark = levels.sparkSession
    if rows is None:
        coded = OrderedGroups(levels.select("level"), [], ["level"]).position("code")
        return SizedTable(materialise(coded), None)
    names = _sorted(r[0] for r in rows)
    return SizedTable.from_rows(spark, [(v, i) for i, v in enumerate(names)], "level string, code bigint")


def kept_levels(levels: DataFrame, threshold: int | float) -> DataFrame:
    """Levels a Grouping keeps: the most frequent, ties in level order."""
    if check_threshold(threshold):
        return levels.orderBy(F.desc("n"), "level").limit(threshold)
    total = levels.agg(F.sum("n")).first()[0] or 0
    run = OrderedGroups(levels, [], ["-n", "level"]).running_sum({"running": F.col("n")})
    return run.where(F.col("running") < F.lit(float(threshold)) * F.lit(total)).drop("running")


def unseen_levels(new: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """Levels of new data that the fitted data does not hold."""
    a = new.where(as_col(column).isNotNull()).select(as_col(column)).distinct()
    return a.join(fitted.select(as_col(column)).distinct(), column, "left_anti")


def factor_codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code): level codes from 1 in sorted order."""
    levels = df.where(as_col(column).isNotNull()).select(as_col(column).cast("string").alias("level")).distinct()
    return ordinal_codes(levels).df.select("level", (F.col("code") + 1).alias("code"))


# -- the stage ------------------------------------------------------------------


class CategoricalEncoder(FeatureStage):
    """Encoder i on column i; NULL is the level ``missing``; a column may appear twice."""

    def __init__(self, columns, encoders, label=None, missing="NA", drop_inputs=True):
        encoders = [_to_json(e) if not isinstance(e, dict) else e for e in encoders]
        if len(columns) != len(encoders):
            raise ValueError("as many encoders as columns are needed")
        super().__init__(columns=list(columns), encoders=encoders, label=label, missing=missing, drop_inputs=drop_inputs)

    def _fit(self, dataset: DataFrame) -> CategoricalEncoderModel:
        cfg = self.config
        columns = list(dict.fromkeys(cfg["columns"]))
        spark = dataset.sparkSession
        stats = level_statistics(dataset, columns, cfg["label"], cfg["missing"])
        table = SizedTable.of(stats, BROADCAST_ROWS)
        state, tables = {"plans": []}, {}
        by_column: dict[int, list] = {}
        for r in table.rows or []:
            by_column.setdefault(r[0], []).append(tuple(r)[1:])
        for i, (c, spec) in enumerate(zip(cfg["columns"], cfg["encoders"])):
            at = columns.index(c)
            if table.small:
                fitted = _fit_rows(_from_json(spec), by_column.get(at, []), f"t{i}", tables, spark)
            else:
                levels = table.df.where(F.col("column") == at).drop("column")
                fitted = _fit_levels(_from_json(spec), levels, f"t{i}", tables)
            state["plans"].append(fitted)
        return CategoricalEncoderModel(cfg, state, tables)


def _sorted(levels) -> list[str]:
    return sorted(levels, key=lambda v: v.encode())


def _fit_rows(encoder, rows: list[tuple], name: str, tables: dict[str, SizedTable], spark) -> dict:
    """What an encoder learns from (level, n, labelled, label_sum) rows on the driver."""
    plan = {}
    if isinstance(encoder, Grouping):
        kept, running = set(), 0
        total, few = sum(r[1] for r in rows), check_threshold(encoder.threshold)
        for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0].encode()))):
            running += r[1]
            if i < encoder.threshold if few else running < encoder.threshold * total:
                kept.add(r[0])
        tables[f"{name}_kept"] = SizedTable.from_rows(spark, [(v, v) for v in _sorted(kept)], "level string, kept string")
        merged: dict[str, tuple] = {}
        for level, *values in rows:
            to = level if level in kept else encoder.other
            merged[to] = tuple((a or 0) + (b or 0) for a, b in zip(merged.get(to, (0, 0, 0)), values))
        rows, encoder = [(level, *v) for level, v in merged.items()], encoder.inner
    levels = _sorted(r[0] for r in rows)
    if isinstance(encoder, Ordinal):
        codes = [(str(k), int(v)) for k, v in encoder.mapping.items()] if encoder.mapping is not None else [(v, i) for i, v in enumerate(levels)]
        tables[name] = SizedTable.from_rows(spark, codes, "level string, code bigint")
    elif isinstance(encoder, OneHot) and encoder.sparse:
        plan["size"] = len(levels)
        tables[name] = SizedTable.from_rows(spark, [(v, i) for i, v in enumerate(levels)], "level string, code bigint")
    elif isinstance(encoder, OneHot):
        check_levels(len(levels))
        plan["levels"] = levels
    else:
        labelled = sum(r[2] for r in rows)
        plan["mean"] = sum(r[3] or 0.0 for r in rows) / labelled if labelled else None
        sums = [(r[0], r[2], float(r[3])) for r in rows if r[2] > 0]
        tables[name] = SizedTable.from_rows(spark, sums, "level string, labelled bigint, label_sum double")
    return plan


def sparse_unit(code: str, size: int) -> Column:
    """Spark ML's sparse vector with a one at the place ``code``, or the zero vector for NULL; made in the JVM."""
    at, value = F.coalesce(as_col(code).cast("string"), F.lit("")), F.when(as_col(code).isNotNull(), F.lit("1.0")).otherwise(F.lit(""))
    text = F.concat(F.lit(f'{{"v":{{"type":0,"size":{size},"indices":['), at, F.lit('],"values":['), value, F.lit("]}}"))
    return F.from_json(text, T.StructType([T.StructField("v", VectorUDT())]))["v"]


def check_levels(n: int) -> None:
    if n > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels cannot become columns, take OneHot(sparse=True)")


def check_threshold(threshold: int | float) -> bool:
    """True for a number of levels, False for a share of rows."""
    if isinstance(threshold, int) and threshold >= 2:
        return True
    if isinstance(threshold, float) and 0 < threshold < 1:
        return False
    raise ValueError("threshold is a whole number from 2 or a share between 0 and 1")


def _fit_levels(encoder, levels: DataFrame, name: str, tables: dict[str, SizedTable]) -> dict:
    """The same from a level table too large for the driver."""
    plan = {}
    if isinstance(encoder, Grouping):
        kept = SizedTable.of(kept_levels(levels, encoder.threshold).select("level", F.col("level").alias("kept")))
        tables[f"{name}_kept"] = kept
        to = F.coalesce(F.col("kept"), F.lit(encoder.other)).alias("level")
        merged = kept.lookup(levels, {"level": "level"}, {"kept": "kept"}).select(to, "n", "labelled", "label_sum")
        sums = [F.sum(v).alias(v) for v in ("n", "labelled", "label_sum")]
        levels, encoder = merged.groupBy("level").agg(*sums), encoder.inner
    if isinstance(encoder, Ordinal):
        if encoder.mapping is not None:
            rows = [(str(k), int(v)) for k, v in encoder.mapping.items()]
            tables[name] = SizedTable.from_rows(levels.sparkSession, rows, "level string, code bigint")
        else:
            tables[name] = ordinal_codes(levels)
    elif isinstance(encoder, OneHot) and encoder.sparse:
        tables[name] = ordinal_codes(levels)
        plan["size"] = tables[name].df.count()
    elif isinstance(encoder, OneHot):
        found = rows_if_small(levels.select("level"), MAX_LEVELS)
        check_levels(MAX_LEVELS + 1 if found is None else len(found))
        plan["levels"] = _sorted(r[0] for r in found)
    else:
        total = levels.agg(F.sum("label_sum"), F.sum("labelled")).first()
        plan["mean"] = total[0] / total[1] if total[1] else None
        tables[name] = SizedTable.of(levels.where("labelled > 0").select("level", "labelled", "label_sum"))
    return plan


class CategoricalEncoderModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._encode(dataset, training=False)

    def transform_training(self, dataset: DataFrame) -> DataFrame:
        """Encode the rows the stage was fitted on: their own label is left out."""
        return self._encode(dataset, training=True)

    def _encode(self, df: DataFrame, training: bool) -> DataFrame:
        cfg = self.config
        originals, added = list(df.columns), []
        if cfg["missing"] is not None:
            fill = {c: F.coalesce(as_col(c).cast("string"), F.lit(cfg["missing"])) for c in dict.fromkeys(cfg["columns"])}
            df = df.withColumns(fill)
        for i, (c, spec) in enumerate(zip(cfg["columns"], cfg["encoders"])):
            encoder, plan = _from_json(spec), self.state["plans"][i]
            df, new = self._encode_one(df, c, encoder, plan, f"t{i}", training)
            added += new
        keep = [c for c in originals if not (cfg["drop_inputs"] and c in cfg["columns"])]
        return df.selectExpr(*map(sqltext.name, keep + added))

    def _encode_one(self, df, c, encoder, plan, name, training):
        outer, source = encoder, c
        if isinstance(encoder, Grouping):
            source = f"__level_{name}"
            df = self.tables[f"{name}_kept"].lookup(df, {c: "level"}, {"kept": source})
            df = df.withColumn(source, F.coalesce(as_col(source), F.lit(encoder.other)))
            encoder = encoder.inner
        out = f"{c}_{outer.suffix}"
        if isinstance(encoder, OneHot) and encoder.sparse:
            code = f"__code_{name}"
            df = self.tables[name].lookup(df, {source: "level"}, {"code": code})
            return df.withColumn(out, sparse_unit(code, plan["size"])).drop(code), [out]
        if isinstance(encoder, OneHot):
            levels = plan["levels"]
            if len(levels) <= 2:
                hit = flag(as_col(source) == F.lit(levels[1])) if len(levels) == 2 else F.lit(0)
                return df.withColumn(out, hit), [out]
            cols = {f"{c}_{v}": sqltext.flag(f"{sqltext.name(source)} = {sqltext.literal(v)}") for v in levels}
            return df.selectExpr("*", *sqltext.named(cols)), list(cols)
        if isinstance(encoder, Ordinal):
            return self.tables[name].lookup(df, {source: "level"}, {"code": out}), [out]
        values = {"labelled": f"__n_{name}", "label_sum": f"__s_{name}"}
        df = self.tables[name].lookup(df, {source: "level"}, values)
        n, s = as_col(f"__n_{name}"), as_col(f"__s_{name}")
        mean = F.lit(plan["mean"]).cast("double")
        value: Column = F.coalesce(F.try_divide(s, n), mean)
        if isinstance(encoder, LeaveOneOut):
            value = F.when(n == 1, mean).otherwise(value)
            if training:
                y = as_col(self.config["label"]).cast("double")
                value = F.coalesce(F.when(n > 1, (s - y) / (n - 1)), F.when(y.isNull(), value), mean)
                if encoder.noise:
                    value = value * (F.lit(1.0) + F.lit(float(encoder.sigma)) * F.randn(encoder.seed))
        return df.withColumn(out, value).drop(*values.values()), [out]


# -- level reports --------------------------------------------------------------


def top_levels(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent levels with their row counts."""
    counts = df.where(as_col(column).isNotNull()).groupBy(as_col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "level").limit(k)


def sample_per_class(df: DataFrame, label: str, order: str, m: int) -> DataFrame:
    """The first m rows of each class in the order of a hash column."""
    w = W.partitionBy(as_col(label)).orderBy(as_col(order))
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= m).drop("__rank")
