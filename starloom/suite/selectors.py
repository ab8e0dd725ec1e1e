"""Column selection: what each selector decided, beside the statistic it used."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as S
from .base import labelled_documents, query, table

# A wide table with a constant, an empty, a sparse, a doubled and a re-coded column.
WIDE = """(select l_orderkey, l_quantity, l_discount, l_tax, 2 * l_quantity as twice, 'x' || l_quantity::int as coded, 1 as one, null::double as nothing,
    case when l_linenumber = 7 and l_quantity > 40 then 1.0 end as sparse, l_discount / 1000 as tiny from lineitem)"""
COLUMNS = ["l_quantity", "l_discount", "l_tax", "twice", "coded", "one", "nothing", "sparse", "tiny"]
NUMBERS = [c for c in COLUMNS if c != "coded"]


def wide(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_discount",
        "l_tax",
        (2 * q).alias("twice"),
        F.concat(F.lit("x"), q.cast("int").cast("string")).alias("coded"),
        F.lit(1).alias("one"),
        F.lit(None).cast("double").alias("nothing"),
        F.when((F.col("l_linenumber") == 7) & (q > 40), F.lit(1.0)).alias("sparse"),
        (F.col("l_discount") / 1000).alias("tiny"),
    )


def report_sql(kept: str) -> str:
    """(feature, kept, null_share, nb_distinct, variance); ``kept`` speaks of those columns."""
    parts = []
    for c in COLUMNS:
        variance = f"var_pop({c})" if c in NUMBERS else "null::double"
        parts.append(f"select '{c}' as feature, 1 - count({c})::double / count(*) as null_share, count(distinct {c}) as nb_distinct, {variance} as variance from {WIDE}")
    return f"select feature, ({kept})::int as kept, null_share, nb_distinct, variance from ({' union all '.join(parts)})"


def report(spark, sf, stage):
    df = wide(spark, sf)
    return S.selection_report(df, stage.fit(df), COLUMNS)


@query("constant_cols", report_sql("nb_distinct > 1"), "null_share variance")
def constant_cols(spark, sf):
    return report(spark, sf, S.ConstantDrop())


@query("variance_filter", report_sql("feature = 'coded' or coalesce(variance, 0) > 0.001"), "null_share variance")
def variance_filter(spark, sf):
    return report(spark, sf, S.VarianceSelect(0.001))


@query("null_share_filter", report_sql("null_share < 0.85"), "null_share variance")
def null_share_filter(spark, sf):
    return report(spark, sf, S.NullShareSelect(0.85))


@query("duplicate_cols", report_sql("feature not in ('twice', 'coded', 'tiny')"), "null_share variance")
def duplicate_cols(spark, sf):
    return report(spark, sf, S.DuplicateDrop(ignore=["l_orderkey"]))


@query("drop_listed", "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem", "l_quantity")
def drop_listed(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    return S.DropListed(["l_tax", "not_there"]).transform(df)


def text_numbers(spark, sf):
    """All documents, labelled or not, with a few numbers taken from their text."""
    t = F.col("text")
    return labelled_documents(spark, sf).select(
        "doc_id",
        "quality",
        "toxic",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.log1p("n_chars").alias("log_chars"),
        F.size(F.split(t, " ")).cast("double").alias("n_tokens"),
        F.regexp_count(t, F.lit("[0-9]")).cast("double").alias("n_digits"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("double").alias("n_upper"),
        F.regexp_count(t, F.lit(r"[.,!?;:]")).cast("double").alias("n_marks"),
        (F.regexp_count(t, F.lit(r"\n")) + 1).cast("double").alias("n_lines"),
    )


TEXT_NUMBERS = ["n_chars", "log_chars", "n_tokens", "n_digits", "n_upper", "n_marks", "n_lines"]


@query("l1_filter")
def l1_filter(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")
    model = S.L1Select("l_extendedprice", penalty=50.0).fit(df)
    weights = [(c, float(w), int(c not in model.state["dropped"])) for c, w in model.state["weights"].items()]
    return spark.createDataFrame(weights, "feature string, weight double, kept int")


def embedding_columns(spark, sf):
    """The embeddings, one column for each dimension they have."""
    vectors = table(spark, sf, "embeddings")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"e{i}" for i in range(size)]
    return vectors.select("vec_id", *[F.coalesce(F.get("embedding", i), F.lit(0.0)).cast("double").alias(c) for i, c in enumerate(names)]), names


@query("pca")
def pca(spark, sf):
    df, names = embedding_columns(spark, sf)
    out = S.principal_components(df, names, 7, ["vec_id"])
    return out.select("vec_id", *[F.abs(F.get("components", i)).alias(f"pc{i}") for i in range(7)])


@query(
    "pca_variance",
    """with x as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
    v as (select i, var_pop(x) as v from x group by i)
    select (select count(*) from embeddings) as vectors, count(*) as components, sum(v) as variance, true as falling, true as uncorrelated from v""",
    "variance",
)
def pca_variance(spark, sf):
    """All components together keep the variance; each has no more than the one before, and none goes with the first."""
    df, names = embedding_columns(spark, sf)
    out = S.principal_components(df, names, len(names), ["vec_id"])
    stats = [e for i in range(len(names)) for e in (F.var_pop(F.get("components", i)), F.corr(F.get("components", 0), F.get("components", i)))]
    row = out.agg(F.count("*"), F.array(*stats[::2]).alias("v"), F.array(*stats[1::2]).alias("r")).first()
    falling = all(a >= b - 1e-9 for a, b in zip(row["v"], row["v"][1:]))
    uncorrelated = all(abs(r) < 1e-6 for r in row["r"][1:])
    return spark.createDataFrame([(row[0], len(names), sum(row["v"]), falling, uncorrelated)], "vectors bigint, components bigint, variance double, falling boolean, uncorrelated boolean")


@query("importance_filter")
def importance_filter(spark, sf):
    df = text_numbers(spark, sf)
    model = S.ImportanceSelect("quality", 0.6, rounds=10, columns=TEXT_NUMBERS, key="doc_id", max_depth=3).fit(df)
    return model.transform(df)


