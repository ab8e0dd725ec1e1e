"""Encoders, imputation and the skew-triggered logarithm."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import hash_bucket, sentinel_to_null
from ..operators.encode import CategoricalEncoder, Grouping, LeaveOneOut, OneHot, Ordinal, TargetMean, factor_codes, unseen_levels
from ..operators.generate import SkewLog
from ..operators.impute import MissingValuesImputer
from .aggregates import bucket_sql
from .base import labelled_documents, query, table


def parts(spark, sf):
    """Parts with a brand that is sometimes missing."""
    return table(spark, sf, "part").withColumn("p_brand", sentinel_to_null("p_brand", "Brand#7"))


PART = "(select * replace (nullif(p_brand, 'Brand#7') as p_brand) from part)"


@query(
    "ordinal_encode",
    f"""with l as (select level, row_number() over (order by level) - 1 as code from (select distinct coalesce(p_brand, 'NA') as level from {PART}))
    select p_partkey, code::bigint as "p_brand_OrdinalEncoder" from {PART} join l on coalesce(p_brand, 'NA') = level""",
)
def ordinal_encode(spark, sf):
    df = parts(spark, sf).select("p_partkey", "p_brand")
    return CategoricalEncoder(["p_brand"], [Ordinal()]).fit(df).transform(df)


@query(
    "ordinal_unseen",
    f"""with l as (select level, row_number() over (order by level) - 1 as code
    from (select distinct coalesce(p_brand, 'NA') as level from {PART} where {bucket_sql('p_partkey', 100, 0)} = 0))
    select p_partkey, code::bigint as "p_brand_OrdinalEncoder" from {PART} left join l on coalesce(p_brand, 'NA') = level""",
)
def ordinal_unseen(spark, sf):
    df = parts(spark, sf).select("p_partkey", "p_brand")
    return CategoricalEncoder(["p_brand"], [Ordinal()]).fit(df.where(hash_bucket("p_partkey", 100) == 0)).transform(df)


@query("factor_codes", "select p_type as level, row_number() over (order by p_type) as code from (select distinct p_type from part)")
def factors(spark, sf):
    return factor_codes(table(spark, sf, "part"), "p_type")


@query(
    "unseen_levels",
    f"""select distinct p_brand || ' ' || p_name as level from part where {bucket_sql('p_partkey', 2, 0)} = 0
    except select p_brand || ' ' || p_name from part where {bucket_sql('p_partkey', 2, 0)} = 1""",
)
def unseen(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit(" "), "p_name").alias("level"))
    return unseen_levels(df.where(hash_bucket("p_partkey", 2) == 0), df.where(hash_bucket("p_partkey", 2) == 1), "level")


def grouped_sql(column: str, kept: str, source: str) -> str:
    """Codes of a grouped column: kept levels and OTHER in sorted order."""
    return f"""with c as (select {column} as level, count(*) as n from {source} group by 1),
    r as (select *, row_number() over (order by n desc, level) as rank, sum(n) over (order by n desc, level rows unbounded preceding) as running, sum(n) over () as total from c),
    g as (select p_partkey, case when level is null then 'OTHER' else level end as level from {source} left join (select level from r where {kept}) k on {column} = level),
    l as (select level, row_number() over (order by level) - 1 as code from (select distinct level from g))
    select p_partkey, code::bigint as "{column}_GroupingEncoder" from g join l using (level)"""


@query("grouping_topk", grouped_sql("p_name", "rank <= 10", "part"))
def grouping_topk(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    return CategoricalEncoder(["p_name"], [Grouping(Ordinal(), 10)]).fit(df).transform(df)


@query("grouping_share", grouped_sql("p_name", "running < 0.4 * total", "part"))
def grouping_share(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    return CategoricalEncoder(["p_name"], [Grouping(Ordinal(), 0.4)]).fit(df).transform(df)


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "one_hot",
    "select p_partkey, "
    + ", ".join(f"(p_type = '{t}')::int as \"p_type_{t}\"" for t in TYPES)
    + ", coalesce(p_brand = 'Brand#1', false)::int as first_brand from part",
)
def one_hot(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_type", F.when(F.col("p_brand") == "Brand#1", F.lit("yes")).otherwise(F.lit("no")).alias("first"))
    out = CategoricalEncoder(["p_type", "first"], [OneHot(), OneHot()]).fit(df).transform(df)
    return out.withColumnRenamed("first_LabelBinarizer", "first_brand")


@query(
    "one_hot_sparse",
    """with c as (select p_name, row_number() over (order by p_name) - 1 as code, count(*) over () as size
    from (select distinct coalesce(p_name, 'NA') as p_name from part))
    select p_partkey, size::int as size, code::int as place, 1.0::double as value from part p join c on c.p_name = coalesce(p.p_name, 'NA')""",
    "value",
)
def one_hot_sparse(spark, sf):
    """Every name of a part is a place of one sparse vector."""
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    out = CategoricalEncoder(["p_name"], [OneHot(sparse=True)]).fit(df).transform(df)
    vector = F.unwrap_udt("p_name_LabelBinarizer")
    return out.select("p_partkey", vector["size"].alias("size"), vector["indices"][0].alias("place"), vector["values"][0].alias("value"))


@query(
    "multi_encode",
    f"""with m as (select coalesce(p_brand, 'NA') as b, avg(p_size)::double as mean from {PART} group by 1),
    l as (select b, row_number() over (order by b) - 1 as code from m)
    select p_partkey, code::bigint as "p_brand_OrdinalEncoder", mean as "p_brand_TargetAvgEncoder",
    {", ".join(f"(p_type = '{t}')::int as " + chr(34) + f"p_type_{t}" + chr(34) for t in TYPES)}
    from {PART} join m on coalesce(p_brand, 'NA') = m.b join l using (b)""",
    "p_brand_TargetAvgEncoder",
)
def multi_encode(spark, sf):
    df = parts(spark, sf).select("p_partkey", "p_brand", "p_type", "p_size")
    stage = CategoricalEncoder(["p_brand", "p_brand", "p_type"], [Ordinal(), TargetMean(), OneHot()], label="p_size")
    return stage.fit(df).transform(df).drop("p_size")


SOURCE_MEANS = "(select source, sum(quality) as s, count(quality) as n from documents join labels using (doc_id) group by 1)"
OVERALL = "(select avg(quality)::double from documents join labels using (doc_id))"


@query(
    "target_mean",
    f'select doc_id, coalesce(s::double / n, {OVERALL}) as "source_TargetAvgEncoder" from documents left join {SOURCE_MEANS} using (source)',
    "source_TargetAvgEncoder",
)
def target_mean(spark, sf):
    train = labelled_documents(spark, sf, "inner").select("doc_id", "source", "quality")
    model = CategoricalEncoder(["source"], [TargetMean()], label="quality").fit(train)
    return model.transform(table(spark, sf, "documents").select("doc_id", "source"))


# The first word as level: some occur once.
FIRST_WORDS = "split_part(text, ' ', 1)"
LOO = f"(select doc_id, {FIRST_WORDS} as w, quality from documents left join labels using (doc_id))"
LOO_LEVELS = f"(select w, sum(quality) as s, count(quality) as n from {LOO} where quality is not null group by 1)"


def _loo(spark, sf):
    df = labelled_documents(spark, sf).select("doc_id", F.substring_index("text", " ", 1).alias("w"), "quality")
    train = df.where("quality is not null")
    return CategoricalEncoder(["w"], [LeaveOneOut(noise=False)], label="quality").fit(train), train, df


@query(
    "leave_one_out",
    f"""select doc_id, quality, case when n > 1 then (s - quality)::double / (n - 1) else {OVERALL} end as "w_LeaveOneOutEncoder"
    from {LOO} join {LOO_LEVELS} using (w) where quality is not null""",
    "w_LeaveOneOutEncoder",
)
def leave_one_out(spark, sf):
    model, train, _ = _loo(spark, sf)
    return model.transform_training(train)


@query(
    "leave_one_out_score",
    f"""select doc_id, case when n > 1 then s::double / n else {OVERALL} end as "w_LeaveOneOutEncoder"
    from {LOO} left join {LOO_LEVELS} using (w)""",
    "w_LeaveOneOutEncoder",
)
def leave_one_out_score(spark, sf):
    model, _, df = _loo(spark, sf)
    return model.transform(df.drop("quality"))


# -- imputation ---------------------------------------------------------------------

GAPS = """(select l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) as d, nullif(l_quantity, 50) as q, nullif(l_returnflag, 'N') as f from lineitem)"""


def gaps(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        sentinel_to_null("l_discount", 0.0).alias("d"),
        sentinel_to_null("l_quantity", 50.0).alias("q"),
        sentinel_to_null("l_returnflag", "N").alias("f"),
    )


def impute_sql(d: str, q: str) -> str:
    return f"select l_orderkey, l_linenumber, l_partkey, coalesce(d, {d}) as d, coalesce(q, {q}) as q, coalesce(f, 'NA') as f from {GAPS}"


@query("impute_mean", impute_sql(f"(select avg(d) from {GAPS})", f"(select avg(q) from {GAPS})"), "d q")
def impute_mean(spark, sf):
    df = gaps(spark, sf)
    return MissingValuesImputer("mean", columns=["d", "q", "f"]).fit(df).transform(df)


@query("impute_median", impute_sql(f"(select median(d) from {GAPS})", f"(select median(q) from {GAPS})"), "d q")
def impute_median(spark, sf):
    df = gaps(spark, sf)
    return MissingValuesImputer("median", columns=["d", "q", "f"]).fit(df).transform(df)


@query("impute_const", impute_sql("-999", "-999"), "d q")
def impute_const(spark, sf):
    df = gaps(spark, sf)
    return MissingValuesImputer(-999, columns=["d", "q", "f"]).fit(df).transform(df)


@query("skew_log", "select event_id, user_id, sign(value)::double * ln(1 + abs(value)) as value from events", "value")
def skew_log(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return SkewLog(threshold=1.5, ignore=["event_id"]).fit(df).transform(df)
