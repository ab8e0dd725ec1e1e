"""Aggregates, profiles, pivots and joins of reduced tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import day_offset
from ..functions.semantics import as_col, differs, finite, hash_bucket, md5_of, null_outside, ratio, sentinel_to_null
from ..operators import aggregate as A
from ..operators.encode import sample_per_class
from ..operators.tables import attach_group_values, prefixed, star_join
from .base import labelled_documents, lines_with_customer, query, sql_six, table

DAY = "datediff('day', date '1995-01-01', o_orderdate::date)::int"
SIX_ORDERS, D_ORDERS = sql_six({"o_totalprice": "d", "day": "i"})
SIX_EVENTS, D_EVENTS = sql_six({"value": "d"})


def orders_with_day(spark, sf):
    return table(spark, sf, "orders").withColumn("day", day_offset("o_orderdate", "1995-01-01"))


@query("bulk_stats", f"select o_custkey, {SIX_ORDERS} from (select *, {DAY} as day from orders) group by 1", D_ORDERS)
def bulk_stats(spark, sf):
    return A.bulk_stats(orders_with_day(spark, sf), ["o_custkey"], ["o_totalprice", "day"])


@query(
    "bulk_stats_events",
    f"""select user_id, {SIX_EVENTS}, count(distinct event_type) as event_type_nunique, count(*) as n_rows,
    count(nullif(event_type, 'view')) as n_not_view from events group by 1""",
    D_EVENTS,
)
def bulk_stats_events(spark, sf):
    extra = [F.count(F.lit(1)).alias("n_rows"), F.count(sentinel_to_null("event_type", "view")).alias("n_not_view")]
    return A.bulk_stats(table(spark, sf, "events"), ["user_id"], ["value"], extra=extra, distinct_only=["event_type"])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "pivot_counts",
    "select user_id, "
    + ", ".join(f"nullif(count(*) filter (event_type = '{t}'), 0) as event_type_{t}" for t in EVENT_TYPES)
    + " from events group by 1",
)
def pivot_counts(spark, sf):
    return A.pivot_counts(table(spark, sf, "events"), ["user_id"], "event_type")


@query(
    "pivot_counts_zero",
    "select o_custkey, " + ", ".join(f"count(*) filter (o_orderstatus = '{t}') as o_orderstatus_{t}" for t in "FOP") + " from orders group by 1",
)
def pivot_counts_zero(spark, sf):
    return A.pivot_counts(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", absent=0)


@query(
    "two_level_max_sum",
    """select o_custkey, sum(m) as total_max_quantity from
    (select l_orderkey, max(l_quantity) as m from lineitem group by 1) join orders on l_orderkey = o_orderkey group by 1""",
    "total_max_quantity",
)
def two_level_max_sum(spark, sf):
    # The first level is grouped before the join, so the join meets one row per order on both sides.
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("m"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return per_order.join(orders, "l_orderkey").groupBy("o_custkey").agg(F.sum("m").alias("total_max_quantity"))


@query(
    "two_level_ratio_mean",
    """select user_id, avg(r) as mean_ratio from (select user_id, event_type, max(value) / nullif(max(k), 0) as r
    from (select *, (event_id % 5)::bigint as k from events) group by 1, 2) group by 1""",
    "mean_ratio",
)
def two_level_ratio_mean(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.col("event_id") % 5)
    first = [ratio(F.max("value"), F.max("k")).alias("r")]
    return A.two_level(df, ["user_id"], ["event_type"], first, [F.avg("r").alias("mean_ratio")])


@query(
    "two_level_flag_mean",
    """select user_id, avg(n)::double as mean_count from (select user_id, event_type,
    sum(case when nullif(event_id % 5, 4) <> 0 or nullif(event_id % 5, 4) is null then 1 else 0 end) as n
    from events group by 1, 2) group by 1""",
    "mean_count",
)
def two_level_flag_mean(spark, sf):
    df = table(spark, sf, "events").withColumn("k", sentinel_to_null(F.col("event_id") % 5, 4))
    return A.two_level(df, ["user_id"], ["event_type"], [F.sum(differs("k", 0)).alias("n")], [F.avg("n").alias("mean_count")])


@query(
    "cond_percentage",
    """select o_custkey, 100.0::double * count(*) filter (l_returnflag = 'R') / count(*) as pct_returned
    from lineitem join orders on l_orderkey = o_orderkey group by 1""",
    "pct_returned",
)
def cond_percentage(spark, sf):
    return lines_with_customer(spark, sf).groupBy("o_custkey").agg(A.conditional_percentage(F.col("l_returnflag") == "R").alias("pct_returned"))


@query(
    "cond_sum",
    """select o_custkey, sum(case when l_returnflag = 'R' then l_extendedprice else 0 end) as returned_amount
    from lineitem join orders on l_orderkey = o_orderkey group by 1""",
    "returned_amount",
)
def cond_sum(spark, sf):
    total = A.conditional_sum("l_extendedprice", F.col("l_returnflag") == "R")
    return lines_with_customer(spark, sf).groupBy("o_custkey").agg(total.alias("returned_amount"))


@query(
    "active_share",
    """select user_id, avg(case when e is null or e <> 'view' then 1 else 0 end)::double as active_share
    from (select user_id, nullif(event_type, 'error') as e from events) group by 1""",
    "active_share",
)
def active_share(spark, sf):
    df = table(spark, sf, "events").withColumn("e", sentinel_to_null("event_type", "error"))
    return df.groupBy("user_id").agg(A.share_where_differs("e", "view").alias("active_share"))


@query(
    "label_rate",
    "select lang, sum(coalesce(quality, 0))::double / count(*) as rate from documents left join labels using (doc_id) group by 1",
    "rate",
)
def label_rate(spark, sf):
    return A.label_rate(labelled_documents(spark, sf), "lang", "quality")


@query(
    "label_rate_labelled",
    "select source, sum(quality)::double / count(quality) as rate from documents left join labels using (doc_id) group by 1",
    "rate",
)
def label_rate_labelled(spark, sf):
    return A.label_rate(labelled_documents(spark, sf), "source", "quality", labelled_only=True)


@query(
    "label_rate_lookup",
    """with j as (select doc_id, lang, source, quality from documents left join labels using (doc_id)),
    a as (select lang, sum(coalesce(quality, 0))::double / count(*) as r from j group by 1),
    b as (select source, sum(coalesce(quality, 0))::double / count(*) as r from j group by 1)
    select doc_id, lang, source, a.r as "lang_TgtAvg", b.r as "source_TgtAvg" from j left join a using (lang) left join b using (source)""",
    "lang_TgtAvg source_TgtAvg",
)
def label_rate_lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    rates = A.keyed_label_rates(docs, "doc_id", ["lang", "source"], table(spark, sf, "labels"), "quality")
    return A.with_label_rates(docs, rates, ["lang", "source"])


@query(
    "group_simple",
    """select o_custkey, avg(o_totalprice) as o_totalprice_mean, sum(o_totalprice) as o_totalprice_sum, max(o_totalprice) as o_totalprice_max,
    count(distinct o_orderpriority) as o_orderpriority_nunique from orders group by 1""",
    "o_totalprice_mean o_totalprice_sum o_totalprice_max",
)
def group_simple(spark, sf):
    return A.bulk_stats(table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"], ("mean", "sum", "max"), distinct_only=["o_orderpriority"])


LINE_COLUMNS = {
    "l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1, "l_tax": 1,
    "l_returnflag": 0, "l_linestatus": 0,
}
NULLED = "(select * replace (nullif(l_discount, 0) as l_discount, nullif(l_returnflag, 'N') as l_returnflag) from lineitem)"


def _profile_sql() -> str:
    parts = []
    for c, number in LINE_COLUMNS.items():
        stats = f"avg({c})::double, var_pop({c}), skewness({c})" if number else "null::double, null::double, null::double"
        parts.append(
            f"select '{c}' as feature, count(*) as nb_rows, count(*) - count({c}) as nb_nas, count(distinct {c}) + max(({c} is null)::int)::bigint as nb_levels, "
            f"count(distinct {c}) as nb_distinct, (count(*) - count({c}))::double / count(*) as null_share, {stats} from {NULLED}"
        )
    sql = " union all ".join(parts)
    return f"select * from ({sql}) as u(feature, nb_rows, nb_nas, nb_levels, nb_distinct, null_share, mean, variance, skew)"


def nulled_lines(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE_COLUMNS)
    return df.withColumns({"l_discount": sentinel_to_null("l_discount", 0.0), "l_returnflag": sentinel_to_null("l_returnflag", "N")})


def relative(df):
    """Variances of keys grow with the data: compare them relative to the squared mean."""
    return df.withColumn("variance", F.try_divide("variance", F.col("mean") * F.col("mean")))


@query("column_profile", f"select * replace (variance / nullif(mean * mean, 0) as variance) from ({_profile_sql()})", "null_share mean variance skew")
def column_profile(spark, sf):
    return relative(A.column_profile(nulled_lines(spark, sf)))


CORRELATED = [c for c, n in LINE_COLUMNS.items() if n]


@query(
    "feature_report",
    f"select p.* replace (variance / nullif(mean * mean, 0) as variance), r as target_correlation from ({_profile_sql()}) p left join ("
    + " union all ".join(f"select '{c}' as feature, corr({c}, l_extendedprice) as r from {NULLED}" for c in CORRELATED)
    + ") using (feature) where nb_levels > 3",
    "null_share mean variance skew target_correlation",
)
def feature_report(spark, sf):
    report = A.feature_report(nulled_lines(spark, sf), list(LINE_COLUMNS), "l_extendedprice")
    return relative(report).where("nb_levels > 3")


@query(
    "crosstab_norm",
    """select l_returnflag, count(*) filter (l_linestatus = 'F')::double / count(*) as "l_linestatus_F",
    count(*) filter (l_linestatus = 'O')::double / count(*) as "l_linestatus_O" from lineitem group by 1""",
    "l_linestatus_F l_linestatus_O",
)
def crosstab_norm(spark, sf):
    return A.crosstab_shares(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("pivot_long", "select l_suppkey, l_partkey as level, count(*) as n from lineitem where l_partkey is not null group by 1, 2")
def pivot_long(spark, sf):
    """Every part a supplier delivered is a level."""
    return A.pivot_long(table(spark, sf, "lineitem"), ["l_suppkey"], "l_partkey")


@query(
    "crosstab_long",
    """select l_returnflag, l_partkey as level, count(*)::double / sum(count(*)) over (partition by l_returnflag) as share
    from lineitem where l_returnflag is not null and l_partkey is not null group by 1, 2""",
    "share",
)
def crosstab_long(spark, sf):
    return A.crosstab_long(table(spark, sf, "lineitem"), "l_returnflag", "l_partkey")


PAIRS = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]]
PAIR_SQL = " union all ".join(f"select '{a}' as feature_1, '{b}' as feature_2, corr({a}, {b}) as correlation from {NULLED}" for a, b in PAIRS)


@query("corr_pairs", PAIR_SQL, "correlation")
def corr_pairs(spark, sf):
    return A.correlation_pairs(nulled_lines(spark, sf), CORRELATED)


@query("corr_over_threshold", f"select * from ({PAIR_SQL}) where abs(correlation) > 0.6", "correlation")
def corr_over_threshold(spark, sf):
    return A.correlated_pairs(nulled_lines(spark, sf), CORRELATED, over=0.6)


LOGGED = ["l_quantity", "l_discount", "l_tax"]


@query(
    "log_effect",
    " union all ".join(
        f"select '{c}' as feature, corr({c}, l_extendedprice) as correlation, corr(ln(1 + {c}), l_extendedprice) as log_correlation from {NULLED}" for c in LOGGED
    ),
    "correlation log_correlation",
)
def log_effect(spark, sf):
    return A.log_effect(nulled_lines(spark, sf), LOGGED, "l_extendedprice")


@query(
    "histogram",
    """with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, (max(l_extendedprice) - min(l_extendedprice)) / 100 as w from lineitem),
    c as (select least(floor((l_extendedprice - lo) / w), 99)::int as bin, count(*) as n from lineitem, r group by 1)
    select g.i::int as bin, lo + g.i * w as low, lo + (g.i + 1) * w as high, coalesce(n, 0)::bigint as n
    from range(100) g(i), r left join c on c.bin = g.i""",
    "low high",
)
def histogram(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 100)


# -- joins of reduced tables ------------------------------------------------------

ORDER_STATS = "select o_custkey as k, avg(o_totalprice) as o_totalprice_mean, max(o_totalprice) as o_totalprice_max, count(*) as n_orders from orders group by 1"
LINE_STATS = "select o_custkey as k, sum(l_quantity) as l_quantity_sum, count(*) as n_lines from lineitem join orders on l_orderkey = o_orderkey group by 1"
EVENT_STATS = "select user_id as k, sum(value) as value_sum, count(*) as n_events from events group by 1"
STAR_DOUBLES = "orders_o_totalprice_mean orders_o_totalprice_max lines_l_quantity_sum events_value_sum"


def _parts(spark, sf):
    n = F.count(F.lit(1))
    orders = A.bulk_stats(table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"], ("mean", "max"), [n.alias("n_orders")])
    lines = A.bulk_stats(lines_with_customer(spark, sf), ["o_custkey"], ["l_quantity"], ("sum",), [n.alias("n_lines")])
    events = A.bulk_stats(table(spark, sf, "events"), ["user_id"], ["value"], ("sum",), [n.alias("n_events")])
    named = [(orders, "o_custkey", "orders_"), (lines, "o_custkey", "lines_"), (events, "user_id", "events_")]
    return [prefixed(d.withColumnRenamed(k, "c_custkey"), p, ["c_custkey"]) for d, k, p in named]


STAR_COLUMNS = """o.o_totalprice_mean as orders_o_totalprice_mean, o.o_totalprice_max as orders_o_totalprice_max, o.n_orders as orders_n_orders,
    l.l_quantity_sum as lines_l_quantity_sum, l.n_lines as lines_n_lines, e.value_sum as events_value_sum, e.n_events as events_n_events"""


@query(
    "star_assembly",
    f"select c_custkey, c_mktsegment, {STAR_COLUMNS} from customer left join ({ORDER_STATS}) o on c_custkey = o.k left join ({LINE_STATS}) l on c_custkey = l.k left join ({EVENT_STATS}) e on c_custkey = e.k",
    STAR_DOUBLES,
)
def star_assembly(spark, sf):
    parent = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return star_join(parent, _parts(spark, sf), "c_custkey")


@query(
    "star_outer",
    f"""select coalesce(o.k, l.k, e.k) as c_custkey, {STAR_COLUMNS} from ({ORDER_STATS}) o full join ({LINE_STATS}) l on o.k = l.k
    full join ({EVENT_STATS}) e on coalesce(o.k, l.k) = e.k""",
    STAR_DOUBLES,
)
def star_outer(spark, sf):
    first, *others = _parts(spark, sf)
    return star_join(first, others, "c_custkey", "full_outer")


@query(
    "composite_join",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, n_orders_of_pair, max_quantity from lineitem left join
    (select l_partkey as p, l_suppkey as s, count(distinct l_orderkey) as n_orders_of_pair, max(l_quantity) as max_quantity
    from lineitem where l_quantity > 25 group by 1, 2) on l_partkey = p and l_suppkey = s""",
    "max_quantity",
)
def composite_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    keys = ["l_partkey", "l_suppkey"]
    stats = A.bulk_stats(lines.where("l_quantity > 25"), keys, ["l_quantity"], ("max",), distinct_only=["l_orderkey"])
    stats = stats.withColumnsRenamed({"l_orderkey_nunique": "n_orders_of_pair", "l_quantity_max": "max_quantity"})
    return attach_group_values(lines.drop("l_quantity"), keys, stats)


@query(
    "class_sample_join",
    """with s as (select c_custkey, c_mktsegment from customer qualify row_number() over (partition by c_mktsegment
    order by md5('7|' || c_custkey)) <= 5)
    select c_custkey, c_mktsegment, o_orderkey, o_totalprice from s left join orders on c_custkey = o_custkey""",
    "o_totalprice",
)
def class_sample_join(spark, sf):
    customers = table(spark, sf, "customer").withColumn("h", md5_of("c_custkey", 7))
    sample = sample_per_class(customers, "c_mktsegment", "h", 5).select("c_custkey", "c_mktsegment")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return sample.join(orders, "c_custkey", "left")


def bucket_sql(key: str, n: int, seed) -> str:
    return f"((('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint) % {n})::int"


@query(
    "union_folds",
    f"""with b as (select *, {bucket_sql('o_orderkey', 3, 0)} as fold from orders)
    select o.o_orderkey, o.fold, m.mean_price as prediction from b o join
    (select f.fold, avg(b.o_totalprice) as mean_price from (select distinct fold from b) f join b on b.fold <> f.fold group by 1) m on m.fold = o.fold""",
    "prediction",
)
def union_folds(spark, sf):
    orders = table(spark, sf, "orders").withColumn("fold", hash_bucket("o_orderkey", 3))
    sums = orders.groupBy("fold").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    # each fold's sums go to every other fold: three rows become six
    given = sums.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("to <> fold")
    means = given.groupBy(F.col("to").alias("fold")).agg((F.sum("s") / F.sum("n")).alias("prediction"))
    return orders.join(F.broadcast(means), "fold").select("o_orderkey", "fold", "prediction")


@query(
    "sentinel_outlier_fill",
    """select l_orderkey, l_linenumber, l_partkey, nullif(l_quantity, 50) as quantity, case when l_extendedprice between 2000 and 60000 then l_extendedprice end as price,
    coalesce(nullif(l_returnflag, 'N'), 'missing') as returnflag, coalesce(l_extendedprice / nullif(l_discount, 0), 0) as per_discount,
    trunc(coalesce(-l_extendedprice / nullif(l_tax, 0), 0))::bigint as per_tax from lineitem""",
    "quantity price per_discount",
)
def sentinel_outlier_fill(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        sentinel_to_null("l_quantity", 50.0).alias("quantity"),
        null_outside("l_extendedprice", 2000, 60000).alias("price"),
        F.coalesce(sentinel_to_null("l_returnflag", "N"), F.lit("missing")).alias("returnflag"),
        F.coalesce(finite(ratio("l_extendedprice", "l_discount", mode="ieee")), F.lit(0.0)).alias("per_discount"),
        F.coalesce(finite(ratio(-as_col("l_extendedprice"), "l_tax", mode="ieee")), F.lit(0.0)).cast("long").alias("per_tax"),
    )


