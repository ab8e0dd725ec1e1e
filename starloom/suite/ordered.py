"""Ordered groups: gaps, last rows, trends, positions, cumulative levels, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import day_offset
from ..functions.semantics import hash_bucket, sentinel_to_null
from ..operators.aggregate import bulk_stats
from ..operators.encode import top_levels
from ..operators.ordered import OrderedGroups, cumulative_levels, last_n_counts
from ..operators.tables import attach_group_values
from ..operators.validate import random_folds, repeated_folds, rolling_folds, train_test_split
from .aggregates import bucket_sql, orders_with_day
from .base import lines_with_customer, query, table

DAY = "datediff('day', date '1995-01-01', o_orderdate::date)::int"
SHIP = "datediff('day', date '1995-01-01', l_shipdate::date)::int"


@query(
    "gap_prev",
    f"""select o_orderkey, coalesce(day - lag(day) over (partition by o_custkey order by day, o_orderkey), 0)::bigint as day_gap,
    coalesce(trunc(o_totalprice - lag(o_totalprice) over (partition by o_custkey order by day, o_orderkey)), 0)::bigint as price_gap
    from (select *, {DAY} as day from orders)""",
)
def gap_prev(spark, sf):
    groups = OrderedGroups(orders_with_day(spark, sf), ["o_custkey"], ["day", "o_orderkey"])
    return groups.gaps({"day_gap": "day", "price_gap": "o_totalprice"}).select("o_orderkey", "day_gap", "price_gap")


@query(
    "gap_prev_desc",
    f"""select o_orderkey, coalesce(lag(day) over (partition by o_custkey order by day desc, o_orderkey) - day, 0)::bigint as days_to_newer
    from (select *, {DAY} as day from orders)""",
)
def gap_prev_desc(spark, sf):
    groups = OrderedGroups(orders_with_day(spark, sf), ["o_custkey"], ["-day", "o_orderkey"])
    return groups.gaps({"days_to_newer": "day"}, sign=-1).select("o_orderkey", "days_to_newer")


IN_ORDER = "partition by l_orderkey order by l_linenumber, day, l_partkey, l_suppkey, l_extendedprice"


def shipped_lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("day", day_offset("l_shipdate", "1995-01-01"))


@query(
    "gap_ship",
    f"""select l_orderkey, l_linenumber, l_partkey, coalesce(day - lag(day) over ({IN_ORDER}), 0)::bigint as ship_gap
    from (select *, {SHIP} as day from lineitem)""",
)
def gap_ship(spark, sf):
    groups = OrderedGroups(shipped_lines(spark, sf), ["l_orderkey"], ["l_linenumber", "day", "l_partkey", "l_suppkey", "l_extendedprice"])
    return groups.gaps({"ship_gap": "day"}).select("l_orderkey", "l_linenumber", "l_partkey", "ship_gap")


NEWEST = "partition by o_custkey order by day desc, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
RANKED = f"""(select *, row_number() over ({NEWEST}) as rn from (select *, {SHIP} as day from lineitem join orders on l_orderkey = o_orderkey))"""


def _newest_lines(spark, sf):
    df = lines_with_customer(spark, sf).withColumn("day", day_offset("l_shipdate", "1995-01-01"))
    return df, ["-day", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@query("last_row_flag", f"select o_custkey, (l_returnflag = 'R')::int as last_was_returned, (l_quantity < 25)::int as last_was_small from {RANKED} where rn = 1")
def last_row_flag(spark, sf):
    df, order = _newest_lines(spark, sf)
    last = {"last_was_returned": F.col("l_returnflag") == "R", "last_was_small": F.col("l_quantity") < 25}
    return last_n_counts(df, ["o_custkey"], order, [], {}, last)


@query(
    "last_n_counts",
    "select o_custkey, "
    + ", ".join(
        f"count(*) filter (rn <= {n} and l_returnflag = 'R') as nb_returned_{n}_last, count(*) filter (rn <= {n} and l_quantity < 25) as nb_small_{n}_last"
        for n in (1, 5, 10, 20)
    )
    + f" from {RANKED} group by 1",
)
def last_n(spark, sf):
    df, order = _newest_lines(spark, sf)
    conditions = {"nb_returned_{n}_last": F.col("l_returnflag") == "R", "nb_small_{n}_last": F.col("l_quantity") < 25}
    return last_n_counts(df, ["o_custkey"], order, [1, 5, 10, 20], conditions)


@query(
    "trend_slope",
    f"""with p as (select *, row_number() over ({IN_ORDER}) - 1 as x, nullif(l_quantity, 1) as q from (select *, {SHIP} as day from lineitem))
    select l_orderkey, case when count(*) = 1 then 0.0 else regr_slope(l_quantity, x) end as quantity_trend,
    case when count(q) < count(*) then null when count(*) = 1 then 0.0 else regr_slope(q, x) end as nullable_trend from p group by 1""",
    "quantity_trend nullable_trend",
)
def trend_slope(spark, sf):
    df = shipped_lines(spark, sf).withColumn("q", sentinel_to_null("l_quantity", 1.0))
    groups = OrderedGroups(df, ["l_orderkey"], ["l_linenumber", "day", "l_partkey", "l_suppkey", "l_extendedprice"])
    return groups.trend({"quantity_trend": "l_quantity", "nullable_trend": "q"})


@query(
    "group_position",
    f"select o_orderkey, (row_number() over (partition by o_custkey order by day, o_orderkey) - 1)::bigint as position from (select *, {DAY} as day from orders)",
)
def group_position(spark, sf):
    return OrderedGroups(orders_with_day(spark, sf), ["o_custkey"], ["day", "o_orderkey"]).position().select("o_orderkey", "position")


@query(
    "broadcast_group",
    """select o_orderkey, nb_status, max_status from orders join (select o_custkey, count(distinct o_orderstatus) as nb_status,
    max(o_orderstatus) as max_status from orders group by 1) using (o_custkey)""",
)
def broadcast_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stats = bulk_stats(orders, ["o_custkey"], [], extra=[F.max("o_orderstatus").alias("max_status")], distinct_only=["o_orderstatus"])
    stats = stats.withColumnRenamed("o_orderstatus_nunique", "nb_status")
    return attach_group_values(orders, ["o_custkey"], stats).select("o_orderkey", "nb_status", "max_status")


@query(
    "level_cumsum",
    """with c as (select p_name as level, count(*) as n from part group by 1)
    select level, n, sum(n) over (order by n desc, level rows unbounded preceding)::bigint as running, sum(n) over ()::bigint as total from c""",
)
def level_cumsum(spark, sf):
    return cumulative_levels(table(spark, sf, "part"), "p_name")


@query("topk_levels", "select p_brand as level, count(*) as n from part group by 1 order by n desc, level limit 10")
def topk_levels(spark, sf):
    return top_levels(table(spark, sf, "part"), "p_brand", 10)


# -- folds ------------------------------------------------------------------------


def fold_sql(key: str, source: str, k: int, seed, label: str | None = None) -> str:
    part = f"partition by {label}" if label else ""
    return f"((row_number() over ({part} order by md5('{seed}|' || {key})) - 1) % {k})::int"


@query("folds_random", f"select doc_id, {fold_sql('doc_id', 'labels', 5, 3)} as fold from labels")
def folds_random(spark, sf):
    return random_folds(table(spark, sf, "labels"), "doc_id", 5, seed=3).select("doc_id", "fold")


@query(
    "folds_stratified",
    " union all ".join(
        f'select doc_id, quality, {fold_sql("doc_id", "labels", 5, seed, "quality")} + {5 * i} as "foldId", {seed} as "mcSeed" from labels'
        for i, seed in enumerate((11, 12))
    ),
)
def folds_stratified(spark, sf):
    return repeated_folds(table(spark, sf, "labels"), "doc_id", 5, [11, 12], "quality").select("doc_id", "quality", "foldId", "mcSeed")


@query(
    "folds_rolling",
    """with p as (select event_id, row_number() over (order by ts, event_id) - 1 as position from events),
    f as (select i as fold from range(((select count(*) from events) - 400) // 200) g(i))
    select event_id, position::bigint as position, fold::int as "foldId", case when position < fold * 200 + 400 then 'train' else 'test' end as part
    from p join f on position >= fold * 200 and position < fold * 200 + 600""",
)
def folds_rolling(spark, sf):
    return rolling_folds(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 400, 200).select("event_id", "position", "foldId", "part")


@query(
    "train_test_split",
    f"select c_custkey, case when {bucket_sql('c_custkey', 10000, 42)} < 2000 then 'test' else 'train' end as part from customer",
)
def split(spark, sf):
    train, test = train_test_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "hash_buckets",
    f"select {bucket_sql('o_orderkey', 16, 5)} as bucket, count(*) as n, sum(o_custkey)::bigint as key_sum from orders group by 1",
)
def hash_buckets(spark, sf):
    bucket = hash_bucket("o_orderkey", 16, 5).alias("bucket")
    return table(spark, sf, "orders").groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("key_sum"))
