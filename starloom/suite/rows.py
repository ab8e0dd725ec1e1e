"""Row-wise, text, date and pairwise columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rowwise as R
from ..functions import semantics as S
from ..functions.dates import day_offset
from ..operators.generate import DateTimeFeatures, PairwiseInteractions, TextStatistics
from ..plans.credit_application import rounded_units
from .base import query, table

ROW_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
THREE = "nullif(l_discount, 0) as a, nullif(l_tax, 0) as b, case when l_quantity <= 25 then l_quantity / 100 end as c"
NULLS = "(a is null)::int + (b is null)::int + (c is null)::int"


def three_columns(spark, sf):
    return table(spark, sf, "lineitem").select(
        *ROW_ID.split(", "),
        S.sentinel_to_null("l_discount", 0.0).alias("a"),
        S.sentinel_to_null("l_tax", 0.0).alias("b"),
        F.when(F.col("l_quantity") <= 25, F.col("l_quantity") / 100).alias("c"),
    )


@query("row_null_count", f"select {ROW_ID}, {NULLS} as nb_missing from (select *, {THREE} from lineitem)")
def row_null_count(spark, sf):
    return three_columns(spark, sf).select(*ROW_ID.split(", "), R.null_count(["a", "b", "c"]).alias("nb_missing"))


@query(
    "row_stats",
    f"""select {ROW_ID}, list_avg(v) as mean, list_median(v) as median, list_stddev_pop(v) as std, coalesce(list_sum(v), 0) as total,
    list_max(v) - list_min(v) as span, a * b * c as product from (select *, list_filter([a, b, c], lambda x: x is not null) as v
    from (select *, {THREE} from lineitem))""",
    "mean median std total span product",
)
def row_stats(spark, sf):
    cols = ["a", "b", "c"]
    return three_columns(spark, sf).select(
        *ROW_ID.split(", "),
        R.row_mean(cols).alias("mean"),
        R.row_median(cols).alias("median"),
        R.row_std(cols).alias("std"),
        R.row_sum(cols).alias("total"),
        R.row_range(cols).alias("span"),
        R.row_product(cols).alias("product"),
    )


@query("family_sum", f"select {ROW_ID}, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) as total from (select *, {THREE} from lineitem)", "total")
def family_sum(spark, sf):
    df = three_columns(spark, sf)
    family = df.select(df.colRegex("`^[abc]$`")).columns
    return df.select(*ROW_ID.split(", "), R.row_sum(family).alias("total"))


@query(
    "binning",
    """select c_custkey, case when b is null then 0 when b < 0 then 6 when b < 2000 then 5 when b < 4000 then 4 when b < 6000 then 3 when b < 8000 then 2
    else 1 end as bin, (coalesce(b < 0, false))::int as is_negative, (b is null)::int as is_missing
    from (select *, case when c_nationkey <> 3 then c_acctbal end as b from customer)""",
)
def binning(spark, sf):
    df = table(spark, sf, "customer").withColumn("b", F.when(F.col("c_nationkey") != 3, F.col("c_acctbal")))
    return df.select(
        "c_custkey",
        S.bins("b", [0, 2000, 4000, 6000, 8000], [6, 5, 4, 3, 2, 1]).alias("bin"),
        S.flag(F.col("b") < 0).alias("is_negative"),
        F.col("b").isNull().cast("int").alias("is_missing"),
    )


@query(
    "value_map",
    """select c_custkey, case c_mktsegment when 'BUILDING' then 0.1::double when 'MACHINERY' then 0.2::double end as segment_rate from customer""",
    "segment_rate",
)
def value_map(spark, sf):
    rate = S.value_map("c_mktsegment", {"BUILDING": 0.1, "MACHINERY": 0.2}).cast("double")
    return table(spark, sf, "customer").select("c_custkey", rate.alias("segment_rate"))


@query(
    "signed_log",
    "select c_custkey, sign(x)::double * ln(1 + abs(x)) as signed_log, ln(1 + abs(x)) as abs_log from (select *, c_acctbal - 3000 as x from customer)",
    "signed_log abs_log",
)
def signed_log(spark, sf):
    df = table(spark, sf, "customer").withColumn("x", F.col("c_acctbal") - 3000)
    return df.select("c_custkey", S.signed_log("x").alias("signed_log"), S.abs_log("x").alias("abs_log"))


def floor_sql(a: str, b: float) -> str:
    return f"(round(({a} - {a} % {b}::double) / {b}::double) - ({a} % {b}::double < 0)::int)"


@query(
    "floor_years",
    f"""select o_orderkey, {floor_sql('d', 365.25)} as years, {floor_sql('(-d)', 365.25)} as years_back, round_even(o_totalprice / 1000, 0)::int as thousands
    from (select *, datediff('day', date '1998-01-01', o_orderdate::date)::double as d from orders)""",
    "years years_back",
)
def floor_years(spark, sf):
    df = table(spark, sf, "orders").withColumn("d", day_offset("o_orderdate", "1998-01-01"))
    df = df.withColumnsRenamed({"o_totalprice": "PRICE_AVG"})
    df = df.select("o_orderkey", S.floor_div("d", 365.25).alias("years"), S.floor_div(-F.col("d"), 365.25).alias("years_back"), "PRICE_AVG")
    return rounded_units(df, {"PRICE": {"AVG": 1000.0}}).withColumnRenamed("PRICE_AVG", "thousands")


@query(
    "ratios",
    f"""select {ROW_ID}, l_extendedprice / nullif(l_quantity, 0) as unit_price, 100 * l_tax / nullif(l_discount, 0) as tax_per_discount,
    l_extendedprice - l_extendedprice * l_discount as net, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge,
    (l_discount > l_tax)::int as discount_above_tax, (nullif(l_tax, 0) is null)::int as tax_missing from lineitem""",
    "unit_price tax_per_discount net charge",
)
def ratios(spark, sf):
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        *ROW_ID.split(", "),
        S.ratio("l_extendedprice", "l_quantity").alias("unit_price"),
        S.ratio("l_tax", "l_discount", scale=100).alias("tax_per_discount"),
        (price - price * discount).alias("net"),
        (price * (1 - discount) * (1 + tax)).alias("charge"),
        S.flag(discount > tax).alias("discount_above_tax"),
        S.sentinel_to_null("l_tax", 0.0).isNull().cast("int").alias("tax_missing"),
    )


# -- text -------------------------------------------------------------------------

PUNCTUATION = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def text_sql(c: str) -> str:
    def n(pattern):
        return f"len(regexp_extract_all({c}, '{pattern}'))::int"

    counts = {
        "nb_chars": f"length({c})::int",
        "nb_tokens": f"len(string_split(lower({c}), ' '))::int",
        "nb_words": n(r"(\s|^)[a-z]+(\s|$)"),
        "nb_numbers": n(r"(\s|^)[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?(\s|$)"),
        "nb_letters": n("[a-zA-Z]"),
        "nb_uppercase_letters": n("[A-Z]"),
        "nb_lowercase_letters": n("[a-z]"),
        "nb_digits": n("[0-9]"),
        "nb_punctuation_signs": n(PUNCTUATION),
        "nb_whitespaces": n(r"\s"),
    }
    special = " - ".join(counts[k] for k in ("nb_chars", "nb_whitespaces", "nb_punctuation_signs", "nb_digits", "nb_letters"))
    return ", ".join(f'{e} as "{c}_{k}"' for k, e in (counts | {"nb_special_chars": special}).items())


@query("text_stats", f"select doc_id, {text_sql('text')} from documents")
def text_stats(spark, sf):
    return TextStatistics(["text"]).transform(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query(
    "text_stats_concat",
    f"""select conv_id, turn, {text_sql('role')}, {text_sql('text')}, {text_sql('concatenated_text')}
    from (select conv_id, turn, role, t as text, role || ' ' || t as concatenated_text
    from (select *, case when turn % 3 <> 2 then text end as t from conversations))""",
)
def text_stats_concat(spark, sf):
    df = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 3 != 2, F.col("text")))
    return TextStatistics(["role", "text"], "both").transform(df).drop("role", "text")


# -- dates ------------------------------------------------------------------------


@query(
    "datetime_features",
    """select event_id, year(ts)::int as ts_year, month(ts)::int as ts_month, day(ts)::int as ts_day, (isodow(ts) - 1)::int as ts_day_of_week,
    hour(ts)::int as ts_hour, minute(ts)::int as ts_minutes, second(ts)::int as ts_seconds from events""",
)
def datetime_features(spark, sf):
    return DateTimeFeatures(["ts"]).transform(table(spark, sf, "events").select("event_id", "ts")).drop("ts")


@query(
    "datetime_diff",
    """select event_id, (d // 1000000 % 86400)::bigint as time_of_day_diff, (d // 1000000)::bigint as total_diff
    from (select *, abs(epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')) as d from events)""",
)
def datetime_diff(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz").alias("t0"))
    below = DateTimeFeatures(["ts", "t0"]).transform(df)
    both = DateTimeFeatures(["ts", "t0"], total=True).transform(below.withColumnRenamed("ts_t0_time_diff_secs", "time_of_day_diff"))
    return both.select("event_id", "time_of_day_diff", F.col("ts_t0_time_diff_secs").alias("total_diff"))


# -- interactions -------------------------------------------------------------------

SIDE = {"log(1_+_{})": "case when {} > -1 then ln(1 + {}) end", "exp({})": "exp({})", "sqrt({})": "case when {} >= 0 then sqrt({}) end"}
PAIR_COLUMNS = ["s", "r", "w"]


def _pair_sql() -> tuple[str, list[str]]:
    out = {}
    for i, a in enumerate(PAIR_COLUMNS):
        for b in PAIR_COLUMNS[i + 1 :]:
            for op in "+-*":
                out[f"{a}_{op}_{b}"] = f"{a} {op} {b}"
            out[f"{a}_/_{b}"] = f"{a} / {b}"
            for shape, sql in SIDE.items():
                for op in "+-*":
                    out[f"{a}_{op}_{shape.format(b)}"] = f"{a} {op} {sql.replace('{}', b)}"
                    out[f"{shape.format(a)}_{op}_{b}"] = f"{sql.replace('{}', a)} {op} {b}"
    # w holds 0 and -1: a division by it overflows, and so does the logarithm of 1 + w.
    kept = {n: e for n, e in out.items() if not n.endswith("_/_w") and "log(1_+_w)" not in n}
    return ", ".join(f'({e})::double as "{n}"' for n, e in kept.items()), list(kept)


PAIR_SQL, PAIR_NAMES = _pair_sql()


@query(
    "pairwise_interactions",
    f"""select p_partkey, {PAIR_SQL} from (select p_partkey, p_size / 10.0::double as s, p_retailprice / 1000 as r,
    (p_partkey % 7 - 1)::double as w from part)""",
    PAIR_NAMES,
)
def pairwise_interactions(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") / 10).alias("s"),
        (F.col("p_retailprice") / 1000).alias("r"),
        (F.col("p_partkey") % 7 - 1).cast("double").alias("w"),
    )
    model = PairwiseInteractions(PAIR_COLUMNS).fit(df)
    return model.transform(df).drop(*PAIR_COLUMNS)
