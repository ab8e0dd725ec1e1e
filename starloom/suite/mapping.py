"""The test tables seen as credit tables.

Each column is one SQL expression that Spark and the comparison database read alike; only
the day difference is written per dialect.  NULLs, sentinels, zeros and outliers are put in
by arithmetic on the keys, so that every cleaning rule has rows to act on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import lines_with_customer, table

ORIGIN = "2001-12-31"


def _case(key: str, *names: str | None) -> str:
    """Level by remainder of an integer key."""
    whens = " ".join(f"when {i} then {'null' if n is None else repr(n)}" for i, n in enumerate(names))
    return f"case cast({key} as bigint) % {len(names)} {whens} end"


def _int(e: str) -> str:
    return f"cast({e} as int)"


def _real(e: str) -> str:
    return f"cast({e} as double)"


K = "c_custkey"
APPLICATION = {
    "SK_ID_CURR": K,
    "TARGET": _int(f"case when {K} % 5 = 0 then null when c_acctbal < 2500 then 1 else 0 end"),
    "CODE_GENDER": _case("c_nationkey", "M", "F", "F", "M", "XNA"),
    "NAME_CONTRACT_TYPE": _case("c_nationkey", "Cash loans", "Revolving loans"),
    "FLAG_OWN_CAR": _case(K, "Y", "N"),
    "NAME_INCOME_TYPE": "c_mktsegment",
    "OCCUPATION_TYPE": "nullif(c_mktsegment, 'BUILDING')",
    "ORGANIZATION_TYPE": "concat('Org ', cast(c_nationkey as string))",
    "DAYS_BIRTH": _int(f"-(7000 + {K} * 37 % 18000)"),
    "DAYS_EMPLOYED": _int(f"case when c_nationkey = 5 then 365243 else -({K} * 13 % 7000) end"),
    "DAYS_ID_PUBLISH": _int(f"-({K} * 7 % 4000)"),
    "DAYS_LAST_PHONE_CHANGE": _int(f"-({K} % 50 * 20)"),
    "DAYS_REGISTRATION": _real(f"-({K} * 11 % 9000)"),
    "CNT_CHILDREN": _int("c_nationkey % 4"),
    "CNT_FAM_MEMBERS": _int(f"nullif(c_nationkey % 4 + 1 + {K} % 2, 3)"),
    "OWN_CAR_AGE": _int(f"case when {K} % 3 = 0 then {K} % 40 end"),
    "AMT_INCOME_TOTAL": "20000e0 + abs(c_acctbal) * 10e0",
    "AMT_CREDIT": _real(f"100000 + {K} * 7919 % 20000 * 100"),
    "AMT_ANNUITY": _real(f"nullif({K} * 131 % 300, 7) * 100"),
    "AMT_GOODS_PRICE": _real(f"case when {K} % 17 <> 0 then 90000 + {K} * 7919 % 20000 * 101 end"),
    "EXT_SOURCE_1": f"case when {K} % 3 <> 1 then {_real(K + ' * 31 % 1000')} / 1000e0 end",
    "EXT_SOURCE_2": f"case when {K} % 20 <> 1 then {_real(K + ' * 57 % 1000')} / 1000e0 end",
    "EXT_SOURCE_3": f"case when {K} % 4 <> 1 then {_real(K + ' * 83 % 1000')} / 1000e0 end",
    "ELEVATORS_AVG": f"{_real(K + ' % 25')} * 0.04e0",
    "ELEVATORS_MEDI": f"case when {K} % 9 <> 0 then {_real(K + ' % 25')} * 0.0403e0 end",
    "ELEVATORS_MODE": f"{_real(K + ' % 23')} * 0.02e0",
    "ENTRANCES_AVG": f"{_real(K + ' % 25')} * 0.0345e0",
    "ENTRANCES_MEDI": f"{_real(K + ' % 21')} * 0.0172e0",
    "ENTRANCES_MODE": f"case when {K} % 100 = 0 then {_real(K + ' % 23')} * 0.03e0 end",
    "FLAG_DOCUMENT_2": _int(f"{K} % 2"),
    "FLAG_DOCUMENT_3": _int(f"{K} % 3 % 2"),
    "FLAG_DOCUMENT_4": _int(f"{K} % 7 % 2"),
}

O = "o_orderkey"
DAY = "{day_o_orderdate}"
BUREAU = {
    "SK_ID_BUREAU": O,
    "SK_ID_CURR": "o_custkey",
    "CREDIT_ACTIVE": "case o_orderstatus when 'F' then 'Closed' when 'O' then 'Active' end",
    "CREDIT_CURRENCY": _case("o_custkey", "currency 1", "currency 1", "currency 2", "currency 3"),
    "CREDIT_TYPE": _case(
        O, *["Consumer credit"] * 7, *["Credit card"] * 4, *["Car loan"] * 3, "Mortgage", "Mortgage", "Microloan"
    ),
    "DAYS_CREDIT": _int(DAY),
    "DAYS_CREDIT_ENDDATE": _real(f"case when {O} % 11 = 0 then null when {O} % 97 = 1 then -6000 else {DAY} + {O} * 37 % 3000 end"),
    "DAYS_ENDDATE_FACT": _real(f"case when {O} % 3 = 0 then null when {O} % 101 = 1 then -41000 else {DAY} + {O} * 53 % 2000 end"),
    "DAYS_CREDIT_UPDATE": _int(f"case when {O} % 89 = 1 then -41911 else -({O} % 500) end"),
    "CNT_CREDIT_PROLONG": _int(f"{O} % 4"),
    "AMT_CREDIT_SUM": f"case when {O} % 29 <> 0 then o_totalprice end",
    "AMT_CREDIT_SUM_DEBT": f"case when {O} % 5 <> 0 then o_totalprice * 0.25e0 end",
    "AMT_CREDIT_SUM_LIMIT": f"case when {O} % 4 = 0 then 0e0 when {O} % 4 < 3 then o_totalprice / 2e0 end",
    "AMT_CREDIT_SUM_OVERDUE": f"case when {O} % 13 = 0 then 100e0 + {O} % 7 else 0e0 end",
    "AMT_CREDIT_MAX_OVERDUE": f"case when {O} % 100 = 0 then 500e0 + {O} % 70 end",
    "AMT_ANNUITY": f"case when {O} % 3 <> 1 then o_totalprice / 24e0 end",
}
BALANCE = {
    "SK_ID_BUREAU": "l_orderkey",
    "MONTHS_BALANCE": _int("-l_linenumber"),
    "STATUS": _case("l_partkey", "0", "1", "2", "3", "4", "5", "C", "X", None),
}
PREVIOUS = {
    "SK_ID_PREV": O,
    "SK_ID_CURR": "o_custkey",
    "NAME_CONTRACT_TYPE": _case(O, "Cash loans", "Consumer loans", "Revolving loans"),
    "WEEKDAY_APPR_PROCESS_START": _case(O, "MONDAY", "TUESDAY", "WEDNESDAY"),
    "FLAG_LAST_APPL_PER_CONTRACT": _case(O, *["Y"] * 9, "N"),
    "NAME_CASH_LOAN_PURPOSE": _case(O, "XAP", "XNA", "Repairs", None),
    "NAME_PAYMENT_TYPE": _case(O, "Cash through the bank", "XNA"),
    "NAME_TYPE_SUITE": _case(O, "Family", "Unaccompanied", None),
    "NAME_CLIENT_TYPE": _case("o_custkey", "New", "Repeater", "Refreshed"),
    "NAME_GOODS_CATEGORY": _case(O, "Mobile", "Furniture", "XNA"),
    "NAME_PORTFOLIO": _case(O, "POS", "Cash", "Cards"),
    "NAME_PRODUCT_TYPE": _case(O, "XNA", "x-sell", "walk-in"),
    "CHANNEL_TYPE": _case(O, "Stone", "Country-wide"),
    "NAME_SELLER_INDUSTRY": _case(O, "Industry", "Connectivity"),
    "NAME_YIELD_GROUP": _case("o_custkey + o_orderkey", "low_normal", "middle", "high", "XNA"),
    "PRODUCT_COMBINATION": _case(O, "Cash", "POS", None),
    "CODE_REJECT_REASON": _case(O, "XAP", "XAP", "HC", "LIMIT"),
    "NAME_CONTRACT_STATUS": "case o_orderstatus when 'F' then 'Approved' when 'O' then 'Refused' when 'P' then 'Canceled' end",
    "DAYS_DECISION": _int(DAY),
    "SELLERPLACE_AREA": _int(f"{O} * 17 % 4000 - 1"),
    "NFLAG_INSURED_ON_APPROVAL": _int(f"case {O} % 3 when 0 then 0 when 1 then 1 end"),
    "AMT_APPLICATION": f"case when {O} % 6 = 0 then o_totalprice else o_totalprice * 0.75e0 end",
    "AMT_CREDIT": f"case when {O} % 50 = 0 then 0e0 else o_totalprice end",
    "AMT_ANNUITY": f"case when {O} % 7 <> 0 then o_totalprice / 12e0 end",
    "AMT_GOODS_PRICE": f"case when {O} % 9 <> 0 then o_totalprice * (0.5e0 + {O} % 8 / 8e0) end",
    "AMT_DOWN_PAYMENT": f"case when {O} % 2 = 0 then o_totalprice / 10e0 end",
    "DAYS_FIRST_DUE": _real(f"case when {O} % 10 <> 0 then {DAY} + 30 end"),
    "DAYS_LAST_DUE": _real(f"case when {O} % 4 = 0 then 365243 else {DAY} + {O} % 900 end"),
    "DAYS_LAST_DUE_1ST_VERSION": _real(f"case when {O} % 8 = 1 then 365243 else {DAY} + {O} % 800 end"),
}
L = "l_partkey"
INSTALMENTS = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_PREV": "l_orderkey",
    "NUM_INSTALMENT_NUMBER": _int("l_linenumber"),
    "NUM_INSTALMENT_VERSION": _int("nullif(l_suppkey % 4, 3)"),
    "DAYS_INSTALMENT": _int("{day_l_shipdate} - l_suppkey % 5"),
    "DAYS_ENTRY_PAYMENT": _int(f"case when {L} % 50 <> 0 then {{day_l_shipdate}} - {L} % 7 + 1 end"),
    "AMT_INSTALMENT": f"case when {L} % 31 = 0 then 0e0 else l_extendedprice end",
    "AMT_PAYMENT": f"case when {L} % 50 = 0 then null when {L} % 3 = 0 then l_extendedprice else l_extendedprice * (1e0 - l_discount) end",
}
E = "event_id"
CARD = {
    "SK_ID_CURR": "user_id",
    "SK_ID_PREV": f"user_id * 10 + {E} % 3",
    "MONTHS_BALANCE": _int(f"-({E} % 96)"),
    "AMT_BALANCE": f"case when {E} % 19 <> 0 then value end",
    "AMT_CREDIT_LIMIT_ACTUAL": _int(f"case when {E} % 5 < 4 then {E} % 5 * 100 end"),
    "AMT_DRAWINGS_ATM_CURRENT": "value - 20e0",
    "AMT_DRAWINGS_CURRENT": "value * 1.5e0 - 10e0",
    "CNT_DRAWINGS_CURRENT": _int(f"{E} % 5"),
    "CNT_INSTALMENT_MATURE_CUM": _int(f"nullif({E} % 7, 6)"),
    "AMT_INST_MIN_REGULARITY": f"case when {E} % 10 <> 0 then value / 2e0 end",
    "AMT_PAYMENT_CURRENT": _real(f"{E} % 50"),
    "SK_DPD": _int(f"case when {E} % 6 < 2 then {E} % 30 else 0 end"),
    "NAME_CONTRACT_STATUS": "nullif(event_type, 'error')",
}
POS = {
    "SK_ID_CURR": "user_id",
    "SK_ID_PREV": f"user_id * 10 + {E} % 4",
    "MONTHS_BALANCE": _int(f"-({E} % 60)"),
    "CNT_INSTALMENT_FUTURE": _int(f"nullif({E} % 24, 23)"),
    "SK_DPD": _int(f"case when {E} % 7 < 3 then {E} % 40 else 0 end"),
    "SK_DPD_DEF": _int(f"case when {E} % 7 < 2 then {E} % 20 else 0 end"),
    "NAME_CONTRACT_STATUS": "nullif(event_type, 'view')",
}

# Credit table -> (columns, source in SQL).
SOURCES = {
    "application": (APPLICATION, "customer"),
    "bureau": (BUREAU, "orders"),
    "bureau_balance": (BALANCE, "lineitem"),
    "previous_application": (PREVIOUS, "orders"),
    "installments_payments": (INSTALMENTS, "lineitem join orders on l_orderkey = o_orderkey"),
    "credit_card_balance": (CARD, "events"),
    "pos_cash_balance": (POS, "events"),
}
DATES = ("o_orderdate", "l_shipdate")


def _expression(e: str, dialect: str) -> str:
    for d in DATES:
        days = f"datediff(cast({d} as date), date '{ORIGIN}')" if dialect == "spark" else f"datediff('day', date '{ORIGIN}', cast({d} as date))"
        e = e.replace("{day_" + d + "}", days)
    return e


def credit_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    columns, source = SOURCES[name]
    rows = lines_with_customer(spark, folder) if " join " in source else table(spark, folder, source)
    return rows.select(*[F.expr(_expression(e, "spark")).alias(c) for c, e in columns.items()])


def credit_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: credit_table(spark, folder, n) for n in SOURCES}


def credit_target(spark: SparkSession, folder: str) -> DataFrame:
    return credit_table(spark, folder, "application").select("SK_ID_CURR", F.col("TARGET").alias("target"))


def credit_sql(name: str) -> str:
    """The credit table as a subquery of the comparison database."""
    columns, source = SOURCES[name]
    return "(select " + ", ".join(f'{_expression(e, "sql")} as "{c}"' for c, e in columns.items()) + f" from {source})"
