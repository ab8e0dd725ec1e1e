"""Features of the child tables of a credit application, one row per customer.

Every table is read once for its ordered features and its sums and once for its distinct
counts.  Windows on the customer come first, so that the windows on (customer, loan) and
the aggregate after them find their rows already together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import null_count
from ..functions.semantics import as_col, differs, finite, flag, null_outside, ratio, sentinel_to_null
from ..operators.aggregate import (
    bulk_stats,
    distinct_levels,
    keyed_label_rates,
    level_counts,
    level_folds,
    numeric_columns,
    string_columns,
    with_label_rates,
)
from ..operators.encode import CategoricalEncoder, Grouping, OneHot, Ordinal
from ..operators.ordered import OrderedGroups, colocated, slope_folds
from ..operators.select import ConstantDrop, NullShareSelect
from ..operators.tables import HotKeys, materialise, prefixed, star_join

CUSTOMER, LOAN, BUREAU = "SK_ID_CURR", "SK_ID_PREV", "SK_ID_BUREAU"

# Levels, list of encoded columns and known-redundant features.
BALANCE_STATUS = ["0", "1", "2", "3", "4", "5", "C", "X"]
BUREAU_RATES = ["CREDIT_ACTIVE", "CREDIT_TYPE"]
BUREAU_REDUNDANT = [
    "AVG_CREDITDAYS_PROLONGED",
    "TOTAL_CUSTOMER_CREDIT",
    "TOTAL_CUSTOMER_DEBT",
    "TOTAL_CUSTOMER_OVERDUE",
    "CREDIT_ENDDATE_PERCENTAGE",
    "AVG_ENDDATE_FUTURE",
    "bureau_count",
    "nb_bureau_records",
    "BUREAU_LOAN_COUNT",
]
PREVIOUS_RATES = [
    "PRODUCT_COMBINATION",
    "NAME_YIELD_GROUP",
    "NAME_CONTRACT_STATUS",
    "NAME_CASH_LOAN_PURPOSE",
    "NAME_CONTRACT_TYPE",
    "NAME_CLIENT_TYPE",
    "NAME_GOODS_CATEGORY",
    "NAME_PORTFOLIO",
    "NAME_PRODUCT_TYPE",
    "CHANNEL_TYPE",
]
PREVIOUS_REDUNDANT = [
    "credit_length_months_nunique",
    "NAME_CASH_LOAN_PURPOSE_XAP_std",
    "NAME_CASH_LOAN_PURPOSE_XAP_nunique",
    "PRODUCT_COMBINATION_NA_mean",
    "PRODUCT_COMBINATION_NA_std",
    "NAME_CONTRACT_TYPE_XNA_max",
    "PRODUCT_COMBINATION_NA_nunique",
    "NAME_CONTRACT_TYPE_XNA_sum",
    "PRODUCT_COMBINATION_NA_sum",
    "PRODUCT_COMBINATION_NA_max",
    "NAME_CONTRACT_TYPE_XNA_nunique",
    "NAME_CONTRACT_STATUS_Unused offer",
]
NO_DATE = 365243
LAST_SIZES = [5, 10, 20]


def bureau_encoders() -> dict:
    return {"CREDIT_ACTIVE": OneHot(), "CREDIT_CURRENCY": Ordinal(), "CREDIT_TYPE": Grouping(OneHot(), 4)}


def previous_encoders() -> dict:
    one_hot = """NAME_CONTRACT_TYPE WEEKDAY_APPR_PROCESS_START NAME_PAYMENT_TYPE NAME_TYPE_SUITE NAME_CLIENT_TYPE NAME_PORTFOLIO
    NAME_PRODUCT_TYPE CHANNEL_TYPE NAME_SELLER_INDUSTRY NAME_YIELD_GROUP PRODUCT_COMBINATION""".split()
    return {c: OneHot() for c in one_hot} | {
        "FLAG_LAST_APPL_PER_CONTRACT": Ordinal(),
        "NAME_CASH_LOAN_PURPOSE": Grouping(OneHot(), 23),
        "NAME_GOODS_CATEGORY": Grouping(OneHot(), 25),
    }


def _encoder(df: DataFrame, encoders: dict, drop: bool):
    """Encoder of those columns the table has."""
    found = {c: e for c, e in encoders.items() if c in df.columns}
    return CategoricalEncoder(list(found), list(found.values()), drop_inputs=drop)


def bureau_balance_features(balance: DataFrame) -> DataFrame:
    """Per bureau credit: statistics of numbers, distinct strings, rows per status."""
    status = level_counts("STATUS", BALANCE_STATUS, "STATUS_", absent=None)
    stats = bulk_stats(balance, [BUREAU], extra=status, distinct_only=string_columns(balance), exact=True)
    return prefixed(stats, "bureau_balance_", [BUREAU])


def bureau_rows(bureau: DataFrame, balance: DataFrame, target: DataFrame, hot: HotKeys) -> DataFrame:
    """Bureau credits with their own derived columns, lying together by customer."""
    df = bureau.join(bureau_balance_features(balance), BUREAU, "left")
    df = df.withColumns(
        {
            "DAYS_CREDIT_ENDDATE": null_outside("DAYS_CREDIT_ENDDATE", low=-5000),
            "DAYS_CREDIT_UPDATE": null_outside("DAYS_CREDIT_UPDATE", low=-40000),
            "DAYS_ENDDATE_FACT": null_outside("DAYS_ENDDATE_FACT", low=-40000),
        }
    )
    df = df.withColumn("missing_values_count", null_count(df.columns))
    df = with_label_rates(df, keyed_label_rates(bureau, CUSTOMER, BUREAU_RATES, target, "target"), BUREAU_RATES)
    # From here on a missing credit state or type is a level of its own, "NA".
    df = _encoder(bureau, bureau_encoders(), drop=False).fit(bureau).transform(df)
    df = df.withColumns(
        {
            "credit_duration": F.col("DAYS_CREDIT_ENDDATE") - F.col("DAYS_CREDIT"),
            "nb_days_after_enddate": F.col("DAYS_ENDDATE_FACT") - F.col("DAYS_CREDIT_ENDDATE"),
            "credit_usage": ratio("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT"),
        }
    )
    df = OrderedGroups(df, [CUSTOMER], ["-DAYS_CREDIT", BUREAU], hot=hot).gaps({"DAYS_DIFF": "DAYS_CREDIT"}, sign=-1)
    df = df.withColumn("__future", flag(F.col("DAYS_CREDIT_ENDDATE") >= 0))
    future = bureau.withColumn("__future", flag(null_outside("DAYS_CREDIT_ENDDATE", low=-5000) >= 0))
    ahead = OrderedGroups(df, [CUSTOMER, "__future"], ["DAYS_CREDIT_ENDDATE", BUREAU], hot=HotKeys.of(future, [CUSTOMER, "__future"], hot))
    df = ahead.gaps({"DAYS_ENDDATE_DIFF": "DAYS_CREDIT_ENDDATE"})
    return df.withColumn("DAYS_ENDDATE_DIFF", F.when(F.col("__future") == 1, F.col("DAYS_ENDDATE_DIFF")))


def bureau_stats(bureau: DataFrame, balance: DataFrame, target: DataFrame) -> DataFrame:
    """Per customer, before columns are dropped and prefixed."""
    hot = HotKeys.of(bureau, [CUSTOMER])
    df = bureau_rows(bureau, balance, target, hot)
    active = differs("CREDIT_ACTIVE", "Closed") == 1

    def total(c, condition=None):
        value = as_col(c) if condition is None else F.when(condition, as_col(c))
        return "sum", value.cast("double")

    folds = {
        "bureau_count": ("count", as_col(BUREAU)),
        "nb_bureau_records": ("count", F.lit(1)),
        "BUREAU_LOAN_COUNT": ("count", F.col("DAYS_CREDIT")),
        "ACTIVE_LOANS_PERCENTAGE": ("mean", differs("CREDIT_ACTIVE", "Closed")),
        "CREDIT_ENDDATE_PERCENTAGE": ("mean", F.col("__future")),
        "AVG_ENDDATE_FUTURE": ("mean", F.col("DAYS_ENDDATE_DIFF")),
        "TOTAL_CUSTOMER_DEBT": total("AMT_CREDIT_SUM_DEBT"),
        "TOTAL_CUSTOMER_CREDIT": total("AMT_CREDIT_SUM"),
        "TOTAL_ACTIVE_CUSTOMER_CREDIT": total("AMT_CREDIT_SUM", active),
        "TOTAL_ACTIVE_AMT_ANNUITY": total("AMT_ANNUITY", active),
        "TOTAL_CUSTOMER_OVERDUE": total("AMT_CREDIT_SUM_OVERDUE"),
        "AVG_CREDITDAYS_PROLONGED": ("mean", F.coalesce("CNT_CREDIT_PROLONG", F.lit(0))),
    }
    numbers = numeric_columns(df, [CUSTOMER, BUREAU, "__future"])
    # CREDIT_ENDDATE_BINARY is on the rows while the statistics are taken.
    df = df.withColumn("CREDIT_ENDDATE_BINARY", F.col("__future"))
    stats = bulk_stats(df, [CUSTOMER], numbers + ["CREDIT_ENDDATE_BINARY"], folds=folds, distinct_only=["CREDIT_TYPE"], groups=hot, placed=True)
    stats = stats.withColumnRenamed("CREDIT_TYPE_nunique", "BUREAU_LOAN_TYPES")
    return stats.withColumns(
        {
            "AVERAGE_LOAN_TYPE": ratio("BUREAU_LOAN_COUNT", "BUREAU_LOAN_TYPES"),
            "DEBT_CREDIT_RATIO": ratio("TOTAL_CUSTOMER_DEBT", "TOTAL_CUSTOMER_CREDIT"),
            "OVERDUE_DEBT_RATIO": ratio("TOTAL_CUSTOMER_OVERDUE", "TOTAL_CUSTOMER_DEBT"),
        }
    )


def bureau_features(bureau: DataFrame, balance: DataFrame, target: DataFrame) -> DataFrame:
    stats = materialise(bureau_stats(bureau, balance, target))
    stats = NullShareSelect(0.8, inclusive=False, keep=[CUSTOMER]).fit(stats).transform(stats)
    return prefixed(stats.drop(*BUREAU_REDUNDANT), "bureau_", [CUSTOMER])


def previous_stats(previous: DataFrame, instalments: DataFrame, target: DataFrame, levels: dict | None = None) -> DataFrame:
    """Per customer, before columns are dropped and prefixed.

    ``levels`` may fix the reject-reason and status levels; by default they are looked up.
    """
    per_loan = instalments.groupBy(CUSTOMER, LOAN).agg(
        F.count(F.lit(1)).alias("number_of_annuities"), F.max("NUM_INSTALMENT_VERSION").alias("NUM_INSTALMENT_VERSION_max")
    )
    previous = previous.withColumn("NAME_TYPE_SUITE", F.coalesce("NAME_TYPE_SUITE", F.lit("missing")))
    df = previous.withColumns({c: sentinel_to_null(c, NO_DATE) for c in ("DAYS_LAST_DUE", "DAYS_LAST_DUE_1ST_VERSION")})
    df = df.withColumn("missing_values_count", null_count(previous.columns))
    df = df.join(per_loan, [CUSTOMER, LOAN], "left")
    credit, goods = F.col("AMT_CREDIT"), F.col("AMT_GOODS_PRICE")
    df = df.withColumns(
        {
            "APP_CREDIT_PERC": ratio("AMT_APPLICATION", "AMT_CREDIT"),
            "APP_CREDIT_DIFF": F.col("AMT_APPLICATION") - credit,
            "AMT_DOWN_PAYMENT": F.coalesce("AMT_DOWN_PAYMENT", F.lit(0.0)),
            "number_of_annuities": F.coalesce("number_of_annuities", F.lit(0)),
            "credit_length": F.col("DAYS_LAST_DUE") - F.col("DAYS_FIRST_DUE"),
            "AMT_CREDIT_/_AMT_ANNUITY": ratio("AMT_CREDIT", "AMT_ANNUITY"),
            "subscribed_to_insurance": flag(credit > goods),
            "insurance_amount": credit - goods,
            "days_last_due_diff_version": F.col("DAYS_LAST_DUE") - F.col("DAYS_LAST_DUE_1ST_VERSION"),
        }
    )
    df = df.withColumns(
        {
            "APP_CREDIT_DIFF_eq_0": flag(F.col("APP_CREDIT_DIFF") == 0),
            "credit_length_months": F.col("credit_length") / 30 + 1,
            "number_of_annuities_-_AMT_CREDIT_/_AMT_ANNUITY": F.col("number_of_annuities") - as_col("AMT_CREDIT_/_AMT_ANNUITY"),
            "insurance_percentage_goods_price": ratio("insurance_amount", "AMT_GOODS_PRICE", scale=100),
            "insurance_percentage_total_amount": ratio("insurance_amount", "AMT_CREDIT", scale=100),
        }
    )
    df = df.withColumn("credit_length_months_gt_10000", flag(F.col("credit_length_months") > 10000))
    rated = [c for c in PREVIOUS_RATES if c in previous.columns]
    df = with_label_rates(df, keyed_label_rates(previous, CUSTOMER, rated, target, "target"), rated)
    df = _encoder(previous, previous_encoders(), drop=True).fit(previous).transform(df)
    levels = levels or {c: distinct_levels(previous, c) for c in ("CODE_REJECT_REASON", "NAME_CONTRACT_STATUS")}
    hot = HotKeys.of(previous, [CUSTOMER])
    df = OrderedGroups(df, [CUSTOMER], ["DAYS_DECISION", LOAN], hot=hot).position("__at")
    folds = {"number_of_previous_applications": ("count", as_col(LOAN))}
    for c, found in levels.items():
        folds |= level_folds(c, found, f"{c}_")
    sums, trend = slope_folds("__at", "NAME_YIELD_GROUP_TgtAvg", "trend")
    stats = bulk_stats(df, [CUSTOMER], numeric_columns(df, [CUSTOMER, LOAN, "__at"]), folds=folds | sums, groups=hot, placed=True)
    stats = stats.withColumn("NAME_YIELD_GROUP_trend", trend).drop(*sums)
    n = "number_of_previous_applications"
    more = {"NFLAG_INSURED_ON_APPROVAL_ratio": ratio("NFLAG_INSURED_ON_APPROVAL_sum", n)}
    if "NAME_CONTRACT_STATUS_Refused" in stats.columns:
        more["NAME_CONTRACT_STATUS_Refused_gt_0"] = flag(F.col("NAME_CONTRACT_STATUS_Refused") > 0)
        more["refused_previous_applications_ratio"] = ratio("NAME_CONTRACT_STATUS_Refused", n)
    return stats.withColumns(more)


def previous_features(previous: DataFrame, instalments: DataFrame, target: DataFrame) -> DataFrame:
    stats = previous_stats(previous, instalments, target)
    return prefixed(stats.drop(*PREVIOUS_REDUNDANT), "previous_application_", [CUSTOMER])


def credit_card_stats(card: DataFrame, target: DataFrame) -> DataFrame:
    """Per customer, before columns are prefixed."""
    status = "NAME_CONTRACT_STATUS"
    clean = {c: null_outside(c, low=0) for c in ("AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT")}
    df = card.withColumns(clean)
    df = df.withColumn("missing_values_count", null_count(card.columns))
    df = with_label_rates(df, keyed_label_rates(card, CUSTOMER, [status], target, "target"), [status])
    texts = string_columns(card)
    df = CategoricalEncoder(texts, [Ordinal() for _ in texts]).fit(card).transform(df)
    missed = F.col("AMT_INST_MIN_REGULARITY") < F.col("AMT_PAYMENT_CURRENT")
    folds = {
        "nb_ccb": ("count", as_col(LOAN)),
        "AVG_DPD": ("mean", F.col("SK_DPD")),
        "PERCENTAGE_MISSED_PAYMENTS": ("mean", flag(missed) * 100),
        "DRAWINGS_ATM": ("sum", F.col("AMT_DRAWINGS_ATM_CURRENT").cast("double")),
        "DRAWINGS_TOTAL": ("sum", F.col("AMT_DRAWINGS_CURRENT").cast("double")),
        "TOTAL_DRAWINGS": ("sum", F.col("AMT_DRAWINGS_CURRENT").cast("double")),
        "NO_DRAWINGS": ("sum", F.col("CNT_DRAWINGS_CURRENT")),
    }
    stats = bulk_stats(df, [CUSTOMER], numeric_columns(df, [CUSTOMER, LOAN]), folds=folds, groups=HotKeys.of(card, [CUSTOMER]))
    # Loan and loan-limit aggregates fold into each other: the rows are grouped once.
    load = F.when(F.col("AMT_CREDIT_LIMIT_ACTUAL").isNotNull(), ratio("__balance", "AMT_CREDIT_LIMIT_ACTUAL"))
    per_limit = card.groupBy(CUSTOMER, LOAN, "AMT_CREDIT_LIMIT_ACTUAL").agg(
        F.max("AMT_BALANCE").alias("__balance"),
        F.max("CNT_INSTALMENT_MATURE_CUM").alias("__mature"),
        F.sum(differs("SK_DPD", 0)).alias("__dpd"),
    )
    per_loan = per_limit.withColumn("__load", load).groupBy(CUSTOMER, LOAN).agg(
        F.max("__mature").alias("__mature"),
        F.sum("__dpd").alias("__dpd"),
        F.sum("__load").alias("__load"),
        F.count("__load").alias("__loads"),
    )
    per_customer = per_loan.groupBy(CUSTOMER).agg(
        F.count(LOAN).alias("NO_LOANS"),
        F.coalesce(F.sum("__mature"), F.lit(0)).alias("TOTAL_INSTALMENTS"),
        F.try_divide(F.sum("__load"), F.sum("__loads")).alias("CREDIT_LOAD"),
        F.avg("__dpd").alias("DPD_COUNT"),
    )
    stats = stats.join(per_customer, CUSTOMER, "left")
    return stats.withColumns(
        {
            "INSTALLMENTS_PER_LOAN": ratio("TOTAL_INSTALMENTS", "NO_LOANS").cast("long"),
            "CASH_CARD_RATIO": ratio("DRAWINGS_ATM", "DRAWINGS_TOTAL", scale=100),
            "DRAWINGS_RATIO": ratio("TOTAL_DRAWINGS", "NO_DRAWINGS", scale=100),
        }
    )


def credit_card_features(card: DataFrame, target: DataFrame) -> DataFrame:
    return prefixed(credit_card_stats(card, target), "credit_card_balance_", [CUSTOMER])


def last_folds(rank: str, sizes: list[int], conditions: dict, last: dict) -> dict:
    """Flags of the newest row and counts over the newest rows, from ranks already on the rows."""
    r = F.col(rank)
    out = {name: ("max", F.when(r == 0, flag(c))) for name, c in last.items()}
    for n in sizes:
        out |= {pattern.format(n=n): ("count", F.when((r < n) & c, 1)) for pattern, c in conditions.items()}
    return out


def pos_cash_stats(pos: DataFrame, target: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Per customer, before columns are prefixed."""
    status = "NAME_CONTRACT_STATUS"
    hot = HotKeys.of(pos, [CUSTOMER]) if hot is None else hot
    late, tolerated = F.col("SK_DPD") > 0, F.col("SK_DPD_DEF") > 0
    df = colocated(pos, CUSTOMER, hot).withColumns(
        {
            "missing_values_count": null_count(pos.columns),
            "pos_cash_paid_late": flag(late),
            "pos_cash_paid_late_with_tolerance": flag(tolerated),
            "low_debt_overdue": F.col("SK_DPD") - F.col("SK_DPD_DEF"),
            "high_debt_ratio_overdue": ratio("SK_DPD_DEF", "SK_DPD"),
            "__status": as_col(status),
        }
    )
    df = with_label_rates(df, keyed_label_rates(pos, CUSTOMER, [status], target, "target"), [status])
    texts = string_columns(pos)
    df = CategoricalEncoder(texts, [Ordinal() for _ in texts]).fit(pos).transform(df)
    ties = [LOAN, "SK_DPD", "SK_DPD_DEF"]
    df = OrderedGroups(df, [CUSTOMER], ["MONTHS_BALANCE", *ties], hot=hot).position("__at")
    df = OrderedGroups(df, [CUSTOMER], ["-MONTHS_BALANCE", *ties], hot=hot).position("__back")
    folds = {"nb_pcb": ("count", as_col(LOAN)), "__rows": ("count", F.lit(1)), "NUNIQUE_STATUS2": ("max", F.col("__status"))}
    folds |= last_folds(
        "__back",
        LAST_SIZES,
        {"nb_overdue_{n}_last_installments": late, "nb_overdue_{n}_last_installments_with_tolerance": tolerated},
        {"last_installment_was_overdue": late, "last_installment_was_overdue_with_tolerance": tolerated},
    )
    sums, trend = slope_folds("__at", "SK_DPD", "trend")
    numbers = numeric_columns(df, [CUSTOMER, LOAN, "__at", "__back"])
    stats = bulk_stats(df, [CUSTOMER], numbers, folds=folds | sums, distinct_only=["__status"], groups=hot, placed=True)
    stats = stats.withColumn("SK_DPD_trend", trend).drop(*sums)
    # Every row of a customer holds the customer's number of statuses, so its statistics follow from it.
    v, n = F.col("__status_nunique"), F.col("__rows")
    constant = {
        "mean": v.cast("double"),
        "std": F.when(n > 1, F.lit(0.0)),
        "min": v,
        "max": v,
        "sum": v * n,
        "nunique": F.lit(1).cast("long"),
    }
    return stats.withColumns({f"NUNIQUE_STATUS_{s}": e for s, e in constant.items()}).drop("__status_nunique", "__rows")


def pos_cash_features(pos: DataFrame, target: DataFrame) -> DataFrame:
    return prefixed(pos_cash_stats(pos, target).drop("NUNIQUE_STATUS2"), "pos_cash_balance_", [CUSTOMER])


def instalment_stats(instalments: DataFrame, paid_share: bool = False, hot: HotKeys | None = None) -> DataFrame:
    """Per customer, before columns are prefixed.

    The "not totally paid" counts test overdue days; ``paid_share`` makes them test the paid
    share instead.
    """
    hot = HotKeys.of(instalments, [CUSTOMER]) if hot is None else hot
    df = colocated(instalments, CUSTOMER, hot).withColumns(
        {
            "missing_values_count": null_count(instalments.columns),
            "PAYMENT_PERC": F.coalesce(finite(ratio("AMT_PAYMENT", "AMT_INSTALMENT")), F.lit(0.0)),
            "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
            "nb_overdue_days": F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"),
        }
    )
    overdue = F.col("nb_overdue_days")
    df = df.withColumns(
        {
            "is_installment_overdue": flag(overdue > 0),
            "no_installment_overdue": flag(overdue == 0),
            "is_payment_partial": flag(F.col("PAYMENT_DIFF") > 0),
        }
    )
    ties = [LOAN, "NUM_INSTALMENT_NUMBER", "DAYS_ENTRY_PAYMENT", "AMT_PAYMENT", "AMT_INSTALMENT"]
    df = OrderedGroups(df, [CUSTOMER], ["DAYS_INSTALMENT", *ties], hot=hot).position("__at")
    df = OrderedGroups(df, [CUSTOMER], ["-DAYS_INSTALMENT", *ties], hot=hot).position("__back")
    moved = ["DAYS_ENTRY_PAYMENT", "PAYMENT_PERC", "PAYMENT_DIFF", "nb_overdue_days"]
    loans = HotKeys.of(instalments, [CUSTOMER, LOAN], hot)
    by_number = ["NUM_INSTALMENT_NUMBER", "DAYS_INSTALMENT", *ties[2:]]
    df = OrderedGroups(df, [CUSTOMER, LOAN], by_number, hot=loans).gaps({f"{c}_DIFF": c for c in moved})
    unpaid = F.col("PAYMENT_PERC") < 1
    folds = {"number_of_installments": ("count", as_col(LOAN))}
    folds |= last_folds(
        "__back",
        LAST_SIZES,
        {
            "nb_overdue_{n}_last_installments": overdue > 0,
            "nb_not_totally_paid_{n}_last_installments": unpaid if paid_share else overdue < 1,
        },
        {"last_installment_was_overdue": overdue > 0, "last_installment_was_not_totally_paid": unpaid},
    )
    slopes = {c: slope_folds("__at", c, c) for c in ("nb_overdue_days", "PAYMENT_PERC")}
    sums = {n: fold for made, _ in slopes.values() for n, fold in made.items()}
    numbers = numeric_columns(df, [CUSTOMER, LOAN, "__at", "__back"])
    stats = bulk_stats(df, [CUSTOMER], numbers, folds=folds | sums, groups=hot, placed=True)
    stats = stats.withColumns({f"{c}_trend": trend for c, (_, trend) in slopes.items()}).drop(*sums)
    return stats.withColumn("installment_overdue_ratio", ratio("is_installment_overdue_sum", "number_of_installments"))


def instalment_features(instalments: DataFrame) -> DataFrame:
    return prefixed(instalment_stats(instalments), "installments_payments_", [CUSTOMER])


def child_features(tables: dict[str, DataFrame], target: DataFrame, driver: str = "customer") -> DataFrame:
    """All child features, one row per customer, constant columns dropped.

    ``driver``: "customer" keeps every customer seen in any child table, "previous" only
    those with a previous application.  The parts are written; the join of them is not, and runs with what reads it.
    """
    parts = [
        materialise(previous_features(tables["previous_application"], tables["installments_payments"], target)),
        bureau_features(tables["bureau"], tables["bureau_balance"], target),  # written already
        materialise(credit_card_features(tables["credit_card_balance"], target)),
        materialise(pos_cash_features(tables["pos_cash_balance"], target)),
        materialise(instalment_features(tables["installments_payments"])),
    ]
    # One row per customer from here on.  A column of the join has the values of its part, and only its part is read for them.
    keys = parts[0].select(CUSTOMER) if driver == "previous" else reduce(DataFrame.union, [p.select(CUSTOMER) for p in parts]).distinct()
    varied = ConstantDrop(drop_null=False, keep=[CUSTOMER])
    seen = [p.join(keys, CUSTOMER, "left_semi") if driver == "previous" else p for p in parts]
    parts = [varied.fit(s).transform(p) for s, p in zip(seen, parts, strict=True)]
    # The keys' left joins leave the rows where they are: each part is shuffled once, and so is what is joined to the result.
    return star_join(keys, parts, CUSTOMER)
