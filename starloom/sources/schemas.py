"""Column types of the eight credit tables.

One name -> type map serves every file, because a column name means the same everywhere.
Columns without an entry are strings.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Table names, file names and keys.
FILES = {
    "application_train": "application_train.csv",
    "application_test": "application_test.csv",
    "bureau": "bureau.csv",
    "bureau_balance": "bureau_balance.csv",
    "credit_card_balance": "credit_card_balance.csv",
    "installments_payments": "installments_payments.csv",
    "pos_cash_balance": "POS_CASH_balance.csv",
    "previous_application": "previous_application.csv",
}

# Whole-number columns of at most 32 bits.
INTEGER_COLUMNS = """
CNT_CHILDREN FLAG_MOBIL FLAG_EMP_PHONE FLAG_WORK_PHONE FLAG_CONT_MOBILE FLAG_PHONE FLAG_EMAIL REGION_RATING_CLIENT
REGION_RATING_CLIENT_W_CITY HOUR_APPR_PROCESS_START REG_REGION_NOT_LIVE_REGION REG_REGION_NOT_WORK_REGION
LIVE_REGION_NOT_WORK_REGION REG_CITY_NOT_LIVE_CITY REG_CITY_NOT_WORK_CITY LIVE_CITY_NOT_WORK_CITY CNT_CREDIT_PROLONG
MONTHS_BALANCE CNT_DRAWINGS_CURRENT NFLAG_LAST_APPL_IN_DAY DAYS_BIRTH DAYS_ID_PUBLISH DAYS_CREDIT CREDIT_DAY_OVERDUE
SK_DPD SK_DPD_DEF DAYS_DECISION NUM_INSTALMENT_NUMBER DAYS_EMPLOYED DAYS_CREDIT_UPDATE AMT_CREDIT_LIMIT_ACTUAL
SELLERPLACE_AREA TARGET
OWN_CAR_AGE CNT_FAM_MEMBERS OBS_30_CNT_SOCIAL_CIRCLE DEF_30_CNT_SOCIAL_CIRCLE OBS_60_CNT_SOCIAL_CIRCLE
DEF_60_CNT_SOCIAL_CIRCLE DAYS_LAST_PHONE_CHANGE AMT_REQ_CREDIT_BUREAU_HOUR AMT_REQ_CREDIT_BUREAU_DAY
AMT_REQ_CREDIT_BUREAU_WEEK AMT_REQ_CREDIT_BUREAU_MON AMT_REQ_CREDIT_BUREAU_QRT AMT_REQ_CREDIT_BUREAU_YEAR CNT_INSTALMENT
CNT_INSTALMENT_FUTURE CNT_DRAWINGS_ATM_CURRENT CNT_DRAWINGS_OTHER_CURRENT CNT_DRAWINGS_POS_CURRENT
CNT_INSTALMENT_MATURE_CUM CNT_PAYMENT NFLAG_INSURED_ON_APPROVAL NUM_INSTALMENT_VERSION DAYS_INSTALMENT DAYS_ENTRY_PAYMENT
""".split()

# Keys.
KEY_COLUMNS = ["SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV"]

# Amounts, shares and day offsets that may be fractional.
DOUBLE_COLUMNS = """
AMT_INCOME_TOTAL AMT_CREDIT AMT_ANNUITY AMT_GOODS_PRICE REGION_POPULATION_RELATIVE DAYS_REGISTRATION TOTALAREA_MODE
EXT_SOURCE_1 EXT_SOURCE_2 EXT_SOURCE_3 DAYS_CREDIT_ENDDATE DAYS_ENDDATE_FACT AMT_CREDIT_MAX_OVERDUE AMT_CREDIT_SUM
AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE AMT_BALANCE AMT_DRAWINGS_ATM_CURRENT AMT_DRAWINGS_CURRENT
AMT_DRAWINGS_OTHER_CURRENT AMT_DRAWINGS_POS_CURRENT AMT_INST_MIN_REGULARITY AMT_PAYMENT_CURRENT AMT_PAYMENT_TOTAL_CURRENT
AMT_RECEIVABLE_PRINCIPAL AMT_RECIVABLE AMT_TOTAL_RECEIVABLE AMT_APPLICATION AMT_DOWN_PAYMENT DAYS_FIRST_DRAWING
DAYS_FIRST_DUE DAYS_LAST_DUE_1ST_VERSION DAYS_LAST_DUE DAYS_TERMINATION AMT_INSTALMENT AMT_PAYMENT RATE_DOWN_PAYMENT
RATE_INTEREST_PRIMARY RATE_INTEREST_PRIVILEGED
""".split()

# Building measures, each as average, mode and median.
BUILDING_MEASURES = """
APARTMENTS BASEMENTAREA YEARS_BEGINEXPLUATATION YEARS_BUILD COMMONAREA ELEVATORS ENTRANCES FLOORSMAX FLOORSMIN LANDAREA
LIVINGAPARTMENTS LIVINGAREA NONLIVINGAPARTMENTS NONLIVINGAREA
""".split()
BUILDING_FORMS = ["AVG", "MODE", "MEDI"]

DOCUMENT_FLAGS = [f"FLAG_DOCUMENT_{i}" for i in range(2, 22)]


def column_types() -> dict[str, T.DataType]:
    types: dict[str, T.DataType] = {c: T.LongType() for c in KEY_COLUMNS}
    types |= {c: T.IntegerType() for c in INTEGER_COLUMNS + DOCUMENT_FLAGS}
    types |= {c: T.DoubleType() for c in DOUBLE_COLUMNS}
    types |= {f"{m}_{f}": T.DoubleType() for m in BUILDING_MEASURES for f in BUILDING_FORMS}
    return types


def schema_for(header: list[str], types: dict[str, T.DataType] | None = None) -> T.StructType:
    types = column_types() if types is None else types
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder of them, from the header alone."""
    return spark.read.option("header", True).csv(path).columns
