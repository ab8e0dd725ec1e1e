"""Credit workloads: split customers change nothing, and known equalities hold."""

import pytest

from starloom.operators import aggregate, tables
from starloom.plans import credit_children as C
from starloom.suite.base import tidy
from starloom.suite.mapping import credit_table, credit_target


def rows(df):
    df = tidy(df)
    return sorted(map(tuple, df.select(sorted(f"`{c}`" for c in df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", ["instalments", "pos", "bureau"])
def test_hot_customers(spark, folder, monkeypatch, name):
    if name == "instalments":
        data = credit_table(spark, folder, "installments_payments")
        run = lambda: C.instalment_stats(data)
    elif name == "pos":
        data, target = credit_table(spark, folder, "pos_cash_balance"), credit_target(spark, folder)
        run = lambda: C.pos_cash_stats(data, target)
    else:
        data, target = credit_table(spark, folder, "bureau"), credit_target(spark, folder)
        balance = credit_table(spark, folder, "bureau_balance")
        run = lambda: C.bureau_stats(data, balance, target)
    plain = rows(run())
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 12)
    monkeypatch.setattr(aggregate, "GROUP_VALUES", 0)
    assert tables.HotKeys.of(data, ["SK_ID_CURR"])
    assert rows(run()) == plain


def test_equal_features(spark, folder):
    data, target = credit_table(spark, folder, "bureau"), credit_target(spark, folder)
    out = C.bureau_stats(data, credit_table(spark, folder, "bureau_balance"), target)
    different = out.where(
        "abs(AMT_CREDIT_SUM_sum - TOTAL_CUSTOMER_CREDIT) > 1e-6 or bureau_count <> nb_bureau_records or abs(DAYS_DIFF_mean * bureau_count - DAYS_DIFF_sum) > 1e-6"
    )
    assert different.count() == 0


def test_no_python_in_the_plan(spark, folder):
    out = C.instalment_stats(credit_table(spark, folder, "installments_payments"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan
    # One shuffle of the rows by customer serves windows and aggregate; the join to orders comes before.
    assert plan.count("Exchange hashpartitioning(SK_ID_CURR") == 1
