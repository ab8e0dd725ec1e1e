"""Queries that name the whole job run it as the library does, without parameters that leave little of it."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from starloom.operators.model import BoostedTrees
from starloom.plans.credit_run import application_stages
from starloom.suite import credit


def test_end_to_end_chooses_rounds_over_folds_and_grows_whole_trees(spark, folder, monkeypatch):
    given = {}

    def run(tables, train, test, **parameters):
        given.update(parameters, train=train, test=test)
        return SimpleNamespace(predictions=test)

    monkeypatch.setattr(credit, "run", run)
    credit.end_to_end(spark, folder)
    assert given.pop("train").where("TARGET IS NULL").isEmpty() and given.pop("test").where("TARGET IS NOT NULL").isEmpty()
    *_, select, trees = application_stages(["AMT_CREDIT"], **given)
    usual = BoostedTrees("TARGET").config
    assert trees.config["select_rounds"] == "cv"
    assert {k: trees.config[k] for k in ("rounds", "select_rounds", "folds", "max_depth")} == {k: usual[k] for k in ("rounds", "select_rounds", "folds", "max_depth")}
    assert select.config["rounds"] == usual["rounds"]


def test_flagship_puts_skewed_columns_on_a_log_scale(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    app = credit.credit_table(spark, folder, "application")
    names = [p + c for p, (_, found) in credit.SHOWN.items() for c in found] + [f"installments_payments_{c}" for c in credit.SHOWN_LOGS]
    children = app.select(credit.CUSTOMER, *[F.col(credit.CUSTOMER).alias(c) for c in names])
    monkeypatch.setattr(credit.C, "child_features", lambda tables, target: children)
    rows = {r[0]: r for r in credit.flagship(spark, folder).collect()}
    plain = credit.application_rows(app).select(credit.CUSTOMER, "nb_annuities", "credit_income_ratio").collect()
    assert len(plain) == len(rows) == 1500
    for key, annuities, ratio in plain:  # the first has a skewness of 13.8
        assert rows[key]["nb_annuities"] == (annuities and pytest.approx(math.log1p(annuities)))
        assert rows[key]["credit_income_ratio"] == pytest.approx(ratio)
    assert rows[7]["bureau_BUREAU_LOAN_TYPES"] == 7 and rows[7]["installments_payments_AMT_PAYMENT_sum"] == pytest.approx(math.log(8))
