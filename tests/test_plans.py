"""Invariants of a whole study."""

import pytest
from pyspark.sql import functions as F

from labspark.checks import composites as c
from labspark.checks.registry import Tables
from labspark.operators import cooccur
from labspark.plans import base, covariates
from labspark.session import materialize

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    return c.study(Tables(spark, SF_DIR))


@pytest.fixture(scope="module")
def table(study):
    return materialize(covariates.covariate_table(study["facts"], c.STUDY, *[study[k] for k in ("encounters", "medications", "labs", "procedures", "conditions")]), "wide")


def test_rows_are_kept_and_flags_are_binary(study, table):
    assert table.count() == study["facts"].count() > 0
    flags = [n for n, t in table.dtypes if t == "int" and n != "age"]
    assert len(flags) > 15
    worst = table.agg(*[F.count_if(F.col(f).isNull() | ~F.col(f).isin(0, 1)).alias(f) for f in flags]).first()
    assert not any(worst)


def test_absent_sources_are_left_out(study):
    bare = covariates.covariate_table(study["facts"], c.STUDY)
    assert bare.filter("enc_class <> 'AMB' OR first <> 0").count() == 0
    assert "dialyse_during" not in bare.columns and "next_flag" in bare.columns
    assert base.medications(None, None, None, None, c.STUDY) is None
    assert base.procedures(None, None, None, c.STUDY) is None


def test_counts_add_up(table):
    out = cooccur.cooccurrence(table, list(c.STUDY.medication_groups), "result", cooccur.cohorts_medication())
    assert out.filter("n_match + n_no_match <> n_total").count() == 0
    follow = cooccur.followup_cooccurrence(table, "result")
    assert follow.filter("n_match + n_no_match <> n_total").count() == 0


def test_regressions_run(table, study):
    windows = covariates.window_dict(covariates.study_availability(study, c.STUDY)[1])
    out = covariates.regressions(table, windows, c.STUDY).collect()
    assert all(r["n_used"] >= c.STUDY.k and r["std_error"] >= 0 for r in out)
