"""Registered queries give the operator's whole result."""

import json

from labspark.checks import composites as c
from labspark.checks.registry import Tables
from labspark.operators import describe

SF_DIR = "/root/testdata/sf0.001"


def test_description_has_all_standard_cohorts(spark):
    t = Tables(spark, SF_DIR)
    known = describe.with_cohorts(c.base_table(t)).select(*describe.COHORT_COLUMNS).distinct().collect()
    found = c.describe_measurements(t).filter("section = 'statistics'").collect()
    assert {tuple(json.loads(r["row"])[k] for k in describe.COHORT_COLUMNS) for r in found} == {tuple(r) for r in known}
    assert len(known) > 3


def test_sample_comparison_takes_the_flag_of_the_conditions(spark, monkeypatch):
    t = Tables(spark, SF_DIR)
    monkeypatch.setattr(c.covariates, "sample_pairs", lambda samples, table, spec: table)
    monkeypatch.setattr(c.covariates, "compare_samples", lambda pairs, *_: pairs)
    found = {(r["obs_id"], r["thromb"]) for r in c.compare_samples(t).select("obs_id", "thromb").collect()}
    flags = {(r["obs_id"], r["thromb"]) for r in c.wide(t).select("obs_id", "thromb").collect()}
    assert found == flags
    assert {flag for _, flag in found} == {0, 1}
