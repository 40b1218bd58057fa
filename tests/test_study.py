"""A whole study from CSV extracts to published tables."""

import os

import pytest
from pyspark.sql import functions as F

from labspark.checks import composites as c
from labspark.checks.registry import Tables
from labspark.plans import study
from labspark.sources import tables

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not found")


def write_extracts(spark, folder, names):
    src = c.sources(Tables(spark, SF_DIR))
    for name in names:
        file, fields = tables.FILES[name]
        df = src[name]
        cols = [(F.col(f.name).cast("string") if f.name in df.columns else F.lit(None).cast("string")).alias(f.source) for f in fields]
        df.select(*cols).coalesce(1).write.option("header", True).option("escape", '"').csv(f"{folder}/{file}")
    known = [tuple(map(str, u[:3])) + (None if u[3] is None else str(u[3]),) for u in c.UNITS]
    known += [("GFR", "mmol/L", "x", "1.0"), ("glucose", "bad", "invalid", None)]
    spark.createDataFrame(known, "label string, source_unit string, target_unit string, factor string").coalesce(1).write.option("header", True).csv(f"{folder}/units.csv")


def check_suppressed(spark, target, names):
    assert names == sorted(os.listdir(target)) or [f"{n}.csv" for n in names] == sorted(os.listdir(target))
    for n in names:
        out = tables.read_strings(spark, f"{target}/{n}.csv")
        for col in [x for x in out.columns if x == "n" or x.startswith("n_")]:
            if n != "regressions":
                low = out.filter((F.col(col).try_cast("double") > 0) & (F.col(col).try_cast("double") < c.STUDY.k)).count()
                assert low == 0, (n, col)


def test_mandatory_sources_alone(spark, tmp_path):
    write_extracts(spark, tmp_path / "in", ["lab", "patients"])
    names = study.run_study(spark, str(tmp_path / "in"), str(tmp_path / "in/units.csv"), str(tmp_path / "out"), c.STUDY)
    assert {"description_statistics", "quality_control", "regressions", "transitions"} <= set(names) and "sample_quality_specimens" not in names
    check_suppressed(spark, tmp_path / "out", names)


def test_all_sources_converted(spark, tmp_path):
    write_extracts(spark, tmp_path / "in", [n for n in tables.FILES if n != "procedures_icu"])
    tables.convert_all(spark, str(tmp_path / "in"), str(tmp_path / "stored"))
    names = study.run_study(spark, str(tmp_path / "stored"), str(tmp_path / "in/units.csv"), str(tmp_path / "out"), c.STUDY, converted=True)
    assert {"sample_quality_specimens", "cooccurrence", "covariate_timeline"} <= set(names)
    check_suppressed(spark, tmp_path / "out", names)
    sections = {r.section for r in tables.read_strings(spark, str(tmp_path / "out/quality_control.csv")).select("section").distinct().collect()}
    assert {"repeats", "condition_timing", "references_medications", "procedure_times"} <= sections
