"""Scalar rules at their edges."""

from datetime import date, datetime

from pyspark.sql import functions as F

from labspark.functions import dates, predicates as pred, privacy, values
from labspark.spec import CONDITION_GROUPS, LAB_CODES, MAIN_CODES, MAIN_CUTS, MEDICATION_GROUPS, PROCEDURE_SNOMED


def col(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_partial_dates(spark):
    raw = [("1950",), ("1950-03",), (" 1950-03-04 ",), ("1950-02-30",), (None,), ("19500101",)]
    got = col(spark, raw, "d string", dates.partial_date("d"))
    assert got == [date(1950, 7, 1), date(1950, 3, 15), date(1950, 3, 4), None, None, None]


def test_age_is_truncated_toward_zero(spark):
    rows = [(date(2000, 2, 29), date(2001, 2, 28)), (date(2000, 6, 1), date(2018, 5, 31)), (date(2000, 6, 1), date(2018, 6, 1)), (date(2020, 6, 1), date(2019, 12, 1)),
            (None, date(2020, 1, 1))]
    assert col(spark, rows, "b date, t date", dates.age_years("b", "t")) == [1, 17, 18, 0, None]


def test_compare_value(spark):
    rows = [(1.00049, "<"), (1.0, " < "), (1.0, ">"), (1.0, "<="), (1.0, ">="), (1.0, None), (1.0, "~"), (None, "<")]
    got = col(spark, rows, "v double, c string", F.round(values.compare_value("v", "c"), 7))
    assert got == [0.999999, 0.999999, 1.000001, 1.0, 1.0, 1.0, 1.0, None]


def test_grades(spark):
    rows = [(2.4,), (2.5,), (3.0,), (3.5,), (5.0,), (5.5,), (6.0,), (6.5,), (6.6,), (None,)]
    got = col(spark, rows, "v double", values.classify_detail("v", F.lit(3.5), F.lit(5.0), MAIN_CUTS))
    assert got == ["L3", "L2", "L1", "N", "N", "H1", "H2", "H3", "H4", None]


def test_one_sided_ranges(spark):
    rows = [(5.0, 50.0, None, None, None, None), (5.0, 50.0, 6.0, None, None, None), (5.0, 50.0, None, None, 60.0, None), (5.0, 50.0, 4.0, None, 60.0, None),
            (5.0, 70.0, None, 4.0, 60.0, None)]
    got = col(spark, rows, "r double, n double, lo double, hi double, dl double, dh double",
              values.classify_one_sided("r", "n", "lo", "hi", F.col("dl"), F.col("dh")))
    assert got == [None, "L", "L", "N", "H"]


def test_status_and_system(spark):
    rows = [(None, None), ("final", "a"), ("cancelled", "a"), ("final", "b")]
    df = spark.createDataFrame(rows, "s string, y string")
    assert df.filter(pred.status_ok("s", ["cancelled"])).count() == 3
    assert df.filter(pred.system_is("y", "a")).count() == 2
    assert df.filter(pred.system_is("y", "a", null_ok=True)).count() == 3


def test_notes_ignore_case_of_umlauts(spark):
    rows = [("HÄMOLYSE",), ("leicht hemolytisch",), ("ohne Befund",), (None,)]
    assert col(spark, rows, "t string", pred.matches_any("t", ["hämol", "haemol", "hemol"])) == [True, True, False, None]


def test_k_mask(spark):
    rows = [("a", 0, 7, 1.0), ("b", 4, 7, 1.0), ("c", 5, 7, 1.0), ("d", None, 7, 1.0), ("e", 9, 2, 1.0)]
    df = spark.createDataFrame(rows, "g string, n int, m int, x double")
    got = [tuple(r) for r in privacy.k_mask(df, ["n", "m"], ["g"]).orderBy("g").collect()]
    assert got == [("a", "0", "7", 1.0), ("b", "<5", "<5", None), ("c", "5", "7", 1.0), ("d", "<5", "<5", None), ("e", "<5", "<5", None)]


def test_k_cells_and_censor(spark):
    rows = [("<5",), ("3",), ("0",), ("5",), ("-2",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "c string")
    assert [r[0] for r in privacy.k_cells(df, "c").collect()] == ["<5", "<5", "0", "5", "-2", "x", None]
    assert col(spark, rows, "c string", privacy.k_censor("c")) == ["<5", "<5", "0", "5", "<5", "x", None]


def test_k_mask_is_stable(spark):
    df = spark.createDataFrame([("a", 3), ("b", 8)], "g string, n int")
    once = privacy.k_cells(df, "n")
    assert once.collect() == privacy.k_cells(once, "n").collect()


def test_labels_and_references(spark):
    rows = [(1.0, None), (None, 2.0), (1.0, 2.5), (None, None)]
    assert col(spark, rows, "a double, b double", values.range_label("a", "b")) == ["ab 1.0", "bis 2.0", "1.0-2.5", None]
    assert col(spark, [("Encounter/7",), (None,)], "r string", values.ref_kind("r")) == ["Encounter", None]
    assert col(spark, [("7", "x"), (None, "x")], "e string, o string", values.cluster_id("e", "o")) == ["7_imp", "x_amb"]


def test_hash_keeps_the_type_and_separates_domains(spark):
    df = spark.createDataFrame([("Patient/1",), ("1",)], "r string")
    a, b = [r[0] for r in df.select(privacy.hash_id("r", "k")).collect()]
    assert a.startswith("Patient/") and len(a) == len("Patient/") + 32 and len(b) == 32
    p, q = df.select(privacy.pseudonym("r", "x", "k"), privacy.pseudonym("r", "y", "k")).first()
    assert p != q
    assert col(spark, [("1950-03-04",), ("1950-03",), ("1950",)], "d string", privacy.birth_month("d")) == ["1950-03", "1950-03", "1950"]


def test_code_lists_are_disjoint():
    seen = list(MAIN_CODES) + [c for g in LAB_CODES.values() for c in g]
    assert len(seen) == len(set(seen))
    assert (len(MEDICATION_GROUPS), sum(map(len, MEDICATION_GROUPS.values()))) == (26, 33)
    assert (len(CONDITION_GROUPS), sum(map(len, CONDITION_GROUPS.values()))) == (19, 21)
    assert len(set(PROCEDURE_SNOMED)) == 30


def test_hours_between(spark):
    rows = [(datetime(2024, 3, 31, 0), datetime(2024, 3, 31, 6)), (datetime(2024, 1, 1), datetime(2023, 12, 31))]
    assert col(spark, rows, "a timestamp_ntz, b timestamp_ntz", dates.hours_between("a", "b")) == [6.0, -24.0]
