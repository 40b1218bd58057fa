"""Input contracts."""

from datetime import datetime

import pytest

from labspark.sources import tables as src

FIELDS = (src.Field("id", "id"), src.Field("v", "Value", "double"), src.Field("t", "When", src.TS), src.Field("note", "Note"), src.Field("issued", "Issued", src.TS, False))


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_typed_scan(spark, tmp_path):
    path = put(tmp_path, "a.csv", '﻿id,Value,When,Note,Extra\n1,2.5,2020-01-02T03:04:05+02:00,"a, ""b""",x\n2,,2020-06,,y\n3,abc,2020-01-02 03:04:05,,\n')
    rows = src.read_source(spark, path, FIELDS).orderBy("id").collect()
    assert [r.v for r in rows] == [2.5, None, None]
    assert rows[0].t == rows[2].t == datetime(2020, 1, 2, 3, 4, 5)
    assert rows[0].note == 'a, "b"' and rows[1].issued is None
    bad = {r.column_name: r.n for r in src.unparseable(src.read_strings(spark, path), FIELDS).collect()}
    assert bad["v"] == 1


def test_missing_columns(spark, tmp_path):
    path = put(tmp_path, "b.csv", "id,Value\n1,2\n")
    with pytest.raises(src.ContractError, match="Note, When"):
        src.read_source(spark, path, FIELDS)
    assert {r.missing for r in src.check_columns({"b": src.read_strings(spark, path)}, {"b": FIELDS}).collect()} == {"Note", "When"}


def test_read_all(spark, tmp_path):
    for name in ("lab", "patients"):
        file, fields = src.FILES[name]
        put(tmp_path, file, ",".join(f.source for f in fields if f.required) + "\n")
    found = src.read_all(spark, str(tmp_path))
    assert [n for n, d in found.items() if d is not None] == ["lab", "patients"]
    assert dict(found["lab"].dtypes)["issued"] == "timestamp_ntz"
    with pytest.raises(src.ContractError, match="mandatory"):
        src.read_all(spark, str(tmp_path / "nowhere"))


def unit_table(spark, rows):
    return spark.createDataFrame(rows, "label string, source_unit string, target_unit string, factor string")


def test_unit_rules(spark):
    ok = src.load_units(unit_table(spark, [(" a ", "u", "m", " 2 "), ("a", "x", "invalid", None), ("a", None, "m", "1")]))
    assert {tuple(r) for r in ok.collect()} == {("a", "u", "m", 2.0), ("a", "x", "invalid", None), ("a", "", "m", 1.0)}
    for rows, what in (([("a", "u", "m", "1"), ("a", "u ", "m", "1")], "duplicate"), ([("a", "u", "m", "x")], "non_numeric"),
                       ([("a", "u", "m", " ")], "missing_factor"), ([("a", "u", "m", "1"), ("a", "v", "n", "1")], "several_targets")):
        with pytest.raises(src.ContractError, match=what):
            src.load_units(unit_table(spark, rows))
    with pytest.raises(src.ContractError, match="missing columns"):
        src.load_units(unit_table(spark, []).drop("factor"))


def test_unknown_units_stop(spark):
    units = spark.createDataFrame([("a", "u", "u", 1.0)], "label string, source_unit string, target_unit string, factor double")
    data = spark.createDataFrame([("a", "u"), ("a", "w"), (None, "z"), ("a", None)], "label string, unit string")
    with pytest.raises(src.ContractError, match="a w"):
        src.check_units(data, units)
    assert src.check_units(data.filter("unit = 'u'"), units).count() == 1


def test_write_result(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "g string, n int")
    src.write_result(df, str(tmp_path / "out"), order=["g"])
    files = list((tmp_path / "out").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().split() == ["g,n", "a,1", "b,2"]
