"""CSV records over line and split borders: the same rows as one task reads with the multi-line reader."""

import random

import pytest
from pyspark.sql import functions as F

from labspark.sources import records, tables


@pytest.fixture
def small_splits(spark):
    """Splits of 97 bytes, so that records span several of them."""
    keys = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cell(rnd, i):
    kind = rnd.randrange(9)
    if kind < 3:
        return str(i), str(i)
    if kind == 3:
        return "", None
    if kind == 4:
        return f'5" wide {i}', f'5" wide {i}'  # an ordinary character in an unquoted cell
    parts = [rnd.choice(["a", ",", '"', "\n", "\n\n", "ä€", " ", ',"', '",', "x" * rnd.randrange(60)]) for _ in range(rnd.randrange(1, 9))]
    text = "s" + "".join(parts) + "e"
    return '"' + text.replace('"', '""') + '"', text


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_what_was_written(spark, tmp_path, small_splits, end):
    rnd = random.Random(3)
    (tmp_path / "d").mkdir()
    want = []
    for f in range(3):
        out = ["id,note,more"]
        for i in range(80):
            a, b = cell(rnd, i), cell(rnd, i)
            out.append(f"{f}-{i},{a[0]},{b[0]}")
            want.append((f"{f}-{i}", a[1], b[1]))
        write(tmp_path / "d" / f"{f}.csv", end.join(out) + (end if f else ""))
    path = str(tmp_path / "d")
    lines = records.physical_lines(spark, path)
    assert lines.select("file", "split").distinct().count() > 60
    got = records.read_records(spark, path)
    assert got.columns == ["id", "note", "more"]
    assert rows_of(got) == sorted(want, key=str)
    if end == "\n":
        assert rows_of(got) == rows_of(tables.read_strings(spark, path))


def test_awkward_files(spark, tmp_path, small_splits):
    long = "line\n" * 300  # one record over many whole splits
    texts = {"long": f'id,note\n1,"{long}"\n2,b\n', "header": '"id","no\nte"\n1,"x"\n\n2,\n', "empty": "id,note\n", "none_at_end": 'id,note\n1,"a\nb"',
             "open": 'id,note\n1,a\n2,"never closed\n3,b\n', "after": 'id,note\n1,"a"\n2,"b\n"\n"3","""\n"""\n', "ragged": "id,note\n1\n2,b,c\n"}
    want = {"long": [("1", long), ("2", "b")], "header": [("1", "x"), ("2", None)], "empty": [], "none_at_end": [("1", "a\nb")],
            "after": [("1", "a"), ("2", "b\n"), ("3", '"\n"')], "ragged": [("1", None), ("2", "b")]}
    for name, text in texts.items():
        got = records.read_records(spark, write(tmp_path / f"{name}.csv", text))
        if name in want:
            assert rows_of(got) == want[name], name
        assert got.count() == tables.read_strings(spark, str(tmp_path / f"{name}.csv")).count(), name
    assert records.read_records(spark, str(tmp_path / "header.csv")).columns == ["id", "no\nte"]


def test_convert_all_splits_files(spark, tmp_path, small_splits):
    """Typed tables come from the split reader; quoted line breaks survive."""
    fields = (tables.Field("id", "id"), tables.Field("v", "Value", "double"), tables.Field("note", "Note"))
    files = {"lab": ("a.csv", fields), "patients": ("b.csv", fields), "absent": ("c.csv", fields)}
    for f in ("a.csv", "b.csv"):
        write(tmp_path / f, "id,Value,Note,Extra\n" + "".join(f'{i},{i}.5,"n\n{i}",x\n' for i in range(200)))
    tables.convert_all(spark, str(tmp_path), str(tmp_path / "out"), files)
    found = tables.read_converted(spark, str(tmp_path / "out"), files)
    assert found["absent"] is None
    assert rows_of(found["lab"]) == sorted(((str(i), i + 0.5, f"n\n{i}") for i in range(200)), key=str)
    write(tmp_path / "a.csv", "id,Value\n1,2\n")
    with pytest.raises(tables.ContractError, match="Note"):
        tables.convert_all(spark, str(tmp_path), str(tmp_path / "out2"), files)


def test_only_long_records_are_brought_together(spark, tmp_path, small_splits):
    path = write(tmp_path / "t.csv", "id,note\n" + "".join(f"{i},plain\n" for i in range(300)) + '300,"two\nlines"\n')
    out = records.records(records.physical_lines(spark, path))
    assert out.count() == 302 and out.filter(F.col("record").contains("\n")).count() == 1
