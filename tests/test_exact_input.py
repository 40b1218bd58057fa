"""Input that must not be cut or falsified: line breaks, offending rows, NaN and infinities, large offsets."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from labspark.operators import quantiles, regress
from labspark.sources import tables


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note\n1,"a\nb"\n2,"say ""x"", ok"\n3,c\n')
    rows = tables.read_strings(spark, str(tmp_path / "t.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "a\nb"), ("2", 'say "x", ok'), ("3", "c")]


def test_every_offending_row_is_kept(spark):
    raw = spark.createDataFrame([(f"l{i}", "u", "v", "x") for i in range(57)], "label string, source_unit string, target_unit string, factor string")
    with pytest.raises(tables.ContractError, match="57 entries") as e:
        tables.load_units(raw)
    assert e.value.rows.count() == 57
    used = spark.createDataFrame([(f"l{i}", "w") for i in range(31)], "label string, unit string")
    with pytest.raises(tables.ContractError, match="31 entries") as e:
        tables.check_units(used, raw)
    assert e.value.rows.count() == 31


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, math.nan, 5.0], [math.inf, 1.0, -math.inf, 2.0], [math.nan] * 3, [math.inf] * 4 + [0.0], [-0.0, 0.0, 1e-310, -1e308, 1e308]])
def test_percentiles_with_special_values(spark, values):
    got = quantiles.percentiles(spark.createDataFrame([("a", v) for v in values], "k string, v double"), "k", "v", {"q0": 0.0, "q5": 0.5, "q1": 1.0}).first()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [[v] for v in values])
    for name, p in (("q0", 0.0), ("q5", 0.5), ("q1", 1.0)):
        want = con.execute(f"SELECT quantile_disc(v, {p}) FROM t").fetchone()[0] if len(values) % 2 or p in (0, 1) else None
        if want is not None:
            assert got[name] == want or (math.isnan(got[name]) and math.isnan(want))


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_standard_errors_do_not_depend_on_an_offset(spark, offset):
    rows = [(float(i % 7), "male" if i % 2 else "female", float(30 + i % 50), offset + 0.5 * (i % 7) + math.sin(i), i % 9) for i in range(400)]
    d = spark.createDataFrame(rows, "x double, gender string, age double, y double, c int")
    model = regress.Model("m", "y", ("x",), {"gender": ("male", "female")}, "age")
    plain = {r.term: r.std_error for r in regress.ols(d.withColumn("y", F.col("y") - offset), model).collect()}
    moved = {r.term: r.std_error for r in regress.ols(d, model).collect()}
    assert all(math.isclose(plain[t], moved[t], rel_tol=1e-5) for t in plain)


def test_ordered_bits(spark):
    rng = random.Random(0)
    values = [rng.choice([-1, 1]) * rng.random() * 2.0**rng.randrange(-1070, 1023) for _ in range(3000)]
    values += [s * x for s in (-1, 1) for e in range(-1074, 1024) for x in (2.0**e, math.nextafter(2.0**e, 0), math.nextafter(2.0**e, math.inf))]
    values += [0.0, -0.0, math.inf, -math.inf, math.nan, 1.7976931348623157e308, -1.7976931348623157e308, 5e-324]
    got = quantiles.with_ordered_bits(spark.createDataFrame([(v,) for v in values], "v double")).collect()
    rows = sorted(got, key=lambda r: (math.isnan(r["v"]), r["v"] if not math.isnan(r["v"]) else 0))
    bits = [r["__bits"] for r in rows]
    assert bits == sorted(bits)
    assert all(a["__bits"] < b["__bits"] for a, b in zip(rows, rows[1:]) if abs(a["v"] - b["v"]) > 4e-15 * abs(b["v"]))


def test_percentiles_of_values_close_together(spark):
    """100,000 values within [100000, 100001), and a group of their own at one value: narrowed round by round, never one sort."""
    n = 100_000
    d = spark.range(n).select(F.lit("a").alias("k"), (100_000 + ((F.col("id") * 7919) % n) / n).alias("v")).unionByName(spark.range(50).select(F.lit(None).cast("string").alias("k"), F.lit(3.5).alias("v")))
    got = {r["k"]: r for r in quantiles.percentiles(d, "k", "v", {"q1": 0.01, "q25": 0.25, "q5": 0.5, "q1_": 1.0}).collect()}
    values = sorted(100_000 + i / n for i in range(n))
    for name, p in (("q1", 0.01), ("q25", 0.25), ("q5", 0.5), ("q1_", 1.0)):
        pos = p * (n - 1)
        low = values[math.floor(pos)]
        assert math.isclose(got["a"][name], low + (values[math.ceil(pos)] - low) * (pos - math.floor(pos)), rel_tol=1e-15)
        assert got[None][name] == 3.5
    bits = quantiles.with_ordered_bits(d.filter("k = 'a'")).groupBy(F.shiftright("__bits", quantiles.ROUNDS[0])).count().agg(F.max("count")).first()[0]
    assert bits <= 7_000  # of 100,000 values, after the first round
