"""Large joined tables are dealt so that no task sorts more than a bounded number of rows, whatever their columns compress to."""

from pyspark.sql import functions as F

from labspark import session
from labspark.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_joined_tables_are_dealt_by_rows(spark, monkeypatch):
    whole = {n: fixtures.load(spark, SF, n).collect() for n in ("fx_line", "fx_enc")}
    monkeypatch.setattr(session, "CELLS_PER_TASK", 2000)
    rows = fixtures.table(spark, SF, "lineitem").count()
    for threshold in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            line = fixtures.load(spark, SF, "fx_line")
            most = line.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert most < rows / 10  # all of them before, in the one task that adaptive execution left
            for n, old in whole.items():
                assert sorted(map(str, fixtures.load(spark, SF, n).collect())) == sorted(map(str, old))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_tables_are_left_to_spark(spark):
    assert "REPARTITION" not in fixtures.load(spark, SF, "fx_line")._jdf.queryExecution().executedPlan().toString()
