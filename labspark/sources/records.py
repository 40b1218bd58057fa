"""CSV files with quoted line breaks, read by many tasks.

Whether a physical line starts a record depends on all lines before it. What a line does to that state is one of three things
whatever the line is: keep it, turn it round, or set it. So a run of lines is summed up by the last state that was set and
the turns since then. Lines are scanned within their split, one row per split is scanned within its file, and
only lines of records that span several lines are brought together.

Rules: a quoted cell begins right at the start of a line or after a comma; quotes inside it are doubled. Quotes elsewhere in
an unquoted cell are ordinary characters. Records end at a line feed (a carriage return before it is dropped); line
breaks in cells stay as they are. Empty lines are skipped, the first record of each file is its header. A cell
that is never closed takes the rest of its file, in one record. Files that cannot be split (compressed ones) are one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labspark.session import materialize

SPLIT = ["file", "split"]
_CELL = '"[^"]*+(?:""[^"]*+)*+"[^,]*+'  # a closed quoted cell, with whatever stands before the next comma
_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def _left_open(text: Column) -> Column:
    """Whether a quoted cell is still open at the end of a text that begins outside of one."""
    return F.regexp_replace(text, f"(^|,){_CELL}", "$1").rlike('(^|,)"')


def with_effect(lines: DataFrame) -> DataFrame:
    """Adds ``sets`` (state that the line leaves behind whatever came before, else NULL) and ``turns`` (1: turns the state round)."""
    v = F.col("value")
    closing = f"^{_CELL[1:]}"
    outside = F.when(v.contains('"'), _left_open(v)).otherwise(False)
    inside = F.when(v.rlike(closing), _left_open(F.regexp_replace(v, closing, ""))).otherwise(True)
    return (lines.withColumns({"__out": outside, "__in": inside})
            .withColumns({"sets": F.when(F.col("__out") == F.col("__in"), F.col("__out").cast("int")),
                          "turns": (F.col("__out") & ~F.col("__in")).cast("int")}).drop("__out", "__in"))


def _scan(df: DataFrame, keys, order) -> DataFrame:
    """Adds the summary of all rows of ``keys`` up to each one: ``last`` (state last set, with the turns up to there taken
    out, else NULL) and ``odd`` (turns so far, modulo 2). The state after the row is ``last xor odd``."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (df.withColumn("odd", (F.sum("turns").over(upto) % 2).cast("int"))
            .withColumn("last", F.last(F.col("sets").bitwiseXOR(F.col("odd")), ignorenulls=True).over(upto)))


def _before(keys, order, value: Column, first) -> Column:
    return F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy(order)), first)


def physical_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their file, the start of their split and their place (``pos``) in it."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos")))


def records(lines: DataFrame) -> DataFrame:
    """One row (file, record, header) per record of ``physical_lines``; ``header`` marks the first record of a file.

    The marked lines are stored once below the shared folder (an action)."""
    lines = _scan(with_effect(lines), SPLIT, "pos")
    splits = lines.groupBy(*SPLIT).agg(F.max_by(F.struct("last", "odd"), "pos").alias("s"))
    # a split sets the state if any of its lines does, else it turns the state or keeps it
    splits = _scan(splits.select(*SPLIT, F.col("s.last").bitwiseXOR(F.col("s.odd")).alias("sets"),
                                 F.when(F.col("s.last").isNull(), F.col("s.odd")).otherwise(0).alias("turns")), ["file"], "split")
    state = F.coalesce(F.col("last"), F.lit(0)).bitwiseXOR(F.col("odd"))
    splits = splits.select(*SPLIT, _before(["file"], "split", state, F.lit(0)).alias("carry"))
    lines = lines.join(splits, SPLIT)
    after = F.coalesce(F.col("last"), F.col("carry")).bitwiseXOR(F.col("odd"))
    here = Window.partitionBy(*SPLIT).orderBy("pos")
    lines = (lines.withColumn("open", after == 1)
             .withColumns({"begins": ~_before(SPLIT, "pos", F.col("open"), F.col("carry") == 1),
                           "header": (F.col("split") == 0) & (F.row_number().over(here) == 1)})
             .withColumn("start", F.last(F.when(F.col("begins"), F.struct("split", "pos")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    lines = materialize(lines.select(*SPLIT, "pos", "value", "header", "begins", "open", "start"), "csv-lines")  # read three times below
    single = lines.filter("begins AND NOT open").select("file", F.col("value").alias("record"), "header")
    parts = lines.filter("NOT begins OR open").select(*SPLIT, "pos", "value", "header", "start")
    # what continues at the head of a split belongs to the last record that begins in an earlier split of the file
    ends = lines.groupBy(*SPLIT).agg(F.max("start").alias("latest"))
    ends = ends.select(*SPLIT, F.last("latest", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    parts = parts.join(ends, SPLIT).withColumn("start", F.coalesce("start", "earlier"))
    joined = (parts.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("split", "pos", "value"))).alias("v"), F.max("header").alias("header"))
              .select("file", F.array_join(F.col("v.value"), "\n").alias("record"), "header"))
    return single.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r\\z", ""))


def read_records(spark: SparkSession, path) -> DataFrame:
    """CSV with a header, every column as text, like ``tables.read_strings``, with as many tasks as the files have splits.

    The columns are those of the first file's header; all files must have the same."""
    names = spark.read.option("header", True).options(**_OPTIONS).csv(path).columns
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    rows = records(physical_lines(spark, path)).filter(~F.col("header") & (F.col("record") != ""))
    parsed = rows.select(F.from_csv("record", schema, _OPTIONS).alias("r"))
    return parsed.select(*[F.col(f"r._{i}").alias(n) for i, n in enumerate(names)])
