"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import math
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Settings the plans rely on for speed; results do not depend on them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(master: str | None = None, app: str = "labspark", **conf) -> SparkSession:
    """A session with the defaults above. ``master`` is left to spark-submit when None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


CELLS_PER_TASK = 16_000_000  # values that a task sorts; some 200 MB
BROADCAST_ROWS = 200_000  # a checked bound
_STORED = weakref.WeakSet()  # tables that ``materialize`` has read back


def _width(kind) -> int:
    return sum(_width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 1


def tasks_for(df: DataFrame, total: int) -> int:
    """Tasks that ``total`` rows of the width of ``df`` need, so that each sorts at most CELLS_PER_TASK values."""
    return math.ceil(total * _width(df.schema) / CELLS_PER_TASK)


def spread(df: DataFrame, total: int, *on) -> DataFrame:
    """``df`` dealt by the columns ``on``, in a fixed number of partitions where ``total`` rows of its width need more of
    them than there are cores; adaptive execution would merge the session's partitions by their compressed size."""
    parts = tasks_for(df, total)
    return df.repartition(parts, *on) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*on)


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="labspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/labspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once below the shared folder and reads it back.

    Later steps start from the stored table: it is computed once however often they use it, a lost
    executor costs no recomputation of what came before, and plans stay small.
    """
    if stored(df):
        return df
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    _STORED.add(kept)
    return kept


def stored(df: DataFrame) -> bool:
    """Whether ``materialize`` has read back ``df``."""
    return df in _STORED


def few(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` for a join with a table of any size: stored and counted, and broadcast if it has at most ``most`` rows.

    Without the hint the other side is dealt by the join's keys first. Where these have few values, whole groups go to
    single tasks, and adaptive execution then refuses the broadcast because most partitions are empty."""
    kept = materialize(df, name)
    return F.broadcast(kept) if kept.count() <= most else kept
