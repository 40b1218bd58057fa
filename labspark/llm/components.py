"""Connected components of an edge table, by alternating star contraction.

Each round replaces a node's edges by edges to the smallest id around it: first for its larger, then for
its smaller neighbours. Edges never grow in number, and rounds grow with the logarithm of a chain's
length. Every round is stored, so a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labspark.session import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a > b). Large star: a node's larger neighbours move to its least neighbour; small star: its smaller ones do."""
    directed = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    if larger:
        directed = directed.unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    least = directed.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
    moved = directed.join(least, "n")
    moved = moved.filter(F.col("m") > F.col("n")).select("m", "least") if larger else moved.select("m", "least").unionByName(least.select(F.col("n").alias("m"), "least"))
    return moved.filter(F.col("m") != F.col("least")).select(F.greatest("m", "least").alias("a"), F.least("m", "least").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root`` (the component's least node) for every node of ``edges`` (two long columns a, b)."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen = mark(now)
    while seen[0]:
        now = materialize(_star(_star(now, True), False), name)
        got = mark(now)
        if got == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
