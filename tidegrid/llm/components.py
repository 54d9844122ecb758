"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import discard, materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node but the least of a component has one edge, and that leads to the least."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return not nodes.filter((F.col("up") > 1) | (F.col("up") == 1) & (F.col("low") == 1)).agg(F.count("*")).first()[0]


def _written(df: DataFrame) -> DataFrame:
    """A minimum per node that is read back has an exchange of its own, without which AQE cannot split its join's hot nodes."""
    return materialize(df, "least")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its least node) for every node with an edge to another.

    Each round is two grouped minima, combined before their exchange, and two joins on the node whose hot
    keys AQE can split; edges never exceed the input's number. A round's edges are written to shared
    storage. Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    e = materialize(e, "edges")
    while not _stars(e):
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _written(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = sym.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = _written(large)
        low = _written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        small = small.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = materialize(small.distinct(), "edges")
        discard(e)
        e = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
