"""Connected components by alternating star contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import table


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with ``u > v`` -> ``(node, root)``: each node that has an edge to a smaller
    one of its component, with the component's smallest node (the root itself is not listed).

    Every round links each node's larger neighbours, then its smaller ones, to the smallest
    node it knows; rounds are written tables, so a lost executor costs one round at most.
    A node's neighbours are only grouped by a partially aggregated minimum and a join."""
    edges = table(edges.distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = table(root.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
