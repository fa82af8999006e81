"""Connected components by alternating star contraction, all in joins and min-aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwork.session import drop_materialized, materialize


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = _minimum(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.withColumnRenamed("m", "v"))


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node of its component.

    Nulls and self-loops are ignored; no edges gives no rows. Minimum labels move along the edges until a
    round changes nothing. A hub is never gathered: its minimum is a map-side-combined aggregate and its edges
    are rewritten by a join that adaptive execution may split. Each round is a written table, so lineage stays
    short; the number of rounds grows with the logarithm of the longest path."""
    pair = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pair = pair.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
    now = materialize(pair.distinct(), "edges")
    while True:
        new = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges")
        sign = [t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for t in (now, new)]
        drop_materialized(now)
        now = new
        if sign[0] == sign[1]:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
