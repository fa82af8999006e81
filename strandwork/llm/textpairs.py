"""Pairs of rows: classes of equal content, blocks of hot groups, and the expansion of class pairs to row pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Class pairs whose copies make at most this many row pairs are expanded; larger ones are given through the smallest ids.
FULL = 4096
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def self_pairs(rows: DataFrame, key: str, node: str, carried: list[str], block: int = 512) -> DataFrame:
    """All pairs of rows with equal ``key`` and node_l < node_r, with the carried columns of both sides.

    A key with more than ``block`` rows is cut into blocks, and each pair of blocks is a join key of its own, so that
    no task holds a whole hot group."""
    size = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    sized = rows.join(size, key).withColumn("_nb", F.ceil(F.col("_n") / block).cast("int"))
    own = F.pmod(F.xxhash64(node), F.col("_nb")).cast("int")
    sized = sized.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    cut = sized.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    side = lambda s: cut.select(key, "_lo", "_hi", F.col("_own").alias(f"_own{s}"), *[F.col(c).alias(f"{c}{s}") for c in [node, *carried]])
    both = side("_l").join(side("_r"), [key, "_lo", "_hi"])
    once = (F.col("_lo") == F.col("_hi")) | (F.col("_own_l") != F.col("_own_r"))
    return both.where(once & (F.col(f"{node}_l") < F.col(f"{node}_r"))).drop("_lo", "_hi", "_own_l", "_own_r")


def expand_pairs(pairs: DataFrame, members: DataFrame, within: bool = True, full: int = FULL) -> DataFrame:
    """(left_id, right_id), left < right, of rows behind class pairs (l, r), and of copies within a class.

    members: (node, id), distinct. A class pair is expanded to all its row pairs if these are at most ``full``; otherwise each copy is paired with
    the smallest id of the other class, and copies within a large class with its smallest id: links between
    different contents and the membership are whole, without a quadratic number of rows."""
    size = members.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    m = members.join(size, "node").select("node", "id", "n", "least")
    ends = pairs.select("l", "r").distinct()
    links = ends.join(size.select(F.col("node").alias("l"), F.col("n").alias("nl"), F.col("least").alias("ll")), "l")
    links = links.join(size.select(F.col("node").alias("r"), F.col("n").alias("nr"), F.col("least").alias("lr")), "r")
    links = links.withColumn("all", F.col("nl") * F.col("nr") <= full)
    left = m.select(F.col("node").alias("l"), F.col("id").alias("a"))
    right = m.select(F.col("node").alias("r"), F.col("id").alias("b"))
    some = links.where("all").join(left, "l").join(right, "r").select("a", "b")
    star = links.where("NOT all")
    some = some.unionByName(star.join(left, "l").select("a", F.col("lr").alias("b"))).unionByName(star.join(right, "r").select(F.col("ll").alias("a"), "b"))
    if within:
        copies = m.where("n > 1")
        small = copies.where(F.col("n") * F.col("n") <= full)
        other = small.select("node", F.col("id").alias("b"))
        some = some.unionByName(small.select("node", F.col("id").alias("a")).join(other, "node").where("a < b").select("a", "b"))
        some = some.unionByName(copies.where((F.col("n") * F.col("n") > full) & (F.col("id") != F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b")))
    return some.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).where("left_id <> right_id").distinct()


def class_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, copies, links) of every member (node, id): the smallest id of its class, its size, and how many other classes it is paired with."""
    size = members.groupBy("node").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    both = pairs.select(F.col("l").alias("node"), F.col("r").alias("other")).unionByName(pairs.select(F.col("r").alias("node"), F.col("l").alias("other")))
    links = both.distinct().groupBy("node").agg(F.count("*").alias("links"))
    named = size.join(links, "node", "left")
    return members.join(named, "node").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
