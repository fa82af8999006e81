"""p6: clusters of mutually similar vectors by grid density clustering.

Quantise: each vector is routed to its ``probes`` nearest codewords of a coarse codebook, the cells of the grid. Cells come by in order; one
with more than ``V.CELL`` vectors is joined in pairs of blocks instead. Within a cell the exact links (cosine >= threshold) divide the vectors into grid
cells proper: sets of two or more vectors that are linked there, the dense cells; what is linked to nothing drops out. The rest is SQL: dense cells are
counted, cells that share a vector are adjacent, and minimum labels move over the adjacent cells to convergence.
Report: size of each cluster and the members with the most links in their densest cell.

Defined results: unusable vectors and null keys give no row; duplicate rows count once; equal vectors are linked
(cosine 1) even when alone in a cell; fewer than ``least`` members is no cluster; an empty table gives no rows;
extra columns are ignored. Links are exact to a few 1e-6 of cosine within a cell; a link is lost only if its two ends
share none of their cells *and* no chain of other links joins them (README: measured agreement)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from strandwork.llm import vecspace as V
from strandwork.operators.components import connected_components
from strandwork.session import materialize, table

THRESHOLD, PROBES, LEAST = 0.72, 7, 3
_ROUTED = "space string, cell long, vh long, blob binary, key string"
#: kind 0: vector a lies in dense cell b with ``weight`` links; 1: row ``key`` has vector a; 2: vector a of a large cell b, with its space (key), blob and block (weight).
_LINKED = "kind int, a long, b long, key string, weight int, blob binary"


def _router(codebooks, probes):
    def route(batches):
        for space, hashes, blobs, x, members in V.parsed_batches(batches):
            words = codebooks.value.get(space)
            if len(hashes):
                if words is None:  # a space too small to be in the sample: one cell
                    cells = np.zeros((len(x), 1), dtype=np.int32)
                else:
                    cells = V.nearest(x, words, probes)
                r = cells.shape[1]
                yield pd.DataFrame({"space": space, "cell": cells.ravel().astype(np.int64), "vh": np.repeat(hashes, r), "blob": np.repeat(np.array(blobs, dtype=object), r), "key": None})
            if members:
                h, _, keys = zip(*members)
                salt = -1 - (np.array(h, dtype=np.int64) * 31 + np.arange(len(h))) % 199
                yield pd.DataFrame({"space": "", "cell": salt, "vh": np.array(h, dtype=np.int64), "blob": None, "key": list(keys)})

    return route


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: minimum labels move along the pairs to convergence. A label is its own label."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        pairs = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]]), axis=1)
        a, b = pairs[1], pairs[0]
        np.minimum.at(label, a, b)
        while (label[label] != label).any():
            label = label[label]


def local_groups(x: np.ndarray, threshold: float, block: int = 1024):
    """(label per row, links per row): labels are the smallest row index joined by dot products >= threshold; the links of one block are held at a time."""
    n = len(x)
    label, degree = np.arange(n), np.zeros(n, dtype=np.int64)
    for i in range(0, n, block):
        a, b = np.nonzero(x[i : i + block] @ x[i:].T >= threshold)
        keep = b > a
        a, b = a[keep] + i, b[keep] + i
        degree += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        label = _merge(label, a, b)
    return label, degree


def _dense(threshold, cap):
    def work(space, cell, pdf):
        h = pdf["vh"].to_numpy()
        if len(h) < 2:
            return frame(0, h[:0], h[:0], None, 0, None)
        label, degree = local_groups(V.unpack(pdf["blob"], int(space.partition("\x1f")[0])), threshold)
        joined = degree > 0
        names = V.cell_hashes(space, cell, h[label[joined]])
        return frame(0, h[joined], names, None, degree[joined].astype(np.int32), None)

    def members(pdf):
        return frame(1, pdf["vh"].to_numpy(), None, pdf["key"].to_numpy(), 0, None)

    def emit(pdf, block):
        return frame(2, pdf["vh"].to_numpy(), pdf["cell"].to_numpy(), pdf["space"].to_numpy(), block, pdf["blob"].to_numpy())

    def frame(kind, a, b, key, weight, blob):
        n = len(a)
        return pd.DataFrame({"kind": np.full(n, kind, dtype=np.int32), "a": a, "b": b, "key": key, "weight": weight, "blob": blob}, index=range(n))

    return lambda frames: V.stream_cells(frames, work, emit, members, cap)


def vector_clusters(vectors: DataFrame, key: str = "chunk_id", threshold: float = THRESHOLD, probes: int = PROBES, least: int = LEAST, cap: int = V.CELL) -> DataFrame:
    """(key, cluster_id, size, weight): members of clusters of at least ``least``; cluster_id is the smallest key (long).

    weight is the number of links a member has in its densest cell: the most typical members have the most."""
    rows = V.vector_rows(vectors, F.col(key), 0)
    n = vectors.count()
    sample = V.fit_sample(rows, n, V.sample_size(n))
    total = max(1, sum(map(len, sample.values())))
    books = {s: V.spread(x, V.cell_count(n * len(x) // total)) for s, x in sample.items()}
    codebooks = rows.sparkSession.sparkContext.broadcast(books)
    routed = rows.mapInPandas(_router(codebooks, probes), _ROUTED)
    first = materialize(V.by_cell(routed).mapInPandas(_dense(threshold, cap), _LINKED), "links")
    large = first.where("kind = 2").select(F.col("key").alias("space"), F.col("b").alias("cell"), F.col("a").alias("vh"), "blob", F.col("weight").alias("block"))
    again = V.block_pairs(large, ["blob"]).withColumn("key", F.lit(None).cast("string")).mapInPandas(_dense(threshold, None), _LINKED)
    inside = first.where("kind = 0").unionByName(again).select(F.col("a").alias("node"), F.col("b").alias("cell"), "weight")
    member = inside.groupBy("node").agg(F.min("cell").alias("cell"), F.max("weight").alias("weight"))
    adjacent = inside.select("node", F.col("cell").alias("other")).join(member.select("node", "cell"), "node").where("cell <> other").select("cell", "other").distinct()
    labels = connected_components(adjacent, "cell", "other").withColumnRenamed("node", "cell")
    label = member.join(labels, "cell", "left").select("node", F.coalesce("label", "cell").alias("label"), "weight")
    members = first.where("kind = 1").select(F.col("a").alias("node"), F.col("key").cast("long").alias("id")).distinct()
    group = members.join(label, "node", "left").select("id", F.coalesce("label", "node").alias("label"), F.coalesce("weight", F.lit(0)).alias("weight"))
    size = group.groupBy("label").agg(F.countDistinct("id").alias("size"), F.min("id").alias("cluster_id")).where(F.col("size") >= least)
    out = group.join(size, "label").groupBy(F.col("id").alias(key)).agg(F.min("cluster_id").alias("cluster_id"), F.max("size").alias("size"), F.max("weight").alias("weight"))
    return out


def describe_clusters(clusters: DataFrame, texts: DataFrame, key: str = "chunk_id", examples: int = 3) -> DataFrame:
    """(cluster_id, size, typical): the texts of the ``examples`` densest members (ties: smaller key) of each cluster; a null text stays null."""
    ranked = clusters.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("weight"), key))).where(F.col("rank") <= examples)
    text = texts.groupBy(key).agg(F.max("text").alias("text"))
    return (
        ranked.join(text, key, "left")
        .groupBy("cluster_id", "size")
        .agg(F.sort_array(F.collect_list(F.struct("rank", key, "text"))).alias("typical"))
    )


def p6_found(spark, sf_dir: str) -> DataFrame:
    return vector_clusters(table(spark, sf_dir, "chunk_embeddings")).select("chunk_id", "cluster_id")


def p6_clusters(spark, sf_dir: str) -> DataFrame:
    out = describe_clusters(vector_clusters(table(spark, sf_dir, "chunk_embeddings")), table(spark, sf_dir, "chunks"))
    return out.select("cluster_id", "size", F.to_json("typical").alias("typical"))
