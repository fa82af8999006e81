"""p8: fill containers of fixed capacity with documents, by conflict-constrained best fit.

Sizes are tokens of a public vocabulary. Items are dealt to groups of about ``GROUP`` by a hash of their id (no
source or copy group can overload one), and each group is packed largest first. Open containers are kept in order of
residual capacity; each carries a bitmap of the sources and of the duplicate clusters (equal texts) it holds. The
successor search starts at the smallest residual that fits and goes on to the tightest container that holds
neither the item's source nor its cluster. A conflict alone never opens a container: if every fitting one
conflicts, the tightest of them is taken and the item is marked. Then the containers left with much room are packed again across groups.

Defined results: null and empty texts give no row; a text over the capacity is cut into full containers and a last piece
that is packed as an item; ties go to the smaller id; null ids and sources are allowed (a null source conflicts with
none); repeated rows are items of their own; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.llm import bpe
from strandwork.llm.p7_tokens import shared_vocabulary
from strandwork.session import materialize, table

CAPACITY, GROUP, SLACK = 2048, 4000, 4
_ITEM = "key long, piece int, tokens int, source_hash long, text_hash long"


def best_fit(sizes, sources, clusters, capacity: int) -> tuple[list[int], list[int], list[bool]]:
    """(container of each item, residual of each container, whether the item conflicts with one put there before); items in the given
    order; conflict value 0 conflicts with none."""
    bit: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []  # (residual, container), sorted
    held: list[int] = []
    residual: list[int] = []
    place, conflict = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        mask = 0
        for kind, value in ((0, source), (1, cluster)):
            if value:
                mask |= 1 << bit.setdefault((kind, value), len(bit))
        first = bisect_left(order, (size, -1))
        at = next((i for i in range(first, len(order)) if not held[order[i][1]] & mask), first)
        if at == len(order):
            at = first
        if at < len(order):
            room, c = order.pop(at)
        else:
            room, c = capacity, len(held)
            held.append(0)
            residual.append(capacity)
        conflict.append(bool(held[c] & mask))
        held[c] |= mask
        residual[c] = room - size
        if residual[c]:
            insort(order, (residual[c], c))
        place.append(c)
    return place, residual, conflict


def item_sizes(df: DataFrame, key: str, text: str, source: str, capacity: int, vocabulary: str) -> DataFrame:
    """One row per item: pieces of ``capacity`` tokens and a last piece for long texts, else the whole text."""
    ranks = shared_vocabulary(df.sparkSession, vocabulary)

    def run(batches):
        e = bpe.encoder(ranks.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                p = batch.slice(i, 2048)
                n = np.array([len(x) for x in e.encode_batch(p.column(1).to_pylist())], dtype=np.int64)
                pieces = np.maximum(1, -(-n // capacity))
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                tokens = np.where(piece < pieces[row] - 1, capacity, n[row] - (pieces[row] - 1) * capacity)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [p.column(0).take(take), pa.array(piece.astype(np.int32)), pa.array(tokens.astype(np.int32)), p.column(2).take(take), p.column(3).take(take)],
                    names=["key", "piece", "tokens", "source_hash", "text_hash"],
                )

    some = df.where(F.length(text) > 0).select(
        F.col(key).cast("long").alias("key"), text, F.coalesce(F.xxhash64(source) * F.col(source).isNotNull().cast("long"), F.lit(0)).alias("source_hash"), F.xxhash64(text).alias("text_hash")
    )
    return some.mapInArrow(run, _ITEM)


def _pack(capacity):
    def run(key, pdf):
        pdf = pdf.sort_values(["tokens", "key", "piece"], ascending=[False, True, True])
        place, residual, conflict = best_fit(pdf["tokens"].tolist(), pdf["source_hash"].tolist(), pdf["text_hash"].tolist(), capacity)
        room = np.array(residual, dtype=np.int32)
        return pd.DataFrame({
            "key": pdf["key"], "piece": pdf["piece"], "tokens": pdf["tokens"], "source_hash": pdf["source_hash"], "text_hash": pdf["text_hash"],
            "container": [f"{key[0]}-{c}" for c in place], "room": room[place], "conflict": conflict,
        })

    return run


def fill_containers(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(key, piece, tokens, container string, conflict): every item in one container, no container over the capacity; conflict: the item had to go
    where its source or its cluster already was."""
    groups = max(1, df.count() // GROUP)
    out = _ITEM + ", container string, room int, conflict boolean"
    spread = F.pmod(F.xxhash64("key", "piece"), F.lit(groups))
    items = item_sizes(df, key, text, source, capacity, vocabulary).withColumn("box", F.concat(F.lit("a"), spread.cast("string")))
    first = materialize(items.groupBy("box").applyInPandas(_pack(capacity), out), "packed")
    again = first.where(F.col("room") > capacity // SLACK).drop("container", "room", "conflict")
    again = again.withColumn("box", F.concat(F.lit("b"), F.pmod(F.xxhash64("key", "piece"), F.lit(1 + groups // 1000)).cast("string")))
    second = again.groupBy("box").applyInPandas(_pack(capacity), out)
    both = first.where(F.col("room") <= capacity // SLACK).unionByName(second)
    return both.select(F.col("key").alias(key), "piece", "tokens", "container", "conflict")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, the fewest containers that could hold the tokens, the share of the capacity that is filled, and items in conflict."""
    total = packed.agg(F.count("*").alias("items"), F.countDistinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.col("conflict").cast("int")), F.lit(0)).alias("conflicts"))
    fill = F.coalesce(F.try_divide(F.col("tokens"), F.col("containers") * capacity), F.lit(0.0))
    return total.select("items", "containers", F.ceil(F.col("tokens") / capacity).alias("fewest"), F.round(fill, 6).alias("fill"), "conflicts")


def p8_report(spark, sf_dir: str) -> DataFrame:
    return packing_report(materialize(fill_containers(table(spark, sf_dir, "documents")), "containers"))


def p8_containers(spark, sf_dir: str) -> DataFrame:
    return fill_containers(table(spark, sf_dir, "documents"))
