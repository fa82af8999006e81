"""p2: near-duplicate records with small edits: an exact Jaccard self-join in regions.

Records are sets of 3-token sequences; distance is 1 - |common| / |all|; pairs at or over ``SIMILARITY`` are wanted.

Regions: Voronoi regions of whole records were measured (README): a window of twice the radius 0.4 excludes a record from a region
only if it lies within 0.2 of its own pivot, so that nearly every record is copied to nearly every region. The pivots are therefore single
sequences, ordered from rare to frequent by counts over the whole corpus: a record lies in the region of its rarest
pivot, and its window, the set bound in place of the triangle inequality, replicates it to the regions of its next
pivots: two similar records share at least ``least_met`` of the pivots in both prefixes (see ``window``). Regions stream by in order of their
pivot; one with more than ``HOT`` records is counted out exactly and joined again in pairs of blocks, so that no task
holds a whole region. A pair's common regions are counted; pairs under the bound are out.
The remaining pairs are compared set by set, so the result is exact.

Defined results: null texts, texts with fewer than ``LEAST`` tokens and null ids give no row; equal sets are one class, equal
texts of a class one unit: all pairs of units are given, and only equal texts are copies in the sense of ``expand_pairs``; repeated rows count once; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandwork.llm.p9_spans import pair_texts
from strandwork.llm.textpairs import class_links, expand_pairs, mix, self_pairs
from strandwork.operators.components import connected_components
from strandwork.session import materialize, table

SIMILARITY, WORDS, LEAST = 0.6, 3, 40
#: Cells of the counts that order the pivots: a byte each when broadcast, whatever the input. Any order gives the exact result.
SKETCH, SLICE = 1 << 22, 1 << 16
BLOCK = 512
#: A region with more records is joined in pairs of blocks of this size.
HOT = 2000
_TOKEN = re.compile(r"[a-z0-9_]+").findall
_VOCABULARY: dict[str, int] = {}


def token_ids(text: str) -> np.ndarray:
    words = _TOKEN(text.lower())
    if len(_VOCABULARY) > 500_000:
        _VOCABULARY.clear()
    known = _VOCABULARY
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS, least: int = LEAST, salt: int = 0) -> np.ndarray | None:
    """Sorted distinct hashes of the token sequences, or None for too short a text."""
    if text is None:
        return None
    t = token_ids(text)
    if len(t) < max(least, words):
        return None
    n = len(t) - words + 1
    h = np.full(n, np.uint64(salt))
    for i in range(words):
        h = mix(h + t[i : i + n])
    return np.unique(h)


def set_hash(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def text_hash(text: str, kind: int) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass"), seed=kind), "big", signed=True)


def window(n: np.ndarray | int, similarity: float):
    """(prefix, suffix): sizes of the part of a record of n elements that is sent to regions, and of the rest.

    Two records at or over the similarity have at least need(n) = ceil(similarity * n) elements in common. The suffix is a little
    shorter than that, so that similar records meet more than once."""
    need = np.ceil(np.asarray(n) * similarity - 1e-9).astype(np.int64)
    suffix = need - np.maximum(1, need // 16)
    return n - suffix, suffix


def least_met(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """How many elements two records of sizes a and b at or over the similarity share, at least, in both their prefixes.

    They have common = ceil(similarity / (1 + similarity) * (a + b)) elements in common, of which at most suffix(a) are in the first's suffix; so the first common -
    suffix(a) in the order lie in its prefix, and likewise for b. The fewer of these are in both."""
    common = np.ceil((a + b) * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)
    return np.maximum(1, common - np.maximum(window(a, similarity)[1], window(b, similarity)[1]))


def _sketch(salts):
    """Counts of the cells of one scan partition, as compressed slices (slice, counts)."""

    def run(batches):
        total = np.zeros(SKETCH, dtype=np.int64)
        held: list[np.ndarray] = []
        amount = 0

        def count():
            np.add.at(total, np.concatenate(held), 1) if amount < SKETCH // 8 else total.__iadd__(np.bincount(np.concatenate(held), minlength=SKETCH))

        for batch in batches:
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                s = shingles(text, salt=salts[kind])
                if s is not None:
                    held.append((s % np.uint64(SKETCH)).astype(np.int64))
                    amount += len(s)
            if amount >= SKETCH // 4:
                count()
                held, amount = [], 0
        if held:
            count()
        yield from _slices({i: total[i * SLICE : (i + 1) * SLICE] for i in range(SKETCH // SLICE) if total[i * SLICE : (i + 1) * SLICE].any()})

    return run


def _slices(totals: dict[int, np.ndarray]):
    blobs = [zlib.compress(v.astype("<i8").tobytes(), 1) for v in totals.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])


def _sum_slices(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            v = np.frombuffer(zlib.decompress(blob), dtype="<i8")
            totals[i] = totals[i] + v if i in totals else v
    yield from _slices(totals)


def pivot_order(rows: DataFrame, salts: dict[int, int]) -> np.ndarray:
    """A byte per cell that grows with the logarithm of its count over all records; summed in two levels, streaming."""
    kind = "slice int, counts binary"
    first = rows.mapInArrow(_sketch(salts), kind).withColumn("salt", F.spark_partition_id() % 64)
    first = first.repartition("slice", "salt").select("slice", "counts").mapInArrow(_sum_slices, kind)
    weight = np.zeros(SKETCH, dtype=np.int64)
    for r in first.repartition("slice").mapInArrow(_sum_slices, kind).toLocalIterator():
        weight[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype="<i8")
    return np.minimum(255, np.round(8 * np.log2(1.0 + weight))).astype(np.uint8)


def _regions(salts, counts, similarity):
    def run(batches):
        weight = counts.value
        seen: set[int] = set()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], []]
            ids, nodes, kinds, units = [], [], [], []
            for kind, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, salt=salts[kind])
                if s is None:
                    continue
                node = set_hash(s)
                ids.append(key)
                nodes.append(node)
                kinds.append(kind)
                units.append(text_hash(text, kind))
                if node in seen:
                    continue
                seen.add(node)
                w = weight[(s % np.uint64(SKETCH)).astype(np.int64)]
                prefix, _ = window(len(s), similarity)
                first = np.argsort(w, kind="stable")[: int(prefix)]  # s is sorted, so ties go to the smaller hash
                cols[0].append(s[first].view(np.int64))
                cols[1].append(np.full(len(first), node, dtype=np.int64))
                cols[2].append(np.full(len(first), len(s), dtype=np.int32))
            if ids:
                none = np.zeros(len(ids), dtype=np.int32)
                a = [np.concatenate([np.array(units, dtype=np.int64), *cols[0]]), np.concatenate([np.array(nodes, dtype=np.int64), *cols[1]]), np.concatenate([none, *cols[2]])]
                key = pa.array(ids + [None] * (len(a[0]) - len(ids)), pa.int64())
                kind = pa.array(np.concatenate([np.array(kinds, dtype=np.int8), np.full(len(a[0]) - len(ids), -1, dtype=np.int8)]))
                side = pa.array(np.zeros(len(a[0]), dtype=np.int8))
                yield pa.RecordBatch.from_arrays([kind, key, *map(pa.array, a), side], names=["kind", "id", "pivot", "node", "n", "side"])

    return run


def _gather(similarity, hot=None, chunk=400_000):
    """Streams (kind, id, pivot, node, n, side) sorted by pivot and node: members (pivot: their unit) pass through, regions give counted pairs.

    A region with more than ``hot`` records comes out again as rows of kind -2 (a: pivot, b: node, n, bound: its block)."""

    names = ["kind", "a", "b", "n", "bound", "unit"]

    def run(batches):
        held: list[list[np.ndarray]] = [[], [], [], []]
        amount, spilled = 0, [None, None, 0]  # pivot and last node of a region that is being counted out, records so far
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            own = kind >= 0
            if own.any():
                some = batch.filter(pa.array(own))
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("kind", "node", "id", "n", "n", "pivot")], names=names)
            rest = batch.filter(pa.array(~own)) if own.any() else batch
            for h, c in zip(held, ("pivot", "node", "n", "side")):
                h.append(rest.column(c).to_numpy())
            amount += rest.num_rows
            if amount > chunk:
                kept = yield from regions([np.concatenate(h) for h in held], spilled, False)
                held, amount = [[c] for c in kept], len(kept[0])
        if amount:
            yield from regions([np.concatenate(h) for h in held], spilled, True)

    def regions(columns, spilled, last):
        """Deals with all whole regions; gives back the rows of one that may go on."""
        p, x, n, side = columns
        new = np.r_[True, (p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (side[1:] != side[:-1])]  # a class sent by several scan partitions
        p, x, n, side = p[new], x[new], n[new], side[new]
        start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        ends = np.r_[start[1:], len(p)]
        stop = len(start) if last else len(start) - 1
        big = []
        if hot is not None:
            for i in range(len(start)):
                going = p[start[i]] == spilled[0]
                if going or ends[i] - start[i] > hot:
                    big.append(i)
                    yield counted_out(p, x, n, slice(start[i], ends[i]), spilled if going else None, spilled)
        small = np.setdiff1d(np.arange(stop), big)
        yield from counted(x, n, side, start[small], (ends - start)[small])
        rest = slice(len(p), len(p)) if last or len(start) - 1 in big else slice(start[-1], len(p))
        return [c[rest] for c in (p, x, n, side)]

    def counted_out(p, x, n, rows, before, spilled):
        a, b, c = p[rows], x[rows], n[rows]
        seen = 0
        if before is not None:
            seen = before[2]
            if b[0] == before[1]:
                a, b, c = a[1:], b[1:], c[1:]
        spilled[:] = [p[rows.start], x[rows.stop - 1], seen + len(b)]
        block = ((seen + np.arange(len(b))) // hot).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), -2, dtype=np.int8)), pa.array(a), pa.array(b), pa.array(c), pa.array(block), pa.nulls(len(b), pa.int64())], names=names)

    def counted(x, n, side, start, size, most=4_000_000):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        amount = 0
        for width in np.unique(size[size > 1]):
            rows = start[size == width]
            if width <= BLOCK:
                i, j = np.triu_indices(width, 1)
                step = max(1, most // len(i))
                tiles = ((np.add.outer(rows[s : s + step], i).ravel(), np.add.outer(rows[s : s + step], j).ravel()) for s in range(0, len(rows), step))
            else:
                tiles = (tile for r in rows for tile in blocks(r, int(width)))
            for a, b in tiles:
                low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                fit = (low >= similarity * high - 1e-9) & ((side[a] == 0) | (side[a] != side[b]))
                a, b = a[fit], b[fit]
                held.append((a, b))
                amount += len(a)
                if amount > most:
                    yield fold(x, n, held)
                    held, amount = [], 0
        if amount:
            yield fold(x, n, held)

    def blocks(r, width, side=1024):
        for s in range(0, width, side):
            for t in range(s, width, side):
                a, b = np.meshgrid(np.arange(s, min(s + side, width)), np.arange(t, min(t + side, width)), indexing="ij")
                keep = a < b
                yield r + a[keep], r + b[keep]

    def fold(x, n, held):
        a, b = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        l, r = np.minimum(x[a], x[b]), np.maximum(x[a], x[b])
        least = least_met(n[a].astype(np.int64), n[b].astype(np.int64), similarity)
        order = np.lexsort((r, l))
        l, r, least = l[order], r[order], least[order]
        new = np.flatnonzero(np.r_[True, (l[1:] != l[:-1]) | (r[1:] != r[:-1])])
        count = np.diff(np.r_[new, len(l)])
        columns = (np.full(len(new), -1, dtype=np.int8), l[new], r[new], count.astype(np.int32), least[new].astype(np.int32))
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.nulls(len(new), pa.int64())], names=names)

    return run


_SENT = "kind byte, id long, pivot long, node long, n int, side byte"
_GATHERED = "kind byte, a long, b long, n int, bound int, unit long"


def hot_pairs(found: DataFrame, parts: int, similarity: float) -> DataFrame:
    """Counted pairs of the regions that were counted out: each record goes to all pairs of blocks that hold its own.

    Records on the same side (1 or 2) of a pair of different blocks meet elsewhere; side 0 meets everyone."""
    rows = found.where("kind = -2").select(F.col("a").alias("pivot"), F.col("b").alias("node"), "n", F.col("bound").alias("own"))
    blocks = rows.groupBy("pivot").agg((F.max("own") + 1).alias("blocks"))
    sent = rows.join(blocks, "pivot").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte")
    key = F.xxhash64("pivot", F.least("own", "other"), F.greatest("own", "other"))
    sent = sent.select(F.lit(-1).cast("byte").alias("kind"), F.lit(None).cast("long").alias("id"), key.alias("pivot"), "node", "n", side.alias("side"))
    return sent.repartition(parts, "pivot").sortWithinPartitions("pivot", "node", "side").mapInArrow(_gather(similarity), _GATHERED)


def _confirm(salts):
    """Of (node, kind, text) rows those whose text is of that class, should an id have several texts."""

    def run(batches):
        for batch in batches:
            keep = []
            for node, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, salt=salts[kind])
                keep.append(s is not None and set_hash(s) == node)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["node", "text"])

    return run


def _verify(similarity):
    def run(batches):
        cache: dict[int, np.ndarray | None] = {}
        for batch in batches:
            keep = []
            for l, r, lt, rt in zip(*(c.to_pylist() for c in batch.columns)):
                if len(cache) > 20_000:
                    cache.clear()
                for node, text in ((l, lt), (r, rt)):
                    if node not in cache:
                        cache[node] = shingles(text)
                x, y = cache[l], cache[r]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["l", "r"])

    return run


def near_pairs(texts: DataFrame, similarity: float = SIMILARITY, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs (l, r) of classes, members (kind, node, id, unit)) of a table (kind tinyint, id long, text string)."""
    spark = texts.sparkSession
    rows = texts.where("id IS NOT NULL AND text IS NOT NULL").select("kind", "id", "text")
    salts = {k: 0x51ED * (k + 1) for k in range(8)}
    counts = spark.sparkContext.broadcast(pivot_order(rows, salts))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(_regions(salts, counts, similarity), _SENT)
    region = F.when(F.col("kind") >= 0, F.col("id")).otherwise(F.col("pivot"))
    sent = sent.repartition(parts, F.xxhash64(region)).sortWithinPartitions("pivot", "node")
    found = materialize(sent.mapInArrow(_gather(similarity, hot), _GATHERED), "regions")
    met = found.where("kind = -1").select("a", "b", "n", "bound").unionByName(hot_pairs(found, parts, similarity).select("a", "b", "n", "bound"))
    pairs = met.groupBy(F.col("a").alias("l"), F.col("b").alias("r")).agg(F.sum("n").alias("met"), F.max("bound").alias("bound"))
    candidates = materialize(pairs.where("met >= bound").select("l", "r"), "candidates")
    members = found.where("kind >= 0").select("kind", F.col("a").alias("node"), F.col("b").alias("id"), "unit").distinct()
    both = pair_texts(candidates, members.select("kind", "node", "id"), rows, _confirm(salts))
    return both.mapInArrow(_verify(similarity), "l long, r long"), members


def row_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(left_id, right_id) structs (kind, id) of the rows behind class pairs and classes, between all different texts of a class too."""
    units = members.select("node", "unit").distinct()
    side = lambda c: units.select(F.col("node").alias(c), F.col("unit").alias(f"u{c}"))
    across = pairs.join(side("l"), "l").join(side("r"), "r").select(F.col("ul").alias("l"), F.col("ur").alias("r"))
    within = self_pairs(units, "node", "unit", []).select(F.col("unit_l").alias("l"), F.col("unit_r").alias("r"))
    return expand_pairs(across.unionByName(within), members.select(F.col("unit").alias("node"), F.struct("kind", "id").alias("id")).distinct())


def near_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, id, group_id, class_id, copies, links): one row per record: the smallest id of those joined to it directly or through others, the
    smallest id with an equal set, the number of records with it, and the number of other sets similar to it. A record alone is its own group."""
    rows = members.select("node", F.struct("kind", "id").alias("id")).distinct()
    label = connected_components(pairs, "l", "r")
    named = class_links(pairs, rows).join(rows, "id").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id.id").alias("group_id"))
    return named.join(least, "label").select("id.kind", "id.id", "group_id", F.col("class_id.id").alias("class_id"), "copies", "links")


def _texts(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit(0).cast("byte").alias("kind"), F.col("doc_id").alias("id"), F.col("raw_text").alias("text"))
    return d.unionByName(table(spark, sf_dir, "chunks").select(F.lit(1).cast("byte").alias("kind"), F.col("chunk_id").alias("id"), "text"))


def _kind(number):
    return F.when(number == 0, "document").otherwise("chunk").alias("kind")


def p2_found(spark, sf_dir: str) -> DataFrame:
    pairs, members = near_pairs(_texts(spark, sf_dir))
    found = row_pairs(materialize(pairs, "pairs"), members)
    return found.select(_kind(F.col("left_id.kind")), F.col("left_id.id").alias("left_id"), F.col("right_id.id").alias("right_id"))


def p2_groups(spark, sf_dir: str) -> DataFrame:
    pairs, members = near_pairs(_texts(spark, sf_dir))
    return near_groups(materialize(pairs, "pairs"), members).select(_kind(F.col("kind")), "id", "group_id", "class_id", "copies", "links")
