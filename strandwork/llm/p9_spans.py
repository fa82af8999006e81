"""p9: long spans shared between records, by collinear chaining of shared k-mer seeds.

Seeds: of every window of ``WINDOW`` consecutive k-mers (``K`` characters) the one with the smallest hash is kept, so any
common substring of K + WINDOW - 1 = 200 characters holds a k-mer kept in both texts. Seeds are joined on their
hash, once per pair of texts and seed. The matches of a pair are chained collinearly: a match extends the best chain before it in
both texts, at a cost for the gap, found through a Fenwick tree over positions in the second text; chains are taken off by falling score until
every match lies in one. Rows come from the chains alone: a run of neighbours of a chain on one diagonal without a hole is an exact span;
a chain without a long enough run is aligned, its anchors grown character by character in both texts. Aligned from end to end
a chain is a fuzzy passage (``fuzzy_passages``). In repetitive texts, where a seed's place in a run is arbitrary or the matches would be
quadratic, the two texts are compared whole instead: for exact spans by their hashes, for fuzzy passages by chains of all their maximal
matches of at least K characters, of which a run has one a diagonal.

Defined results: null texts and texts shorter than the limit give no row; texts equal to each other are one class (copies:
see ``expand_pairs`` and ``span_classes``); characters are code points; repeated rows and rows with a null id add nothing; an empty table
gives no rows; extra columns are ignored."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from strandwork.llm.textpairs import class_links, expand_pairs, mix, self_pairs
from strandwork.session import materialize, table

LIMIT, K = 200, 104
#: A seed that a text holds more often makes the text count as repetitive: it is compared whole.
REPEATS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_LOW = np.uint64((1 << 22) - 1)


def kmer_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k characters (uint64 code points), by prefix sums of a polynomial."""
    n = len(chars) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    down, up = np.full(len(chars), _BACK), np.full(n, _BASE)
    down[0] = up[0] = np.uint64(1)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars + _BASE) * np.cumprod(down), out=total[1:])
    return mix((total[k:] - total[:-k]) * np.cumprod(up))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def seeds(hashes: np.ndarray, window: int) -> tuple[np.ndarray, bool]:
    """(positions kept by winnowing, whether some were thinned): the smallest hash of each window, the last of equal ones.

    In repetitive text equal hashes follow each other; of those nearer than a window one is kept."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64), False
    at = np.arange(n, dtype=np.uint64)
    low = (hashes & ~_LOW) | (_LOW - (at & _LOW))
    width = 1
    w = min(window, n)
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (w - width)], low[w - width :]) if w > width else low
    starts = np.arange(len(low), dtype=np.int64)
    offset = ((_LOW - (low & _LOW)).astype(np.int64) - starts) & int(_LOW)
    kept = np.unique(starts + offset)
    own = hashes[kept]
    if len(np.unique(own)) == len(own):
        return kept, False
    last: dict[int, int] = {}
    out = []
    for p, h in zip(kept.tolist(), own.tolist()):
        if p - last.get(h, -window) >= window:
            out.append(p)
            last[h] = p
    return np.array(out, dtype=np.int64), len(out) < len(kept)


def chain_paths(a, b, k: int, sizes=None, look: int = 8) -> Iterator[list[int]]:
    """Collinear chains of matches (a[i], b[i]) of length k, or sizes[i]: each match is in one chain, the best chain comes first.

    score(j) = covered characters + best score of a chain that ends before j in both texts - gap cost. A Fenwick tree over
    ranks of the ends in b holds prefix maxima of score + (ends) / 64, so that the part of the gap cost linear in the distance is exact. The match at
    the least cost, of the last one on the same diagonal and those at the ``look`` ends before it in b, is tried as well; a chain that meets one already taken goes on with it."""
    n = len(a)
    size = np.full(n, k, np.int32) if sizes is None else np.asarray(sizes, np.int32)
    u, v = np.asarray(a, np.int32) + size, np.asarray(b, np.int32) + size
    order = np.lexsort((v, u))
    distinct, rank = np.unique(v[order], return_inverse=True)
    u, v, size, rank, at = (memoryview(np.ascontiguousarray(c, np.int32)) for c in (u[order], v[order], size[order], rank + 1, order))
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(distinct) + 1)
    score, before, beside = array("d", bytes(8 * n)), array("i", [-1]) * n, array("i", [-1]) * n
    last: dict[int, int] = {}
    latest = array("i", [-1]) * len(tree)
    put = 0
    for i in range(n):
        while u[put] < u[i]:  # only matches that end earlier in both texts
            r, value = rank[put], (score[put] + (u[put] + v[put]) / 64, put)
            while r < len(tree):
                if tree[r] < value:
                    tree[r] = value
                r += r & -r
            latest[rank[put]] = put
            put += 1
        r, best = rank[i] - 1, (float("-inf"), -1)
        while r:
            best = max(best, tree[r])
            r -= r & -r
        own, x, y = size[i], u[i], v[i]
        score[i], least = own, float("inf")
        for j in (last.get(x - y, -1), *latest[max(0, rank[i] - look) : rank[i]]):
            if j >= 0:
                p, q = x - u[j], y - v[j]
                step = min(p, q, own)
                cost = (p + q - 2 * step) / 64 + abs(p - q) / 16
                if cost < min(least, step):
                    least, beside[i] = cost, j
        last[x - y] = i
        for j in (best[1], beside[i]):
            if j >= 0:
                p, q = x - u[j], y - v[j]
                step = min(p, q, own)
                joined = score[j] + step - (p + q - 2 * step) / 64 - abs(p - q) / 16
                if joined > score[i]:
                    score[i], before[i] = joined, j
    free = bytearray(b"\1") * n
    for i in memoryview(np.argsort(-np.frombuffer(score), kind="stable")) if n else ():
        path = []
        while i >= 0 and free[i]:
            free[i] = 0
            path.append(at[i])
            j = before[i]
            i = j if j < 0 or free[j] else beside[i]
        if path:
            yield path[::-1]


def chains(a: list[int], b: list[int], k: int) -> list[list[int]]:
    return list(chain_paths(a, b, k))


def maximal_matches(left: np.ndarray, right: np.ndarray, k: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, length) of all common substrings of at least k characters that go on in neither direction.

    Each begins with a common k-mer whose characters before differ, so a run in both texts gives one match a diagonal and its
    quadratic number of common k-mers is never listed. Lengths come from names of blocks of 1, 2, 4, ... characters; ``block`` bounds the scratch space."""
    own, other = kmer_hashes(left, k), kmer_hashes(right, k)
    group = np.unique(np.concatenate([own, other]), return_inverse=True)[1].astype(np.int64) << 22
    edge = lambda chars, n, first: np.r_[first, chars.astype(np.int64)][:n]  # noqa: E731  # the character before; at the borders none that occurs
    ga, gb = group[: len(own)], group[len(own) :]
    a, b = ga + edge(left, len(own), (1 << 22) - 1), gb + edge(right, len(other), (1 << 22) - 2)
    by = np.argsort(b, kind="stable")
    b = b[by]
    low, high = np.searchsorted(b, ga), np.searchsorted(b, ga + (1 << 22))
    skip, go = np.searchsorted(b, a), np.searchsorted(b, a, "right")  # these have the same character before
    count = high - low - (go - skip)
    total = np.cumsum(count)
    names = [(mix(left + _BASE), mix(right + _BASE))]

    def same(p: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether 2^p characters from x and y on are equal."""
        if p == len(names):
            w = 1 << (p - 1)
            names.append(tuple(mix(h[:-w] * _BASE + h[w:]) for h in names[-1]))
        l, r = names[p]
        out = (x < len(l)) & (y < len(r))
        out[out] = l[x[out]] == r[y[out]]
        return out

    out = [np.empty((3, 0), np.int32)]
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + block, "right")))
        n = count[start:stop]
        x = np.repeat(np.arange(start, min(stop, len(a))), n)
        i = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + low[x]
        y = by[np.where(i < skip[x], i, i + (go - skip)[x])]
        length, p, live = np.full(len(x), k), 0, np.arange(len(x))
        while len(live := live[same(p, x[live] + k, y[live] + k)]):
            p += 1
        while p:
            p -= 1
            length += same(p, x + length, y + length).astype(np.int64) << p
        out.append(np.array([x, y, length], np.int32))
        start = stop
    return tuple(np.concatenate(out, axis=1))


def longest_run(anchors: list[tuple[int, int]], k: int) -> int:
    """Length of the longest exact span that the neighbours of a chain prove: one diagonal, no hole."""
    best, start = 0, 0
    for i, (x, y) in enumerate(anchors):
        if i and (x - y != anchors[i - 1][0] - anchors[i - 1][1] or x > anchors[i - 1][0] + k):
            start = i
        best = max(best, x + k - anchors[start][0])
    return best


def common_prefix(a: str, b: str) -> int:
    """Number of equal first characters, by doubling and bisection over slices."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, step = 0, 16
    while low + step <= most and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(most, low + step)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def grown(lt: str, rt: str, x: int, y: int, k: int, most: int) -> tuple[int, int]:
    """(characters before, characters behind) by which a match of length k goes on in both texts, at most ``most`` each."""
    back = common_prefix(lt[max(0, x - most) : x][::-1], rt[max(0, y - most) : y][::-1])
    return back, common_prefix(lt[x + k : x + k + most], rt[y + k : y + k + most])


def chain_proves(lt: str, rt: str, anchors: list[tuple[int, int]], k: int, limit: int) -> bool:
    """Whether the alignment of a chain holds an exact span of ``limit`` characters."""
    return any(sum(grown(lt, rt, x, y, k, limit)) + k >= limit for x, y in anchors)


def aligned_chain(lt: str, rt: str, anchors: list[tuple[int, int]], k: int, sizes: list[int] | None = None) -> tuple[int, int, int, int, int]:
    """(l_from, l_to, r_from, r_to, matched) of a chain grown at both ends, its gaps aligned from both sides.

    Matches with ``sizes`` are maximal: their chain grows no further."""
    (x0, y0), (x1, y1) = anchors[0], anchors[-1]
    back = 0 if sizes else common_prefix(lt[:x0][::-1], rt[:y0][::-1])
    ahead = 0 if sizes else common_prefix(lt[x1 + k :], rt[y1 + k :])
    sizes = sizes or [k] * len(anchors)
    matched, x, y = back + sizes[0] + ahead, x0 + sizes[0], y0 + sizes[0]
    for (u, v), k in zip(anchors[1:], sizes[1:]):
        if u >= x and v >= y:
            gap, other = lt[x:u], rt[y:v]
            head = common_prefix(gap, other)
            matched += k + head + common_prefix(gap[head:][::-1], other[head:][::-1])
        else:  # overlapping matches: only what is new counts
            matched += max(0, min(u + k - x, v + k - y))
        x, y = u + k, v + k
    return x0 - back, x + ahead, y0 - back, y + ahead, matched


def shares(left: np.ndarray, right: np.ndarray, limit: int) -> bool:
    """Whether two texts have a common substring of ``limit`` characters."""
    return len(np.intersect1d(kmer_hashes(left, limit), kmer_hashes(right, limit))) > 0


def _seeds(k, window):
    def run(batches):
        for batch in batches:
            nodes, hashes, places, thin = [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = kmer_hashes(code_points(text), k)
                at, thinned = seeds(h, window)
                nodes.append(np.full(len(at), node, dtype=np.int64))
                hashes.append(h[at].view(np.int64))
                places.append(at.astype(np.int32))
                thin.append(np.full(len(at), thinned))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, hashes, places, thin)], names=["node", "seed", "at", "thin"])

    return run


def _chains(k, limit, most=20_000):
    """The chains of each pair, and whether one holds a long enough exact span; a pair of repetitive texts, or with more than ``most`` matches, has none: compare them whole."""

    def run(batches):
        for batch in batches:
            out = defaultdict(list)

            def add(l, r, x, y, proven):
                for name, v in zip(("l", "r", "x", "y", "proven"), (l, r, x, y, proven)):
                    out[name].append(v)

            for l, r, thin, hits in zip(*(c.to_pylist() for c in batch.columns)):
                if thin or len(hits) > most:
                    add(l, r, None, None, False)
                    continue
                a, b = [h["x"] for h in hits], [h["y"] for h in hits]
                paths = chains(a, b, k)
                proven = any(longest_run([(a[i], b[i]) for i in p], k) >= limit for p in paths)
                add(l, r, [[a[i] for i in p] for p in paths], [[b[i] for i in p] for p in paths], proven)
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=_CHAIN)

    return run


_CHAIN = pa.schema([("l", pa.int64()), ("r", pa.int64()), ("x", pa.list_(pa.list_(pa.int32()))), ("y", pa.list_(pa.list_(pa.int32()))), ("proven", pa.bool_())])
_CHAIN_SQL = "l long, r long, x array<array<int>>, y array<array<int>>, proven boolean"


def _align(k, limit):
    def run(batches):
        for batch in batches:
            keep = []
            for lt, rt, x, y in zip(*(batch.column(c).to_pylist() for c in ("lt", "rt", "x", "y"))):
                if x is None:
                    keep.append(shares(code_points(lt), code_points(rt), limit))
                else:
                    keep.append(any(chain_proves(lt, rt, list(zip(*c)), k, limit) for c in zip(x, y)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["l", "r"])

    return run


_FUZZY = [("l", pa.int64()), ("r", pa.int64()), *((c, pa.int32()) for c in ("l_from", "l_to", "r_from", "r_to", "matched", "anchors"))]


def whole_chains(lt: str, rt: str, k: int, limit: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(l_from, l_to, r_from, r_to, matched, anchors) of the chains of all maximal matches of two texts, at least ``limit`` characters long in both."""
    x, y, size = maximal_matches(code_points(lt), code_points(rt), k)
    for path in chain_paths(x, y, k, size):
        i, j = path[0], path[-1]
        if min(x[j] + size[j] - x[i], y[j] + size[j] - y[i]) >= limit:
            yield *aligned_chain(lt, rt, list(zip(x[path].tolist(), y[path].tolist())), k, size[path].tolist()), len(path)


def _fuzzy(k, limit, most=1 << 16):
    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in rows], t) for i, (_, t) in enumerate(_FUZZY)], names=[n for n, _ in _FUZZY])

    def run(batches):
        for batch in batches:
            rows = []
            for l, r, x, y, lt, rt in zip(*(batch.column(c).to_pylist() for c in ("l", "r", "x", "y", "lt", "rt"))):
                if x is None:
                    for found in whole_chains(lt, rt, k, limit):
                        rows.append((l, r, *found))
                        if len(rows) == most:
                            yield made(rows)
                            rows = []
                    continue
                for u, v in zip(x, y):
                    found = aligned_chain(lt, rt, list(zip(u, v)), k)
                    if found[1] - found[0] >= limit and found[3] - found[2] >= limit:
                        rows.append((l, r, *found, len(u)))
            yield made(rows)

    return run


def text_classes(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(node, id, text) of every row whose text has at least ``least`` characters; equal texts are one node."""
    return df.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(F.xxhash64(text).alias("node"), F.col(key).alias("id"), F.col(text).alias("text"))


def pair_texts(pairs: DataFrame, members: DataFrame, texts: DataFrame, confirm=None) -> DataFrame:
    """The rows of ``pairs`` (l, r, ...) with one text of each class (lt, rt); only texts of these classes leave their join.

    members and texts share ``id`` and whatever of ``node`` and ``kind`` both have; ``confirm`` drops texts of other classes."""
    ends = pairs.select(F.col("l").alias("node")).union(pairs.select(F.col("r").alias("node"))).distinct()
    on = [c for c in ("node", "kind", "id") if c in members.columns and c in texts.columns]
    one = F.min(F.struct(*[c for c in members.columns if c != "node"])).alias("one")
    first = members.join(ends, "node").groupBy("node").agg(one).select("node", "one.*")
    some = texts.join(first, on)
    if confirm is not None:
        some = some.select("node", "kind", "text").mapInArrow(confirm, "node long, text string")
    some = materialize(some.select("node", "text").dropDuplicates(["node"]), "texts")
    lt, rt = (some.select(F.col("node").alias(c), F.col("text").alias(f"{c}t")) for c in ("l", "r"))
    return pairs.join(lt, "l").join(rt, "r").select(*pairs.columns, "lt", "rt")


def span_chains(df: DataFrame, key: str, text: str, limit: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts (node, id, text), members (node, id), chains (l, r, x, y, proven)) of all pairs of classes with a common seed."""
    texts = text_classes(df, key, text, limit)
    members = materialize(texts.select("node", "id").distinct(), "members")
    each = texts.select("node", "text").mapInArrow(_seeds(k, limit - k + 1), "node long, seed long, at int, thin boolean")
    placed = each.groupBy("seed", "node").agg(F.collect_set("at").alias("places"), F.max("thin").alias("thin"))
    often = F.size("places") > REPEATS
    first = F.when(often, F.slice("places", 1, 1)).otherwise(F.col("places"))
    kept = materialize(placed.select("seed", "node", F.explode(first).alias("at"), (F.col("thin") | often).alias("thin")), "seeds")
    hits = self_pairs(kept, "seed", "node", ["at", "thin"])
    match = F.struct(F.col("at_l").alias("x"), F.col("at_r").alias("y"))
    grouped = hits.groupBy(F.col("node_l").alias("l"), F.col("node_r").alias("r")).agg(F.max(F.col("thin_l") | F.col("thin_r")).alias("thin"), F.collect_list(match).alias("hits"))
    return texts, members, materialize(grouped.mapInArrow(_chains(k, limit), _CHAIN_SQL), "chains")


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(pairs (l, r) of classes with a common substring of ``limit`` characters, members (node, id))."""
    texts, members, linked = span_chains(df, key, text, limit, k)
    aligned = pair_texts(linked.where("NOT proven").drop("proven"), members, texts).mapInArrow(_align(k, limit), "l long, r long")
    return linked.where("proven").select("l", "r").unionByName(aligned), members


def fuzzy_passages(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = K) -> DataFrame:
    """(left_id, right_id, left_from, left_to, right_from, right_to, matched, anchors): aligned chains of at least ``limit`` characters in both
    texts, between the smallest ids of two classes of equal texts that differ (``span_classes`` gives the membership).

    ``matched`` counts the characters of the alignment that are equal, ``anchors`` its matches: of seeds, in repetitive texts maximal ones."""
    texts, members, linked = span_chains(df, key, text, limit, k)
    rows = pair_texts(linked.drop("proven"), members, texts)
    found = rows.mapInArrow(_fuzzy(k, limit), ", ".join(f"{n} {'long' if n in 'lr' else 'int'}" for n, _ in _FUZZY))
    two = members.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where("n < 3")
    two = two.groupBy("node").agg(F.min("id").alias("a"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("b"))
    side = lambda c: two.select(F.col("node").alias(c), F.col("a").alias(f"{c}1"), F.col("b").alias(f"{c}2"))
    found = found.join(side("l"), "l").join(side("r"), "r")
    same = F.col("l1") == F.col("r1")  # a record with several texts: the next id of one of the classes takes its place, the smaller one
    swap = same & F.col("l2").isNotNull() & (F.col("r2").isNull() | (F.col("l2") < F.col("r2")))
    found = found.withColumn("left", F.when(swap, F.col("l2")).otherwise(F.col("l1"))).withColumn("right", F.when(same & ~swap, F.col("r2")).otherwise(F.col("r1")))
    turned = F.col("left") > F.col("right")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    out = found.where("left <> right").select(
        pick("left", "right").alias("left_id"), pick("right", "left").alias("right_id"), pick("l_from", "r_from").alias("left_from"), pick("l_to", "r_to").alias("left_to"),
        pick("r_from", "l_from").alias("right_from"), pick("r_to", "l_to").alias("right_to"), "matched", "anchors",
    )
    return out.distinct()


def span_classes(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = K) -> DataFrame:
    """(key, class_id, copies, links): one row per record with a text of at least ``limit`` characters: the smallest id with an equal text, the number
    of records with it, and the number of other texts that share a span with it."""
    pairs, members = shared_spans(df, key, text, limit, k)
    return class_links(pairs, members).withColumnRenamed("id", key)


def maximal_spans(text: str, other: str, found: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(from, to) of the substrings of ``text`` that occur in ``other`` and lie in no longer one that does.

    ``found``: whether the ``limit`` characters from each position on occur in ``other``. With a fixed start the end, and with a fixed end the
    start, is the border of a monotone property, so both are found by bisection."""
    edges = np.flatnonzero(np.diff(np.r_[0, found.astype(np.int8), 0]))
    out = []
    for s, last in zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()):
        most = last + limit
        while True:
            low, high = (most if text[s:most] in other else s + limit), most - 1
            while low < high:
                mid = (low + high + 1) // 2
                if text[s:mid] in other:
                    low = mid
                else:
                    high = mid - 1
            out.append((s, low))
            if low == most:
                break
            end = low + 1
            low, high = s + 1, end - limit
            while low < high:
                mid = (low + high) // 2
                if text[mid:end] in other:
                    high = mid
                else:
                    low = mid + 1
            s = low
    return out


def _passages(limit):
    def run(batches):
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for l, r, lt, rt in zip(*(c.to_pylist() for c in batch.columns)):
                if len(cache) > 200:
                    cache.clear()
                for node, text in ((l, lt), (r, rt)):
                    if node not in cache:
                        cache[node] = kmer_hashes(code_points(text), limit)
                for node, text, own, other, grams in ((l, lt, cache[l], rt, cache[r]), (r, rt, cache[r], lt, cache[l])):
                    out += [(node, a, b) for a, b in maximal_spans(text, other, np.isin(own, grams), limit)]
            node, a, b = (np.array(out, dtype=np.int64).reshape(-1, 3)[:, c] for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["node", "start", "stop"])

    return run


def class_passages(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(maximal passages (node, start, stop) that recur in another record, members (node, id)): every pair with a chain is read once.

    A class with several ids is a passage of its own. Two classes of one and the same id share nothing with another record."""
    texts, members, linked = span_chains(df, key, text, limit, k)
    size = members.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    side = lambda c: size.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("one").alias(f"one{c}"))
    apart = linked.select("l", "r").join(side("l"), "l").join(side("r"), "r").where("nl > 1 OR nr > 1 OR onel <> oner").select("l", "r")
    spans = pair_texts(materialize(apart, "pairs"), members, texts).mapInArrow(_passages(limit), "node long, start int, stop int")
    long = texts.select("node", F.lit(0).alias("start"), F.length("text").alias("stop"))  # before the join, so that it moves no text
    copies = long.join(size.where("n > 1").select("node"), "node", "left_semi")
    order = Window.partitionBy("node").orderBy("start", F.desc("stop"))
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.unionByName(copies).distinct().withColumn("before", F.coalesce(before, F.lit(-1)))
    return materialize(spans.where("stop > before").select("node", "start", "stop"), "passages"), members


def shared_passages(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = K) -> DataFrame:
    """(key, start, length): the maximal passages of at least ``limit`` characters of each record that recur verbatim in another one."""
    spans, members = class_passages(df, key, text, limit, k)
    return spans.join(members, "node").select(F.col("id").alias(key), "start", (F.col("stop") - F.col("start")).alias("length")).distinct()


def shared_share(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = K) -> DataFrame:
    """(key, chars, shared, share) of every record with an id: its characters, those that lie in passages shared with other records, and
    their share; 0 for empty and null texts."""
    spans, _ = class_passages(df, key, text, limit, k)
    before = F.lag("stop", 1, 0).over(Window.partitionBy("node").orderBy("start"))  # no passage lies in another, so the ends ascend
    new = spans.withColumn("new", F.col("stop") - F.greatest("start", before))
    shared = new.groupBy("node").agg(F.sum("new").cast("int").alias("shared"))
    chars = F.coalesce(F.length(text), F.lit(0))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key), F.xxhash64(text).alias("node"), chars.alias("chars")).distinct().join(shared, "node", "left")
    rows = rows.select(key, "chars", F.when(F.col("chars") >= limit, F.coalesce("shared", F.lit(0))).otherwise(F.lit(0)).alias("shared"))
    return rows.withColumn("share", F.coalesce(F.try_divide("shared", "chars"), F.lit(0.0)))


def p9_passages(spark, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


def p9_share(spark, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents"))


def p9_fuzzy(spark, sf_dir: str) -> DataFrame:
    return fuzzy_passages(table(spark, sf_dir, "documents"))


def p9_classes(spark, sf_dir: str) -> DataFrame:
    return span_classes(table(spark, sf_dir, "documents"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    pairs, members = shared_spans(table(spark, sf_dir, "documents"))
    return expand_pairs(pairs, members)
