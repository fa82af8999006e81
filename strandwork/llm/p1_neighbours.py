"""p1: the k most similar vectors of every vector, by additive quantisation.

Codebooks: ``BOOKS`` full-dimensional codebooks of ``WORDS`` codewords are trained on the residuals of a bounded
sample (``TRAIN`` vectors). Encoding: a beam of ``BEAM`` partial sums per vector keeps the best sums of codewords, and
the norm of the reconstruction is stored. Scoring: a query's dot products with all codewords form its lookup table; a
candidate's score is the sum of its table entries over its stored norm. The best ``RERANK`` scores of a cell are
reranked by exact cosines. Candidates are classes that hold a chunk; classes of queries alone only ask. Which candidates a query scores is set by the coarse codebook: rows are routed to
their ``probes`` nearest coarse codewords, and a query scores everything in its cells. Cells come by in order; one with more than ``V.CELL`` vectors is searched in
pairs of blocks. This serves lists with a floor well above chance; whole lists come from ``scanned_neighbours``, which leaves out the cells.

Defined results: unusable vectors and null keys give no row; duplicate rows count once; equal vectors are each
other's neighbours at cosine 1; ties go to the smaller id; a vector is never its own neighbour; an empty table gives no
rows; extra columns are ignored. With a ``floor`` the lists hold only neighbours at or above it, ranked as in the
full list. A class of copies keeps its k + 1 smallest ids as candidates, which is all that a list of k can hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from strandwork.llm import vecspace as V
from strandwork.session import materialize, table

BOOKS, WORDS, BEAM, RERANK, TRAIN, PROBES = 8, 64, 4, 64, 16384, 4
#: Codewords a book for whole lists; rows of a shard; one of how many is reranked exactly for each query; blocks of queries while there is one shard.
SCAN_WORDS, SHARD, SHARE, BLOCKS = 256, 65536, 40, 16
_ROUTED = "space string, cell long, vh long, blob binary, code binary, norm float, kind int, key string"
#: kind 0: candidate b of class a; 1 and 2: row ``key`` of a chunk or a query has class a; 3: class a of a large cell b, with its space (key), block and what it carries.
_SCORED = "kind int, a long, b long, cosine double, key string, blob binary, code binary, norm float, own int, block int"


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """(books, words, d) residual codebooks: k-means of what the books before leave over; fewer words for tiny samples."""
    rng = np.random.default_rng(seed)
    if len(sample) > TRAIN:
        sample = sample[np.sort(rng.choice(len(sample), TRAIN, replace=False))]
    rest, out = sample.astype(np.float32).copy(), []
    words = min(words, len(sample))
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            own = np.argmax(rest @ c.T - 0.5 * np.einsum("ij,ij->i", c, c), axis=1)
            count = np.bincount(own, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, own, rest)
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        rest -= c[np.argmax(rest @ c.T - 0.5 * np.einsum("ij,ij->i", c, c), axis=1)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes uint8 (n, books), norms of the reconstructions) by beam search over the sums of codewords."""
    n, (m, k, d) = len(x), books.shape
    rest, codes, loss = x[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8), np.einsum("ij,ij->i", x, x)[:, None]
    for c in books:
        b = rest.shape[1]
        after = loss[:, :, None] - 2 * (rest.reshape(-1, d) @ c.T).reshape(n, b, k) + np.einsum("ij,ij->i", c, c)
        flat = after.reshape(n, b * k)
        w = min(beam, b * k)
        best = np.argpartition(flat, w - 1, axis=1)[:, :w]
        parent, word = best // k, best % k
        loss = np.take_along_axis(flat, best, 1)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - c[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
    one = np.argmin(loss, axis=1)[:, None, None]
    recon = x - np.take_along_axis(rest, one, 1)[:, 0]
    return np.take_along_axis(codes, one, 1)[:, 0], np.sqrt(np.einsum("ij,ij->i", recon, recon)).astype(np.float32)


def scores(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray, block: int = 2048) -> np.ndarray:
    """Approximate cosines of every query with every code, from lookup tables only: a table row holds one codeword for all queries."""
    tables = np.ascontiguousarray(np.einsum("mkd,qd->mkq", books, queries, optimize=True), dtype=np.float32)
    at, size = np.ascontiguousarray(codes.T).astype(np.intp), np.maximum(norms, 1e-6)[:, None]
    out = np.empty((len(queries), len(codes)), dtype=np.float32)
    total, one = (np.empty((min(block, len(codes)), len(queries)), dtype=np.float32) for _ in range(2))
    for i in range(0, len(codes), block):
        n = min(block, len(codes) - i)
        np.take(tables[0], at[0, i : i + n], axis=0, out=total[:n], mode="clip")
        for t, own in zip(tables[1:], at[1:]):
            np.take(t, own[i : i + n], axis=0, out=one[:n], mode="clip")
            np.add(total[:n], one[:n], out=total[:n])
        np.divide(total[:n], size[i : i + n], out=total[:n])
        out[:, i : i + n] = total[:n].T
    return out


def best_share(row: np.ndarray, few: int, step: int = 16) -> np.ndarray:
    """Positions of about the ``few`` largest values, at least half of them: those over a threshold read off every ``step``-th value.

    The rows of a shard are in order of a hash, so every step-th one stands for all; where too few pass, they are picked exactly."""
    n, some = len(row), row[::step]
    rank = few // step + few // (8 * step) + 1
    if few >= step * 8 and rank < len(some):
        at = np.flatnonzero(row >= np.partition(some, len(some) - rank)[len(some) - rank])
        if len(at) >= few // 2:
            return at
    return np.argpartition(row, n - few)[n - few :]


def _router(shared, probes):
    def route(batches):
        for space, hashes, blobs, x, members in V.parsed_batches(batches, needs=lambda kind, _: kind == 0):
            chunks = {h for h, kind, _ in members if kind == 0}
            words, books = shared.value.get(space, (None, None))
            if len(hashes):
                cells = np.zeros((len(x), 1), dtype=np.int32) if words is None else V.nearest(x, words, probes)
                codes, norms = (None, np.zeros(len(x), np.float32)) if books is None else encode(x, books)
                code = [b""] * len(x) if codes is None else [c.tobytes() for c in codes]
                r = cells.shape[1]
                obj = lambda v: np.repeat(np.array(v, dtype=object), r)
                yield pd.DataFrame({"space": space, "cell": cells.ravel().astype(np.int64), "vh": np.repeat(hashes, r), "blob": obj(blobs), "code": obj(code), "norm": np.repeat(norms, r), "kind": np.repeat([0 if h in chunks else 1 for h in hashes.tolist()], r), "key": None})
            if members:
                h, kinds, keys = zip(*members)
                h = np.array(h, dtype=np.int64)
                yield pd.DataFrame({"space": "", "cell": -1 - (h * 31 + np.arange(len(h))) % 199, "vh": h, "blob": None, "code": None, "norm": 0.0, "kind": np.array(kinds, dtype=np.int32), "key": list(keys)})

    return route


def _frame(kind, a, b=None, cosine=None, key=None, blob=None, code=None, norm=0.0, own=0, block=0):
    n = len(a)
    return pd.DataFrame({"kind": np.full(n, kind, dtype=np.int32) if np.isscalar(kind) else kind, "a": a, "b": b, "cosine": cosine, "key": key, "blob": blob, "code": code, "norm": norm, "own": own, "block": block}, index=range(n))


def _members(pdf):
    return _frame((pdf["kind"] + 1).to_numpy(dtype=np.int32), pdf["vh"].to_numpy(), key=pdf["key"].to_numpy())


def _search(shared, k, floor, cap, block=256):
    """Candidates of every class of a cell; rows are sorted so that a class that holds a chunk (kind 0) is met as such."""

    def work(space, cell, pdf):
        pdf = pdf.sort_values("kind", kind="stable")  # classes with a chunk first: only these are candidates
        h, n = pdf["vh"].to_numpy(), int((pdf["kind"] == 0).sum())
        if len(h) < 2 or not n:
            return _frame(0, h[:0])
        x = V.unpack(pdf["blob"], int(space.partition("\x1f")[0]))
        books = shared.value.get(space, (None, None))[1]
        codes = None if books is None else np.frombuffer(b"".join(pdf["code"]), dtype=np.uint8).reshape(len(h), -1)
        norms = pdf["norm"].to_numpy()
        depth = min(RERANK, n)
        left, right, cosine = [], [], []
        for i in range(0, len(h), block):
            q = x[i : i + block]
            at = np.arange(min(len(q), max(0, n - i)))
            s = q @ x[:n].T if codes is None else scores(q, books, codes[:n], norms[:n])
            s[at, at + i] = -np.inf
            top = np.argpartition(-s, depth - 1, axis=1)[:, :depth]
            exact = np.einsum("qd,qrd->qr", q, x[top], optimize=True)
            exact[top == np.arange(i, i + len(q))[:, None]] = -np.inf
            order = np.argsort(-exact, axis=1, kind="stable")[:, : k + 1]
            c = np.take_along_axis(exact, order, 1)
            t = np.take_along_axis(top, order, 1)
            keep = c >= floor
            left.append(np.repeat(h[i : i + block], keep.sum(1)))
            right.append(h[t[keep]])
            cosine.append(c[keep])
        return _frame(0, np.concatenate(left), np.concatenate(right), np.concatenate(cosine).astype(np.float64))

    def emit(pdf, block):
        return _frame(3, *(pdf[c].to_numpy() for c in ("vh", "cell")), None, *(pdf[c].to_numpy() for c in ("space", "blob", "code", "norm", "kind")), block)

    return lambda frames: V.stream_cells(frames, work, emit, _members, cap)


def _ranked(found: DataFrame, k: int, floor: float, asks=None) -> DataFrame:
    """Lists of the members of each class from scored class pairs; ``asks`` (a Column over kind and key) picks the rows that get one."""
    members = found.where("kind IN (1, 2)").select((F.col("kind") - 1).alias("kind"), F.col("a").alias("vh"), "key").distinct()
    ids = members.where("kind = 0").select("vh", F.col("key").cast("long").alias("id"))
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy("vh").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    near = pairs.join(first.withColumnRenamed("vh", "b"), "b").select("a", "cosine", "id")
    if floor <= 1:
        near = near.unionByName(first.select(F.col("vh").alias("a"), F.lit(1.0).alias("cosine"), "id"))
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "id")
    lists = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = lists.groupBy(F.col("a").alias("vh")).agg(F.sort_array(F.collect_list(F.struct("n", "id", "cosine"))).alias("near"))
    own = F.filter("near", lambda x: (F.col("kind") == 1) | (x["id"].cast("string") != F.col("key")))
    each = (members if asks is None else members.where(asks)).join(lists, "vh").select("kind", "key", F.posexplode(F.slice(own, 1, k)).alias("pos", "x"))
    return each.select(F.col("kind").alias("left_kind"), F.col("key").alias("left_key"), F.col("x.id").alias("right_id"), F.col("x.cosine").alias("cosine"), (F.col("pos") + 1).alias("rank"))


def nearest_vectors(chunks: DataFrame, queries: DataFrame | None = None, k: int = 10, *, floor: float, probes: int = PROBES, cap: int = V.CELL) -> DataFrame:
    """(left_kind 0 chunk | 1 query, left_key string, right_id long, cosine, rank): of the lists of all rows over all chunk vectors what is at or above ``floor``."""
    rows = V.vector_rows(chunks, F.col("chunk_id"), 0)
    n = chunks.count()
    sample = V.fit_sample(rows, n, V.sample_size(n))  # of chunks: many queries in one place must not narrow its cells
    if queries is not None:
        rows = rows.unionByName(V.vector_rows(queries, F.col("query_key"), 1))
    total = max(1, sum(map(len, sample.values())))
    shared = rows.sparkSession.sparkContext.broadcast(
        {s: (V.spread(x, V.cell_count(n * len(x) // total)), train(x) if len(x) >= 256 else None) for s, x in sample.items()}
    )
    routed = rows.mapInPandas(_router(shared, probes), _ROUTED)
    first = materialize(V.by_cell(routed).mapInPandas(_search(shared, k, floor, cap), _SCORED), "lists")
    large = first.where("kind = 3").select(F.col("key").alias("space"), F.col("b").alias("cell"), F.col("a").alias("vh"), "blob", "code", "norm", F.col("own").alias("kind"), "block")
    again = V.block_pairs(large, ["blob", "code", "norm", "kind"]).withColumn("key", F.lit(None).cast("string")).mapInPandas(_search(shared, k, floor, None), _SCORED)
    return _ranked(first.where("kind < 3").unionByName(again), k, floor)


def _shards(shared, shards, blocks):
    """Every class of a chunk goes to one shard as a candidate (kind 0), every class that asks to all shards (kind 1); with few shards the queries are
    dealt to blocks, each of which has all shards of its own."""
    def route(batches):
        for space, hashes, blobs, x, members in V.parsed_batches(batches, needs=lambda kind, _: kind == 0):
            books = shared.value.get(space)
            chunks = {h for h, kind, _ in members if kind == 0}
            own = np.array([h in chunks for h in hashes.tolist()], dtype=bool)
            if own.any():
                codes, norms = (None, np.zeros(own.sum(), np.float32)) if books is None else encode(x[own], books)
                code = [b""] * int(own.sum()) if codes is None else [c.tobytes() for c in codes]
                blob = np.array(blobs, dtype=object)[own]
                each = lambda v: np.repeat(np.array(v, dtype=object), blocks)
                cell = (hashes[own] % shards)[:, None] + shards * np.arange(blocks)
                yield pd.DataFrame({"space": space, "cell": cell.ravel(), "vh": np.repeat(hashes[own], blocks), "blob": each(blob), "code": each(code), "norm": np.repeat(norms, blocks), "kind": 0, "key": None})
            if members:
                h, kinds, keys = zip(*members)
                h = np.array(h, dtype=np.int64)
                yield pd.DataFrame({"space": "", "cell": -1 - (h * 31 + np.arange(len(h))) % 199, "vh": h, "blob": None, "code": None, "norm": 0.0, "kind": np.array(kinds, dtype=np.int32), "key": list(keys)})

    def ask(batches):
        for space, hashes, blobs, _, members in V.parsed_batches(batches):
            n = len(hashes)
            if n:
                cell = np.arange(shards) + shards * ((hashes // shards) % blocks)[:, None]
                yield pd.DataFrame({"space": space, "cell": cell.ravel(), "vh": np.repeat(hashes, shards), "blob": np.repeat(np.array(blobs, dtype=object), shards), "code": None, "norm": 0.0, "kind": 1, "key": None})

    return route, ask


def _scan(shared, k, share, block=64):
    """Frames sorted by shard, candidates before queries: the candidates of a shard are held, the queries stream by."""

    def run(frames):
        now, parts, held = None, [], None
        for pdf in frames:
            own = (pdf["space"] == "").to_numpy()
            if own.any():
                yield _members(pdf[own])
                pdf = pdf[~own]
            for key, some in pdf.groupby(["space", "cell"], sort=False):
                if key != now:
                    now, parts, held = key, [], None
                rows, asks = some[some["kind"] == 0], some[some["kind"] == 1]
                if len(rows):
                    parts.append(rows)
                if len(asks) and (parts or held is not None):
                    if held is None:
                        held, parts = shard(key[0], pd.concat(parts).drop_duplicates("vh")), []
                    yield search(key[0], held, asks.drop_duplicates("vh"))

    def shard(space, rows):
        books = shared.value.get(space)
        codes = None if books is None else np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
        return V.unpack(rows["blob"], int(space.partition("\x1f")[0])), rows["vh"].to_numpy(), books, codes, rows["norm"].to_numpy()

    def search(space, held, asks):
        x, h, books, codes, norms = held
        q, ah, few = V.unpack(asks["blob"], x.shape[1]), asks["vh"].to_numpy(), min(len(h), max(4 * k, -(-len(h) // share)))
        out = []
        for i in range(0, len(q), block):
            y = q[i : i + block]
            s = y @ x.T if codes is None else scores(y, books, codes, norms)
            for row, found, own in zip(y, s, ah[i : i + block].tolist()):
                at = best_share(found, few)
                exact = x[at] @ row
                exact[h[at] == own] = -2  # its own class comes from the members
                best = np.argsort(-exact, kind="stable")[: k + 1]
                best = best[exact[best] > -1.5]
                out.append((np.full(len(best), own, dtype=np.int64), h[at[best]], exact[best]))
        a, b, c = (np.concatenate(v) for v in zip(*out))
        return _frame(0, a, b, c.astype(np.float64))

    return run


def scanned_neighbours(chunks: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 20, share: int = SHARE, shard: int = SHARD) -> DataFrame:
    """The whole lists of the chunk vectors whose id is divisible by ``every`` and of all query vectors, scored against all rows without a coarse codebook.

    The rows are dealt to shards once, the stated query set goes to every shard and streams by; every code of a shard is scored through the lookup tables, and the best
    of each shard, one in ``share`` of its rows, are reranked exactly. For neighbours that are hardly more similar than chance no cell can stand in for this."""
    rows = V.vector_rows(chunks, F.col("chunk_id"), 0)
    n = chunks.count()
    sample = V.fit_sample(rows, n, V.sample_size(n))
    shared = rows.sparkSession.sparkContext.broadcast({s: train(x, words=SCAN_WORDS) for s, x in sample.items() if len(x) >= 256})
    shards = max(1, -(-n // shard))
    route, ask = _shards(shared, shards, max(1, BLOCKS // shards))
    asking = rows.where(F.expr(f"try_cast(key AS bigint) % {every} = 0"))
    if queries is not None:
        own = V.vector_rows(queries, F.col("query_key"), 1)
        rows, asking = rows.unionByName(own), asking.unionByName(own)
    sent = rows.mapInPandas(route, _ROUTED).unionByName(asking.mapInPandas(ask, _ROUTED))
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, "space", "cell").sortWithinPartitions("space", "cell", "kind", "vh")
    found = materialize(sent.mapInPandas(_scan(shared, k, share), _SCORED), "lists")
    return _ranked(found, k, -2.0, F.expr(f"kind = 1 OR try_cast(key AS bigint) % {every} = 0"))


def p1_lists(spark, sf_dir: str) -> DataFrame:
    """Lists of the stated query set: left_kind 0 with a chunk_id or 1 with a query_key."""
    return scanned_neighbours(table(spark, sf_dir, "chunk_embeddings"), table(spark, sf_dir, "query_embeddings"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    lists = nearest_vectors(table(spark, sf_dir, "chunk_embeddings"), table(spark, sf_dir, "query_embeddings"), floor=0.92)
    one = F.col("left_kind") == 1
    return lists.select(
        F.when(one, F.col("left_key")).otherwise(F.least(F.expr("try_cast(left_key AS bigint)"), "right_id").cast("string")).alias("left_key"),
        F.when(one, F.col("right_id")).otherwise(F.greatest(F.expr("try_cast(left_key AS bigint)"), "right_id")).alias("right_id"),
    ).distinct()
