"""Usable vectors as compact rows, and the cells of a codebook they are routed to.

Shared by p1 and p6. A vector is usable if its JSON is an array of exactly ``dimensions`` finite numbers that are
not all zero; others give no row. Vectors are comparable within a *space*: equal dimensions, model and backend
(case and outer blanks ignored, null equal to null).

A unit vector travels as 16-bit integers (scaled by its largest component), 2 bytes a dimension; the cosine of two
such vectors is off by a few 1e-6. Equal vectors are one *class*: ``vh`` is the hash of space and 16-bit form. Every
scan partition sends a class's vector once, so a group of copies, however large, costs a few narrow rows."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from strandwork.llm.textpairs import mix

BLANKS = " \t\r\n\x0b\x0c"


def space_column() -> Column:
    absent = F.lit("\x00")
    return F.concat_ws(
        "\x1f",
        F.col("dimensions").cast("string"),
        F.coalesce(F.col("model_name"), absent),
        F.coalesce(F.lower(F.trim(F.col("backend"), F.lit(BLANKS))), absent),
    )


def vector_rows(df: DataFrame, key: Column, kind: int) -> DataFrame:
    """(kind, key string, space, embedding_json, dimensions); rows that cannot hold a usable vector fall out here."""
    return df.select(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), space_column().alias("space"), "embedding_json", "dimensions"
    ).where("key IS NOT NULL AND embedding_json IS NOT NULL AND dimensions > 0")


def parse(text: str, dimensions: int) -> np.ndarray | None:
    """The unit vector of a JSON text, or None if it is not usable."""
    try:
        values = json.loads(text)
        if type(values) is not list or len(values) != dimensions or not set(map(type, values)) <= {int, float}:
            return None
        v = np.array(values, dtype=np.float64)
    except (ValueError, OverflowError, RecursionError):
        return None
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v /= top
    return v / np.sqrt(v @ v)


def pack(v: np.ndarray) -> bytes:
    return np.rint(v * (32767 / np.abs(v).max())).astype("<i2").tobytes()


def unpack(blobs, dimensions: int) -> np.ndarray:
    """Unit float32 rows of packed vectors."""
    x = np.frombuffer(b"".join(blobs), dtype="<i2").reshape(-1, dimensions).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None].astype(np.float32)


def class_hash(space: str, blob: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(space.encode() + blob), "big", signed=True)


def fit_sample(rows: DataFrame, n: int, target: int) -> dict[str, np.ndarray]:
    """Unit vectors by space from a bounded sample: about ``target`` rows picked by a hash of the key, at most twice that."""
    few = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(n, 1))) < target).select("space", "embedding_json", "dimensions")
    out: dict[str, dict[bytes, np.ndarray]] = {}
    for r in few.limit(2 * target).toLocalIterator():
        v = parse(r.embedding_json, r.dimensions)
        if v is not None:
            out.setdefault(r.space, {})[pack(v)] = v
    return {s: np.array([vs[k] for k in sorted(vs)], dtype=np.float32) for s, vs in out.items()}


def spread(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """``cells`` codewords of the coarse codebook, drawn from the sample: dense regions get many, so cells stay even."""
    if len(sample) <= cells:
        return sample
    return sample[np.sort(np.random.default_rng(seed).choice(len(sample), cells, replace=False))]


def nearest(x: np.ndarray, words: np.ndarray, r: int, block: int = 1024) -> np.ndarray:
    """Indices of the r codewords with the largest dot product, best first, for each row."""
    r = min(r, len(words))
    out = np.empty((len(x), r), dtype=np.int32)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ words.T
        top = np.argpartition(-s, r - 1, axis=1)[:, :r] if r < len(words) else np.tile(np.arange(r), (len(s), 1))
        out[i : i + block] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def parsed_batches(batches, size: int = 4096, needs=None):
    """From (kind, key, space, embedding_json, dimensions) frames: (space, hashes, blobs, unit rows, members) in blocks.

    ``members`` holds (class, kind, key) of every usable row; a class is in a block only the first time in this partition, and the
    first time that a row for which ``needs(kind, key)`` holds is a member, if that is in a later block."""
    seen: set[int] = set()
    met: set[int] = set()
    pending: dict[str, list] = {}

    def flush(space: str):
        hashes, blobs, members, _ = pending.pop(space)
        d = int(space.partition("\x1f")[0])
        return space, np.array(hashes, dtype=np.int64), blobs, unpack(blobs, d) if blobs else np.empty((0, d), np.float32), members

    for pdf in batches:
        for kind, key, space, text, d in zip(pdf["kind"], pdf["key"], pdf["space"], pdf["embedding_json"], pdf["dimensions"]):
            v = parse(text, d)
            if v is None:
                continue
            blob = pack(v)
            h = class_hash(space, blob)
            box = pending.setdefault(space, [[], [], [], set()])
            need = needs is not None and h not in met and needs(kind, key)
            if h not in seen or (need and h not in box[3]):
                seen.add(h)
                box[0].append(h)
                box[1].append(blob)
                box[3].add(h)
            if need:
                met.add(h)
            box[2].append((h, kind, key))
            if len(box[2]) >= size:
                yield flush(space)
    for space in list(pending):
        yield flush(space)


#: The codebook's bound: this many codewords at most, so its broadcast and the sample it is drawn from are bounded.
WORDS, SAMPLE = 32768, 65536
#: A cell with more distinct vectors is joined with itself in pairs of blocks of this size.
CELL = 4096


def cell_count(n: int, per_cell: int = 120, least: int = 16, turn: int = 8192, most: int = WORDS) -> int:
    """Number of coarse codewords for n rows: one for ``per_cell`` rows up to ``turn`` codewords, from there on growing with the square root of n, which
    balances routing (rows x codewords) and the work in cells (rows x rows a cell), up to ``most``."""
    words = n / per_cell
    if words > turn:
        words = turn * (words / turn) ** 0.5
    return int(min(most, max(least, words)))


def sample_size(n: int) -> int:
    """Rows that a codebook is fitted on: enough to train it, and several for each codeword of the coarse one."""
    return min(SAMPLE, max(16384, n // 15))


def stream_cells(frames, work, emit, members, cap: int | None = CELL):
    """Runs ``work(space, cell, frame)`` for every cell of frames that are sorted by (space, cell, vh); a frame holds a class once.

    At most ``cap`` rows of a cell are held: a larger one comes out again, by ``emit``, as rows with the number of their block. Rows without
    a space are members of classes and go through ``members`` as they come."""
    held: pd.DataFrame | None = None
    out: tuple = (None, None, 0, 0)  # space, cell, last class, classes so far of the cell that is coming out

    def deal(pdf, last):
        nonlocal held, out
        space, cell, vh = pdf["space"].to_numpy(), pdf["cell"].to_numpy(), pdf["vh"].to_numpy()
        border = (cell[1:] != cell[:-1]) | (space[1:] != space[:-1])
        edges = [0, *(np.flatnonzero(border) + 1).tolist(), len(pdf)]
        fresh = np.r_[True, border | (vh[1:] != vh[:-1])]
        for i, j in zip(edges[:-1], edges[1:]):
            one = pdf.iloc[i:j][fresh[i:j]]
            key = (space[i], cell[i])
            if key == out[:2] or (cap is not None and len(one) > cap):
                seen = out[3] if key == out[:2] else 0
                if key == out[:2] and one["vh"].iloc[0] == out[2]:
                    one = one.iloc[1:]
                out = (*key, vh[j - 1], seen + len(one))
                yield emit(one, ((seen + np.arange(len(one))) // cap).astype(np.int32))
            elif j == len(pdf) and not last:
                held = one
            else:
                yield work(*key, one)

    for pdf in frames:
        own = (pdf["space"] == "").to_numpy()
        if own.any():
            yield members(pdf[own])
            pdf = pdf[~own]
        if len(pdf):
            both = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            yield from deal(both, False)
    if held is not None:
        yield from deal(held, True)


def cell_hashes(space: str, cell: int, parts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each part of a cell."""
    base = np.uint64(xxhash.xxh3_64_intdigest(f"{space}\x1e{cell}"))
    return mix(parts.astype(np.int64).view(np.uint64) ^ base).view(np.int64)


def block_pairs(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rows (space, cell, block, vh, ...) of large cells, sent to every pair of blocks that holds their own; the pair takes the place of the cell."""
    blocks = rows.groupBy("space", "cell").agg((F.max("block") + 1).alias("blocks"))
    sent = rows.join(blocks, ["space", "cell"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    return by_cell(sent.select("space", pair.alias("cell"), "vh", *carried))


def by_cell(rows: DataFrame) -> DataFrame:
    """Rows in order of space, cell and class, each cell in one partition."""
    order = [c for c in ("space", "cell", "vh", "kind") if c in rows.columns]
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "space", "cell").sortWithinPartitions(*order)


def as_frame(**columns) -> pd.DataFrame:
    return pd.DataFrame(columns)
