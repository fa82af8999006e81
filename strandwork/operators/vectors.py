"""Stored vectors, similarity scans, hash embeddings, approximate search and clusters."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandwork.functions import text as T
from strandwork.operators.fusion import Weights
from strandwork.session import drop_materialized, materialize

#: Names of embedding backends; any other name means hash.
BACKENDS = ("hash", "onnx", "ml")
_TOKENS = re.compile("[a-z0-9_]+").findall


def backend(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.isin(*BACKENDS), low).otherwise("hash")


def with_vectors(df: DataFrame) -> DataFrame:
    """Adds ``vector`` (array<double>) parsed from embedding_json; rows without a usable vector fall out."""
    parsed = df.withColumn("vector", F.from_json("embedding_json", "array<double>"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return parsed.where((F.size("vector") == F.col("dimensions")) & ~bad & F.exists("vector", lambda x: x != 0))


def latest_query(queries: DataFrame) -> dict | None:
    """The query embedding that was updated last (ties: larger key): one row for the driver."""
    row = with_vectors(queries).agg(F.max_by(F.struct("query_key", "vector", "backend", "dimensions", "model_name"), F.struct(F.coalesce("updated_at", "created_at"), "query_key")).alias("q")).first()
    return row.q.asDict() if row and row.q else None


def scan_top_k(chunks: DataFrame, query: dict, k: int = 20, key: str = "chunk_id") -> DataFrame:
    """(key, score, rank): largest positive dot products with one query vector among rows of its backend, dimensions and model.

    The filter on backend, dimensions and model comes before any parsing; the top k is taken without a full sort."""
    same = (F.lower(F.trim("backend")) == query["backend"].strip().lower()) & (F.col("dimensions") == query["dimensions"]) & F.col("model_name").eqNullSafe(F.lit(query["model_name"]))
    vector = F.array(*map(F.lit, query["vector"]))
    rows = with_vectors(chunks.where(same)).select(key, T.dot(F.col("vector"), vector).alias("score")).where("score > 0").distinct()
    best = rows.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def hash_key(key: str, dimensions: int) -> tuple[int, int]:
    """(index, sign) of a feature by BLAKE2b."""
    d = hashlib.blake2b(key.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big") % dimensions, 1 if d[8] % 2 == 0 else -1


_PLACES: dict[tuple[str, int], tuple[int, int]] = {}
_FEATURES = 1_000_000


def hash_vector(text: str, dimensions: int, w: Weights = Weights()) -> np.ndarray:
    """The unit vector of a text's words and 3-grams, each placed by its hash; zeros for a text without tokens."""
    counts: dict[str, float] = {}
    for t, n in Counter(_TOKENS(text.lower())).items():
        counts["w:" + t] = counts.get("w:" + t, 0.0) + n
        padded = f"^{t}$"
        for i in range(max(1, len(padded) - 2)):
            g = "g:" + padded[i : i + 3]
            counts[g] = counts.get(g, 0.0) + n * w.ngram
    out = np.zeros(dimensions)
    for f, c in counts.items():
        place = _PLACES.get((f, dimensions))
        if place is None:
            if len(_PLACES) >= _FEATURES:
                _PLACES.clear()
            place = _PLACES[(f, dimensions)] = hash_key(f, dimensions)
        out[place[0]] += place[1] * (1 + math.log1p(c))
    size = math.sqrt(out @ out)
    return out / size if size else out


def hash_embeddings(df: DataFrame, dimensions: int = 256, key: str = "chunk_id", text: str = "text", w: Weights = Weights()) -> DataFrame:
    """(key, vector) of each text from its words and 3-grams, in one pass over Arrow batches; a worker keeps the places of the features it has met.

    A text without tokens has the zero vector; null texts give no row; of rows with one key one counts."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "vector": [hash_vector(t, dimensions, w) for t in pdf["text"]]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).groupBy(key).agg(F.min(text).alias("text"))
    return rows.mapInPandas(run, f"{key} {kind}, vector array<double>")


def _as_ml(df: DataFrame, key: str):
    from pyspark.ml.functions import array_to_vector

    return df.select(key, array_to_vector("vector").alias("features"))


def kmeans_clusters(vectors: DataFrame, k: int, key: str = "chunk_id", seed: int = 42, rounds: int = 20) -> DataFrame:
    """(key, cluster) by Lloyd's iterations; k or fewer rows are clusters of their own."""
    from pyspark.ml.clustering import KMeans

    rows = _as_ml(vectors, key)
    if rows.count() <= k:
        return rows.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("cluster"))
    return KMeans(k=k, seed=seed, maxIter=rounds).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))


def ivf_index(vectors: DataFrame, key: str = "chunk_id", seed: int = 42) -> tuple[DataFrame, np.ndarray, dict[int, float]]:
    """(rows (key, unit vector, list), unit centres, by list the least cosine of a row to its centre): inverted lists by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    kind = vectors.schema[key].dataType.simpleString()
    vectors = materialize(vectors.select(key, "vector"), "vectors")
    n = vectors.count()
    lists = max(1, min(int(n**0.5), 256))

    def units(pdf):
        x = np.stack(pdf["vector"])
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def scaled(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vector": list(units(pdf))})

    some = vectors.select("vector").sample(min(1.0, 20_000 / max(1, n)), seed).mapInPandas(scaled, "vector array<double>")
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(some.select(array_to_vector("vector").alias("features")))
    centres = np.array([c / max(np.linalg.norm(c), 1e-12) for c in model.clusterCenters()])

    def placed(batches):
        for pdf in batches:
            if len(pdf):
                x = units(pdf)
                near = x @ centres.T
                yield pd.DataFrame({key: pdf[key], "vector": list(x), "list": near.argmax(axis=1).astype(np.int32), "near": near.max(axis=1)})

    listed = materialize(vectors.mapInPandas(placed, f"{key} {kind}, vector array<double>, list int, near double"), "inverted")
    drop_materialized(vectors)
    least = listed.groupBy("list").agg(F.min("near").alias("least"))
    return listed, centres, {r["list"]: r["least"] for r in least.collect()}


def ivf_search(index: tuple[DataFrame, np.ndarray, dict[int, float]], query: list[float], k: int = 20, probes: int = 16, key: str = "chunk_id") -> DataFrame:
    """(key, score): the exact top k. The ``probes`` nearest lists give a k-th score; every other list that can hold a row as good is scanned too.

    A row is no farther from its centre, as an angle, than the farthest row of its list, which bounds the cosine of all rows of a list."""
    listed, centres, least = index
    q = np.array(query) / np.linalg.norm(query)
    near = np.clip(centres @ q, -1, 1)
    order = sorted(least, key=lambda i: -near[i])

    def best(lists):
        score = F.greatest(F.lit(0.0), T.dot(F.col("vector"), F.array(*map(F.lit, q.tolist()))))
        return listed.where(F.col("list").isin(lists)).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)

    def bound(i):
        return max(0.0, float(np.cos(max(0.0, np.arccos(near[i]) - np.arccos(np.clip(least[i], -1, 1))))))

    found = [r.score for r in best(order[:probes]).collect()]
    floor = min(found) if len(found) == k else 0.0
    return best(order[:probes] + [i for i in order[probes:] if bound(i) >= floor - 1e-6])


def ivf_top_k(vectors: DataFrame, query: list[float], k: int = 20, probes: int = 16, key: str = "chunk_id", seed: int = 42) -> DataFrame:
    """(key, score): the exact top k by inverted lists, see ``ivf_search``."""
    return ivf_search(ivf_index(vectors, key, seed), query, k, probes, key)
