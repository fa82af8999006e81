"""Stored approximate index of one space of vectors: unit vectors in folders by inverted list, and a small file that describes the lists."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.operators import vectors as V
from strandwork.operators.lifecycle import slug
from strandwork.session import file_system, materialize

#: Below this many vectors there is one list, which is scanned whole.
FLAT = 1000


def stem(spark: SparkSession, backend: str, dimensions: int, model: str | None) -> str:
    """The name of the index of a space."""
    named = spark.range(1).select(slug(F.lit(backend)), slug(F.lit(model or "none"))).first()
    return f"{named[0]}_{dimensions}_{named[1]}"


def build(rows: DataFrame, path: str, key: str = "chunk_id", seed: int = 42) -> None:
    """Writes the index of (key, vector): inverted lists by k-means, or one list for few vectors. Zero vectors must be out."""
    n = rows.count()
    if n < FLAT:
        kind = rows.schema[key].dataType.simpleString()

        def units(batches):
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["vector"])
                    yield pd.DataFrame({key: pdf[key], "vector": list(x / np.linalg.norm(x, axis=1, keepdims=True)), "list": 0, "near": 0.0})

        listed = materialize(rows.select(key, "vector").mapInPandas(units, f"{key} {kind}, vector array<double>, list int, near double"), "inverted")
        centres, least = np.zeros((1, 1)), {0: -1.0} if n else {}
    else:
        listed, centres, least = V.ivf_index(rows, key, seed)
    parts = max(1, len(least))
    listed.repartition(parts, "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    meta = {"rows": n, "flat": n < FLAT, "centres": centres.tolist(), "least": {str(k): v for k, v in least.items()}}
    rows.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def search(spark: SparkSession, path: str, query: list[float], k: int = 20, probes: int = 16, key: str = "chunk_id") -> DataFrame:
    """(key, score): the exact top k by cosine, not below 0; reads only the folders of lists that can hold one of them."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    listed = spark.read.parquet(f"{path}/lists")
    centres, least = np.array(meta["centres"]), {int(i): v for i, v in meta["least"].items()}
    if meta["flat"]:
        centres = np.zeros((1, len(query)))
    return V.ivf_search((listed, centres, least), query, k, probes, key)


def open_or_build(rows: DataFrame, path: str, key: str = "chunk_id") -> str:
    """The path of a finished index, made if there is none."""
    system, target = file_system(rows.sparkSession, f"{path}/meta/_SUCCESS")
    if not system.exists(target):
        build(rows, path, key)
    return path


def with_chunks(found: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of a search with their chunks: a top-k, broadcast to the chunk table."""
    return chunks.join(F.broadcast(found), key)
