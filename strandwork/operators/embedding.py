"""Embedding backends: hash features in the engine, and any model behind an Arrow-batched interface."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandwork.operators.vectors import BACKENDS, hash_embeddings

Model = Callable[[list[str]], np.ndarray]
#: Fixed value: tokens that a model sees of a text.
TOKENS = 512
_LOADED: dict[str, Model] = {}


def resolve(name: str | None, models: dict[str, Callable[[], Model]]) -> str:
    """The backend that a name stands for: unknown names, and those without a model here, mean hash."""
    low = (name or "").strip().lower()
    return low if low in BACKENDS and (low == "hash" or low in models) else "hash"


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x, dtype=np.float64), where=size > 0)


def embed(df: DataFrame, name: str, load: Callable[[], Model], dimensions: int, key: str = "chunk_id", text: str = "text", batch: int = 64) -> DataFrame:
    """(key, vector) of each text by a model that every worker loads once; texts go to it in batches, vectors come back of unit length.

    Null texts give no row; a model that gives another width is an error."""

    def run(frames):
        model = _LOADED.get(name)
        if model is None:
            model = _LOADED[name] = load()
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                x = np.asarray(model(part[text].tolist()), dtype=np.float64)
                if x.shape != (len(part), dimensions):
                    raise ValueError(f"{name}: {x.shape} instead of {(len(part), dimensions)}")
                yield pd.DataFrame({key: part[key].to_numpy(), "vector": list(unit_rows(x))})

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")


def embed_with(df: DataFrame, name: str | None, models: dict[str, Callable[[], Model]], dimensions: int = 256, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, vector, backend): by the named backend, or by hashing where it has no model."""
    backend = resolve(name, models)
    rows = hash_embeddings(df, dimensions, key, text) if backend == "hash" else embed(df, backend, models[backend], dimensions, key, text)
    return rows.withColumn("backend", F.lit(backend))


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked positions of (texts, positions, width)."""
    weight = mask[:, :, None].astype(np.float64)
    return (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


def onnx_model(model_path: str, tokenizer_path: str, tokens: int = TOKENS) -> Callable[[], Model]:
    """A loader for a transformer in ONNX form with its tokenizer file: ids cut at ``tokens``, mask-weighted mean of the last states."""

    def load() -> Model:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(tokens)
        tokenizer.enable_padding()
        wanted = {i.name for i in session.get_inputs()}

        def run(texts: list[str]) -> np.ndarray:
            coded = tokenizer.encode_batch(texts)
            given = {"input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded]}
            arrays = {k: np.array(v, dtype=np.int64) for k, v in given.items()}
            states = session.run(None, {k: v for k, v in arrays.items() if k in wanted})[0]
            return mean_pool(states, arrays["attention_mask"])

        return run

    return load
