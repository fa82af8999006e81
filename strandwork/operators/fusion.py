"""Rank fusion: reciprocal ranks, weighted reranking, merging of adjacent chunks."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandwork.functions import text as T


@dataclass(frozen=True)
class Weights:
    """The default weights of the ranking."""

    lexical_rank: float = 0.35
    lexical_bm25: float = 0.65
    fts: float = 0.50
    vector: float = 0.35
    overlap: float = 0.15
    textrank: float = 0.50
    query: float = 0.35
    length: float = 0.10
    length_words: int = 24
    ngram: float = 0.35
    rrf_k: int = 60


def weights(overrides: dict | None = None) -> Weights:
    """The default weights with those given in their place; unknown names and what is no number are refused."""
    known = {f.name: f.type for f in fields(Weights)}
    for name, value in (overrides or {}).items():
        if name not in known or isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"no weight: {name}={value!r}")
    return replace(Weights(), **(overrides or {}))


def fuse(lexical: DataFrame, vector: DataFrame, key: str = "chunk_id", by: str = "query_id") -> DataFrame:
    """Full outer join of two rankings with all their columns: those of the lexical row win, the vector row fills what it lacks."""
    shared = [c for c in lexical.columns if c in vector.columns and c not in (by, key)]
    right = vector.select(by, key, *[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in vector.columns if c not in (by, key)])
    joined = lexical.withColumn("_there", F.lit(True)).join(right, [by, key], "full_outer")
    for c in shared:
        joined = joined.withColumn(c, F.when(F.col("_there"), F.col(c)).otherwise(F.col(f"_{c}")))
    return joined.drop("_there", *[f"_{c}" for c in shared])


def reciprocal(*ranks: str, k: int = Weights.rrf_k) -> Column:
    """Sum of 1 / (k + rank); a missing rank adds nothing."""
    parts = [F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ranks]
    return sum(parts[1:], parts[0])


def rrf(lexical: DataFrame, vector: DataFrame, key: str = "chunk_id", by: str = "query_id", k: int = 60) -> DataFrame:
    """(by, key, fts_rank, vector_rank, rrf): full outer join of two rankings (column rank); a missing rank adds nothing."""
    left = lexical.select(by, key, F.col("rank").alias("fts_rank"))
    right = vector.select(by, key, F.col("rank").alias("vector_rank"))
    return left.join(right, [by, key], "full_outer").withColumn("rrf", reciprocal("fts_rank", "vector_rank", k=k))


def weighted(candidates: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Adds fts_score, vector_signal and final_score to rows with fts_rank, bm25, vector_rank, vector_score and overlap."""
    fts = w.lexical_rank * T.rank_score(F.col("fts_rank")) + w.lexical_bm25 * T.bm25_signal(F.col("bm25"))
    vector = F.when(F.col("vector_score") > 0, F.col("vector_score")).otherwise(T.rank_score(F.col("vector_rank")))
    scored = candidates.withColumn("fts_score", fts).withColumn("vector_signal", vector)
    return scored.withColumn("final_score", w.fts * F.col("fts_score") + w.vector * F.col("vector_signal") + w.overlap * F.col("overlap"))


#: Scores and ranks that a merged run keeps: the largest score, the first chunk's ranks.
SCORES, RANKS = ("fts_score", "vector_score", "overlap", "final_score"), ("bm25", "fts_rank", "vector_rank")


def merge_runs(chunks: DataFrame, group: list[str], index: str = "chunk_index", score: str = "final_score") -> DataFrame:
    """Runs of consecutive chunks of one group: first index and id, texts joined by newlines, summed tokens, the largest of each score there is, and the
    first chunk's ranks."""
    order = Window.partitionBy(*group).orderBy(index, "chunk_id")
    once = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*group, index).orderBy("chunk_id"))).where("_n = 1")
    runs = once.withColumn("_run", F.col(index) - F.row_number().over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "\n")
    top = [F.max(c).alias(c) for c in dict.fromkeys((*SCORES, score)) if c in chunks.columns]
    first = [F.min_by(c, index).alias(c) for c in ("chunk_id", *RANKS) if c in chunks.columns]
    tokens = F.sum("token_estimate").alias("token_estimate")
    return runs.groupBy(*group, "_run").agg(F.min(index).alias("first_index"), F.count("*").alias("merged"), tokens, text.alias("text"), *top, *first).drop("_run")
