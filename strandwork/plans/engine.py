"""The engine: index a corpus into tables, answer queries with cited, budgeted context."""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.functions import text as T
from strandwork.operators import chunking, compress, fusion, lexical, lifecycle, vectors
from strandwork.plans.index import Index
from strandwork.session import file_system, materialize, shared_dir, table
from strandwork.sources.settings import Settings

TIERS = ((200, "fts_only"), (2000, "fts_with_hash"))
_CACHE = "cache_key string, payload string, created long, expires long"


def retrieval_tier(chunks: int) -> str:
    """By the number of chunks, which the stored index knows."""
    return next((name for most, name in TIERS if chunks < most), "full_hybrid")


def vector_path(tier: str, mode: str, hits, wanted: int, backend: str):
    """Column: what becomes of the vector search of a query with ``hits`` lexical hits: 'scan', or why there is none."""
    sparse = F.lit(True) if mode == "always" else F.lit(False) if tier == "fts_only" else hits < wanted
    idle = F.lit("disabled_small_codebase" if tier == "fts_only" and mode != "always" else "disabled")
    return F.when(sparse & F.lit(backend == "hash"), F.lit("skipped_hash_backend")).when(sparse, F.lit("scan")).otherwise(idle)


class Engine:
    """Tables: documents (doc_id, source, …), chunks (chunk_id, doc_id, chunk_index, text, token_estimate), optional vectors.

    Queries come as a list (query_id, text) from the driver; what is ranked for them, at most fts_k + vector_k rows a query, is one small table
    from which the packets are made in a single stage."""

    def __init__(self, spark: SparkSession, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame | None = None, settings: Settings = Settings(), index: Index | None = None):
        self.spark, self.documents, self.embeddings, self.settings = spark, documents, embeddings, settings
        self.raw_chunks, self._index = chunks, index

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> "Engine":
        documents, chunks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunks")
        return cls(spark, documents, chunks, table(spark, sf_dir, "chunk_embeddings"), settings, Index.of_tables(spark, sf_dir, documents, chunks))

    @classmethod
    def index(cls, spark: SparkSession, files: DataFrame, settings: Settings = Settings()) -> "Engine":
        """From files (doc_id, source, raw_text): clean, drop what is empty then, chunk. Chunk ids are hashes of document and position."""
        docs, chunks = _chunked(files, settings)
        return cls(spark, docs, chunks, None, settings)

    @property
    def stored(self) -> Index:
        if self._index is None:
            self._index = Index.build(self.documents, self.raw_chunks, f"{shared_dir(self.spark)}/strandwork/{self.spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}")
        return self._index

    @property
    def chunks(self) -> DataFrame:
        return self.stored.chunks()

    def upsert(self, files: DataFrame) -> "Engine":
        """The engine after files (doc_id, source, raw_text) replaced those with the same source: chunks, postings and vectors of the old ones
        go, the new ones are cleaned, chunked, embedded by hashing where there is a vector table, and indexed. Files that are empty when cleaned
        are passed over: what is there of them stays."""
        docs, chunks = _chunked(files, self.settings)
        dead = self.documents.join(docs.select("source").distinct(), "source", "left_semi").select("doc_id").distinct()
        common = [c for c in self.documents.columns if c in docs.columns]
        documents = materialize(lifecycle.upsert(self.documents.select(*common), docs.select(*common), "source"), "documents")
        kept = self.raw_chunks.join(dead, "doc_id", "left_anti").select("chunk_id", "doc_id", "chunk_index", "text", "token_estimate")
        chunks = materialize(chunks.select("chunk_id", "doc_id", "chunk_index", "text", "token_estimate"), "chunks")
        embeddings = self.embeddings
        if embeddings is not None:
            gone = self.raw_chunks.join(dead, "doc_id", "left_semi").select("chunk_id").distinct()
            size = self.settings.dimensions
            new = vectors.hash_embeddings(chunks, size).select("chunk_id", F.to_json("vector").alias("embedding_json"), F.lit("hash").alias("backend"), F.lit(size).alias("dimensions"), F.lit(None).cast("string").alias("model_name"))
            embeddings = materialize(embeddings.select(*new.columns).join(gone, "chunk_id", "left_anti").unionByName(new), "embeddings")
        return Engine(self.spark, documents, materialize(kept.unionByName(chunks), "chunks"), embeddings, self.settings)

    def sources(self) -> DataFrame:
        """(chunk_id, doc_id, chunk_index, text, token_estimate, source) of the chunks that have a document."""
        return self.chunks.where("live").drop("live", "n_tokens")

    def bm25(self, queries: list[tuple[int, str]]) -> DataFrame:
        """(query_id, chunk_id, bm25, live) of all chunks with a phrase of a query."""
        return self.stored.bm25(queries)

    def lexical(self, queries: list[tuple[int, str]]) -> DataFrame:
        """(query_id, chunk_id, bm25, rank) of the best fts_k chunks that have a document."""
        return lexical.top_k(self.bm25(queries).where("live").drop("live"), self.settings.fts_k)

    def vector(self, query_id: int, query: dict) -> DataFrame:
        found = vectors.scan_top_k(self.embeddings, query, self.settings.vector_k)
        return found.withColumn("query_id", F.lit(query_id))

    def candidates(self, queries: list[tuple[int, str]], vector: DataFrame | None = None, mode: str = "fallback", backend: str = "ml") -> DataFrame:
        """(query_id, chunk_id, bm25, fts_rank, vector_rank, vector_score, fts_hits, vector_hits, path): both rankings of each query.

        A vector ranking (query_id, chunk_id, score, rank) is used where the size of the index, the mode and the number of lexical hits ask for it."""
        found = self.lexical(queries).withColumnRenamed("rank", "fts_rank")
        asked = self.spark.createDataFrame([(i,) for i, _ in queries], "query_id int").coalesce(1)
        hits = asked.join(found.groupBy("query_id").agg(F.count("*").alias("fts_hits")), "query_id", "left").na.fill(0, ["fts_hits"])
        path = vector_path(retrieval_tier(self.stored.n), mode, F.col("fts_hits"), self.settings.min_fts_hits, backend) if vector is not None else F.lit("disabled")
        hits = hits.withColumn("path", path)
        if vector is None:
            both = found.withColumn("vector_rank", F.lit(None).cast("int")).withColumn("vector_score", F.lit(0.0))
            hits = hits.withColumn("vector_hits", F.lit(0).cast("long"))
        else:
            near = vector.join(hits.where("path = 'scan'").select("query_id"), "query_id").select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
            both = found.join(near, ["query_id", "chunk_id"], "full_outer").withColumn("vector_score", F.coalesce("vector_score", F.lit(0.0)))
            hits = hits.join(near.groupBy("query_id").agg(F.count("*").alias("vector_hits")), "query_id", "left").na.fill(0, ["vector_hits"])
        return hits.join(both, "query_id", "left")

    def pool(self, queries: list[tuple[int, str]], vector: DataFrame | None = None, mode: str = "fallback", backend: str = "ml") -> DataFrame:
        """The candidates with their texts and scores: a small table, read as one partition. Queries without candidates have a row without a chunk.

        The driver sees the ids (at most fts_k + vector_k a query), so that the texts are looked up by a filter that reaches the scan."""
        ranked = materialize(self.candidates(queries, vector, mode, backend), "candidates").coalesce(1)
        ids = [r[0] for r in ranked.where("chunk_id IS NOT NULL").select("chunk_id").distinct().collect()]
        texts = self.stored.texts(ids).where("live").drop("live", "n_tokens")
        asked = self.spark.createDataFrame(queries, "query_id int, query string")
        rows = materialize(ranked.join(F.broadcast(asked), "query_id").join(texts.withColumn("_live", F.lit(True)), "chunk_id", "left").where("chunk_id IS NULL OR _live").drop("_live"), "pool").coalesce(1)
        overlap = T.overlap_ratio(T.tokens(F.col("query")), T.tokens(F.coalesce("text", F.lit(""))))
        return rows.withColumn("overlap", overlap)

    def rerank(self, queries: list[tuple[int, str]], vector: DataFrame | None = None, mode: str = "always", backend: str = "ml") -> DataFrame:
        """Candidates with all scores and final_score; a vector ranking is joined by chunk."""
        return fusion.weighted(self.pool(queries, vector, mode, backend).where("chunk_id IS NOT NULL"), self.settings.weights)

    def select(self, candidates: DataFrame) -> DataFrame:
        return lexical.top_k(candidates, self.settings.top_k, score="final_score", descending=True)

    def query(self, queries: list[tuple[int, str]], vector: DataFrame | None = None, mode: str = "fallback", backend: str = "ml") -> DataFrame:
        """The packet of each query: bullets, words, token metrics, how it was retrieved, and its text. Queries that are too long are left out."""
        fit = [(i, t) for i, t in queries if len(t.split()) <= T.QUERY_WORDS and t.count("\n") < T.QUERY_LINES]
        pool = self.pool(fit, vector, mode, backend)
        scored = fusion.weighted(pool, self.settings.weights)
        if self.settings.use_rrf:  # reciprocal ranks wherever both rankings were asked for
            scored = scored.withColumn("final_score", F.when(F.col("vector_hits") > 0, fusion.reciprocal("fts_rank", "vector_rank")).otherwise(F.col("final_score")))
        offered = scored.where("chunk_id IS NOT NULL")
        chosen = self.select(offered)
        runs = fusion.merge_runs(chosen, ["query_id", "doc_id", "source"])
        said = compress.bullets(runs, fit, self.settings.word_budget, self.settings.relevance_floor)
        spent = chosen.groupBy("query_id").agg(F.count("*").alias("selected_chunks"), F.countDistinct("source").alias("sources"), F.sum("token_estimate").alias("selected_tokens"))
        asked = pool.groupBy("query_id", "query", "fts_hits", "vector_hits", "path").agg(F.count("chunk_id").alias("pool"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("pool_tokens"))
        used = F.aggregate("bullets", F.lit(0), lambda n, b: n + T.token_estimate(b)).alias("compressed_tokens")
        packet = asked.join(spent, "query_id", "left").join(said, "query_id", "left").na.fill(0, ["selected_chunks", "sources", "selected_tokens", "words"])
        packet = packet.withColumn("bullets", F.coalesce("bullets", F.array().cast("array<string>"))).select("*", used)
        saved = F.greatest(F.lit(0), F.col("selected_tokens") - F.col("compressed_tokens"))
        spared = F.greatest(F.lit(0), F.col("pool_tokens") - F.col("compressed_tokens"))
        packet = packet.withColumn("saved_tokens", saved).withColumn("pool_saved_pct", F.coalesce(F.round(F.try_divide(100.0 * spared, F.col("pool_tokens")), 2), F.lit(0.0)))
        label = F.when(F.col("path") == "scan", backend).otherwise("disabled")
        return packet.withColumn("packet", compress.packet_text(mode, label))

    def answer(self, queries: list[tuple[int, str]], cache_path: str, now: int | None = None, **how) -> DataFrame:
        """(query_id, cache_key, hit, payload): packets as JSON, from the cache while they live there, else made and stored.

        The key covers the query, the settings, the mode and the state of the index, so a changed index misses. Entries of the asked keys only
        reach the driver."""
        now = int(time.time()) if now is None else now
        keys = {i: lifecycle.cache_key({"query": t, **asdict(self.settings), **{k: v for k, v in how.items() if isinstance(v, str)}}, self.stored.stamp) for i, t in queries}
        known = {}
        system, target = file_system(self.spark, cache_path)
        if system.exists(target):
            entries = self.spark.read.schema(_CACHE).parquet(cache_path).where(F.col("cache_key").isin(sorted(set(keys.values()))))
            known = {r.cache_key: r.payload for r in lifecycle.live_entries(entries, now).collect()}
        missing = [(i, t) for i, t in queries if keys[i] not in known]
        made = []
        if missing:
            packets = self.query(missing, **how)
            made = [(r.query_id, keys[r.query_id], r.payload) for r in packets.select("query_id", F.to_json(F.struct(*packets.columns)).alias("payload")).collect()]
            life = max(lifecycle.LEAST_TTL, self.settings.cache_ttl)
            self.spark.createDataFrame([(k, p, now, now + life) for _, k, p in made], _CACHE).coalesce(1).write.mode("append").parquet(cache_path)
        rows = [(i, keys[i], True, known[keys[i]]) for i, _ in queries if keys[i] in known] + [(i, k, False, p) for i, k, p in made]
        return self.spark.createDataFrame(rows, "query_id int, cache_key string, hit boolean, payload string")

    def with_settings(self, **changes) -> "Engine":
        return Engine(self.spark, self.documents, self.raw_chunks, self.embeddings, replace(self.settings, **changes), self.stored)


def _chunked(files: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    docs = files.withColumn("cleaned_text", T.clean_text(F.col("raw_text"))).where("cleaned_text <> ''")
    chunks = chunking.chunk_documents(docs, settings.chunk_words, settings.chunk_overlap)
    return docs, chunks.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))

