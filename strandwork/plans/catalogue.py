"""The registered queries of the engine; their SQL equivalents are in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from strandwork.functions import text as T
from strandwork.operators import ann, chunking, compress, evaluation, fusion, graph, guard, lexical, lifecycle, patch, syntax, vectors
from strandwork.plans import fixtures as X
from strandwork.plans.engine import Engine
from strandwork.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.from_tables(spark, sf_dir).query(X.QUERIES)


def _docs(s, d):
    return table(s, d, "documents")


def _chunks(s, d):
    """Chunk rows, duplicate rows counted once."""
    return table(s, d, "chunks").distinct()


def token_stats(s, d):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return _docs(s, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def token_estimate(s, d):
    return _chunks(s, d).select("chunk_id", "chunk_index", T.token_estimate(F.col("text")).alias("estimate"), (T.token_estimate(F.col("text")) - F.coalesce("token_estimate", F.lit(0))).alias("off_by"))


def char_trigrams(s, d):
    words = _chunks(s, d).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return words.select("n", F.explode(T.ngrams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("places"))


def clean_text(s, d):
    c = T.clean_text(F.col("raw_text"))
    return _docs(s, d).where("raw_text IS NOT NULL").select("doc_id", c.alias("c")).select("doc_id", F.length("c").alias("n_chars"), F.md5("c").alias("digest"))


def file_flags(s, d):
    p = F.col("source")
    size = F.octet_length("raw_text").cast("long")
    return _docs(s, d).where("source IS NOT NULL").select(
        "doc_id", T.is_text_file(p).alias("is_text"), T.is_code_file(p).alias("is_code"), T.is_skipped(p, size).alias("skipped"), F.coalesce(T.is_minified(F.col("raw_text")), F.lit(False)).alias("minified")
    )


def files_to_index(s, d):
    p = F.col("source")
    rows = table(s, d, "file_listing").where("source IS NOT NULL").groupBy("source").agg(F.max_by("size_bytes", F.struct("seen_at", "mtime", "size_bytes")).alias("size_bytes"))
    inside = ~F.exists(F.split(p, "/"), lambda x: x.isin(T.SKIPPED_DIRS))
    return rows.where(inside & T.is_text_file(p) & ~T.is_skipped(p, F.col("size_bytes"))).select("source", "size_bytes", T.suffix(p).alias("suffix"))


def query_validity(s, d):
    return _docs(s, d).where("text IS NOT NULL").select("doc_id", T.validate_query(F.col("text")).alias("verdict"))


def query_terms(s, d):
    return _chunks(s, d).where("text IS NOT NULL").select("chunk_id", "chunk_index", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def sentence_split(s, d):
    x = T.sentences(F.col("text"))
    return _chunks(s, d).where("text IS NOT NULL").select("chunk_id", "chunk_index", x.alias("x")).select("chunk_id", "chunk_index", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


def trimmed_snippets(s, d):
    rows = _chunks(s, d).where("text IS NOT NULL").join(_docs(s, d).select("doc_id", "source"), "doc_id")
    return rows.select("chunk_id", "chunk_index", F.concat_ws(" ", T.trim_words(F.col("text"), 35), T.citation(F.col("source"), F.col("chunk_index"))).alias("snippet"))


def chunk_prose(s, d):
    rows = _docs(s, d).where((F.length("cleaned_text") > 0) & ~F.coalesce(T.is_code_file(F.col("source")), F.lit(False)))
    lines = F.split("cleaned_text", "\n")
    each = rows.select("doc_id", lines.alias("l")).select("doc_id", "l", F.posexplode(chunking.line_ranges(F.col("l"), 100, 20)).alias("chunk_index", "r"))
    text = F.array_join(F.slice("l", F.col("r.s") + 1, F.col("r.e") - F.col("r.s")), "\n")
    return each.select("doc_id", "chunk_index", F.col("r.s").alias("first_line"), F.col("r.e").alias("end_line"), T.token_estimate(text).alias("token_estimate"), F.md5(text).alias("digest"))


def chunk_code(s, d):
    docs = _docs(s, d).where(T.is_code_file(F.col("source")))
    return chunking.chunk_documents(docs, 100, 20).select("doc_id", "chunk_index", "token_estimate", F.md5("text").alias("digest"))


def doc_freq(s, d):
    index = Engine.from_tables(s, d).stored
    idf = F.log((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.frequencies().select("token", "df", "cf", F.round(F.when(idf > 0, idf).otherwise(lexical.FLOOR), 6).alias("idf"))


def bm25_topk(s, d):
    return lexical.top_k(Engine.from_tables(s, d).bm25(X.QUERIES), 12).select("query_id", "chunk_id", "rank", F.round("bm25", 6).alias("bm25"))


def bm25_phrase(s, d):
    return Engine.from_tables(s, d).bm25(X.PHRASE_QUERIES).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


def weighted_rerank(s, d):
    e = Engine.from_tables(s, d)
    rows = e.rerank(X.QUERIES)
    return rows.select("query_id", "chunk_id", "fts_rank", F.round("overlap", 6).alias("overlap"), F.round("fts_score", 6).alias("fts_score"), F.round("final_score", 6).alias("final_score"))


def vector_topk(s, d):
    q = vectors.latest_query(table(s, d, "query_embeddings"))
    return vectors.scan_top_k(table(s, d, "chunk_embeddings"), q, 20).select("chunk_id", "rank", F.round("score", 6).alias("score"))


def _vector_run(s, d, e, queries):
    """The latest query embedding's ranking, for every query."""
    one = e.vector(0, vectors.latest_query(table(s, d, "query_embeddings"))).drop("query_id")
    return one.withColumn("query_id", F.explode(F.array(*[F.lit(i) for i, _ in queries])))


def rrf_fusion(s, d):
    e = Engine.from_tables(s, d)
    fused = fusion.rrf(e.lexical(X.QUERIES), _vector_run(s, d, e, X.QUERIES))
    return fused.select("query_id", "chunk_id", F.coalesce("fts_rank", F.lit(0)).alias("fts_rank"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.round("rrf", 8).alias("rrf"))


def hybrid_rerank(s, d):
    """Both rankings of all queries, fused by weights: the lexical row wins, ranks and scores of the other are added."""
    e = Engine.from_tables(s, d)
    rows = e.rerank(X.QUERIES, _vector_run(s, d, e, X.QUERIES))
    return rows.select("query_id", "chunk_id", F.coalesce("fts_rank", F.lit(0)).alias("fts_rank"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.round("final_score", 6).alias("final_score"))


def adaptive_paths(s, d):
    """What becomes of the vector search of each stress query, by mode."""
    e = Engine.from_tables(s, d)
    run = _vector_run(s, d, e, X.STRESS_QUERIES)
    out = None
    for mode in ("fallback", "always"):
        rows = e.candidates(X.STRESS_QUERIES, run, mode).groupBy("query_id", "fts_hits", "vector_hits", "path").agg(F.count("chunk_id").alias("pool")).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


def hybrid_packet(s, d):
    e = Engine.from_tables(s, d)
    return e.query(X.QUERIES, _vector_run(s, d, e, X.QUERIES), mode="always").drop("words", "packet").withColumn("bullets", F.array_join("bullets", "\n"))


def packet_text(s, d):
    return flagship(s, d).select("query_id", F.md5("packet").alias("digest"), F.element_at(F.split("packet", "\n"), 1).alias("first"), F.regexp_count("packet", F.lit("(?m)^- ")).alias("said"))


def hash_embedding(s, d):
    v = vectors.hash_embeddings(_chunks(s, d), 256)
    return v.select("chunk_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def ivf_topk(s, d):
    """The 20 nearest chunk vectors of the latest query embedding's space by cosine, from the stored inverted lists."""
    q = vectors.latest_query(table(s, d, "query_embeddings"))
    same = (vectors.backend(F.col("backend")) == q["backend"].strip().lower()) & F.col("model_name").eqNullSafe(F.lit(q["model_name"])) & (F.col("dimensions") == q["dimensions"])
    rows = vectors.with_vectors(table(s, d, "chunk_embeddings").where(same)).select("chunk_id", "vector").dropDuplicates(["chunk_id"])
    e = Engine.from_tables(s, d)
    path = ann.open_or_build(rows, f"{e.stored.path}/ann/{ann.stem(s, q['backend'].strip().lower(), q['dimensions'], q['model_name'])}")
    return ann.search(s, path, q["vector"]).select("chunk_id", F.round("score", 6).alias("score"))


def kmeans_clusters(s, d):
    """Clusters of each space of comparable vectors (backend, dimensions, model)."""
    rows = vectors.with_vectors(table(s, d, "chunk_embeddings")).select("chunk_id", vectors.backend(F.col("backend")).alias("backend"), "dimensions", "model_name", "vector").dropDuplicates(["chunk_id"])
    spaces = rows.select("backend", "dimensions", "model_name").distinct().limit(65).collect()
    if len(spaces) > 64:
        raise ValueError("more than 64 spaces of vectors")
    out = None
    for b, n, m in spaces:
        some = rows.where((F.col("backend") == b) & (F.col("dimensions") == n) & F.col("model_name").eqNullSafe(F.lit(m)))
        one = vectors.kmeans_clusters(some.select("chunk_id", "vector"), 20).withColumn("space", F.lit(f"{b}/{n}/{m}"))
        out = one if out is None else out.unionByName(one)
    return out


def sentence_jaccard(s, d):
    prose = _prose(s, d)
    return compress.sentence_pairs(prose, "chunk_id").select("chunk_id", "i", "j", F.round("jaccard", 6).alias("jaccard"))


def _prose(s, d):
    code = T.is_code_file(F.col("source"))
    rows = _chunks(s, d).join(_docs(s, d).where(~code).select("doc_id"), "doc_id", "left_semi")
    return rows.dropDuplicates(["chunk_id"])


def sentence_pick(s, d):
    """The summary of every prose chunk for every query."""
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("query")) for i, q in X.QUERIES]))
    rows = _prose(s, d).withColumn("q", asked).select("text", "q.query", F.concat_ws(":", "q.query_id", "chunk_id").alias("key"))
    return compress.pick_sentences(compress.sentence_scores(rows, key="key"), 2, "key").select("key", F.md5("summary").alias("digest"))


def code_signatures(s, d):
    rows = _docs(s, d).where(T.is_code_file(F.col("source")) & F.col("text").isNotNull())
    x = compress.signatures(F.col("text"))
    return rows.select("doc_id", x.alias("x")).select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


def merge_runs(s, d):
    e = Engine.from_tables(s, d)
    rows = e.sources().where("text IS NOT NULL").withColumn("final_score", F.col("chunk_index").cast("double"))
    m = fusion.merge_runs(rows, ["doc_id", "source"])
    return m.select("doc_id", "first_index", "merged", "chunk_id", F.coalesce("token_estimate", F.lit(0)).alias("token_estimate"), "final_score", F.md5("text").alias("digest"))


def budget_pack(s, d):
    rows = _chunks(s, d).where("text IS NOT NULL").dropDuplicates(["chunk_id"])
    packed = compress.pack_bullets(rows.select("doc_id", F.col("chunk_index").alias("rank"), F.col("text").alias("bullet")), 150, "doc_id")
    return packed.select("doc_id", F.size("bullets").alias("kept"), "words", F.md5(F.array_join("bullets", "|")).alias("digest"))


def context_packet(s, d):
    return flagship(s, d).select("query_id", F.array_join("bullets", "\n").alias("bullets"), "compressed_tokens", "selected_tokens", "pool_tokens", "saved_tokens", "pool_saved_pct")


def token_savings(s, d):
    docs = _docs(s, d).groupBy("lang").agg(F.sum(T.token_estimate(F.col("raw_text")).cast("long")).alias("raw"), F.sum(T.token_estimate(F.col("cleaned_text")).cast("long")).alias("clean"))
    return docs.select("lang", "raw", "clean", *evaluation.savings(F.col("raw"), F.col("clean")))


def upsert_documents(s, d):
    """The latest row of each path replaces the stale ones."""
    docs = _docs(s, d).where("source IS NOT NULL")
    order = [F.desc(F.coalesce("updated_at", "created_at")), F.desc("doc_id")]
    return lifecycle.latest(docs, ["source"], order).select("source", "doc_id", F.coalesce(F.length("cleaned_text"), F.lit(-1)).alias("n_clean"))


def sync_diff(s, d):
    return lifecycle.sync_status(table(s, d, "file_listing"), _docs(s, d))


def sync_counts(s, d):
    return sync_diff(s, d).groupBy("status").agg(F.count("*").alias("n"))


def gc_counts(s, d):
    return lifecycle.gc_counts(_docs(s, d), _chunks(s, d), table(s, d, "chunk_embeddings").distinct(), table(s, d, "file_dependencies").distinct())


def gc_result(s, d):
    live = table(s, d, "chunk_embeddings").distinct().join(_chunks(s, d).select("chunk_id").distinct(), "chunk_id", "left_semi")
    return live.groupBy(vectors.backend(F.col("backend")).alias("backend")).agg(F.count("*").alias("kept"))


def remove_deleted(s, d):
    """Counts by table after removing what the sync calls deleted."""
    gone = sync_diff(s, d).where("status = 'deleted'").select("source")
    names = ("documents", "chunks", "chunk_embeddings", "file_dependencies")
    return lifecycle.index_stats(lifecycle.remove_documents({n: table(s, d, n).distinct() for n in names}, gone))


def index_stats(s, d):
    names = ("documents", "chunks", "chunk_embeddings", "query_embeddings", "file_dependencies")
    return lifecycle.index_stats({n: table(s, d, n).distinct() for n in names})


def query_costs(s, d):
    docs = _docs(s, d).groupBy("lang").agg(F.sum(T.token_estimate(F.col("raw_text")).cast("long")).alias("raw"), F.sum(T.token_estimate(F.col("cleaned_text")).cast("long")).alias("clean"))
    return docs.select("lang", *evaluation.costs(F.col("raw"), F.col("clean")))


def model_slugs(s, d):
    return table(s, d, "chunk_embeddings").select("backend", "model_name", "dimensions").distinct().select("dimensions", lifecycle.slug(F.coalesce("backend", F.lit(""))).alias("backend"), lifecycle.slug(F.coalesce("model_name", F.lit("none"))).alias("model")).distinct()


def time_range(s, d):
    return _docs(s, d).agg(F.unix_micros(F.min("created_at")).alias("first"), F.unix_micros(F.max("updated_at")).alias("last"), F.count("*").alias("n"))


def backend_counts(s, d):
    return table(s, d, "chunk_embeddings").distinct().groupBy(vectors.backend(F.col("backend")).alias("backend"), "dimensions").agg(F.count("*").alias("n"))


def query_cache(s, d):
    """Query embeddings as cache entries of 900 seconds, as of a day after the newest entry minus a year."""
    rows = table(s, d, "query_embeddings").where("query_key IS NOT NULL AND created_at IS NOT NULL")
    created = F.unix_seconds("created_at")
    cache = rows.select(F.col("query_key").alias("cache_key"), F.coalesce("query_text_hash", F.lit("")).alias("payload"), created.alias("created"), lifecycle.expires_at(created, 86_400 * 365).alias("expires")).distinct()
    now = rows.agg(F.max(created)).first()[0] - 86_400
    return lifecycle.live_entries(cache, int(now))


def query_embedding_cache(s, d):
    rows = table(s, d, "query_embeddings").where("query_key IS NOT NULL").distinct()
    order = [F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.desc_nulls_last("embedding_json")]
    return lifecycle.latest(rows, ["query_key"], order).select("query_key", vectors.backend(F.col("backend")).alias("backend"), "dimensions", F.length("embedding_json").alias("n_json"))


def session_recent(s, d):
    ev = table(s, d, "events")
    out = lifecycle.session_memory(ev, "user_id", "event_type", [F.desc("ts"), F.desc("event_id")], lifecycle.RECENT_QUERIES)
    return out.select("user_id", F.array_join("recent", ",").alias("recent"))


def session_sources(s, d):
    """The last 12 distinct event types and props of each user."""
    ev = table(s, d, "events").withColumn("item", F.concat_ws(":", "event_type", "props"))
    last = ev.groupBy("user_id", "item").agg(F.max("ts").alias("ts"))
    out = lifecycle.session_memory(last, "user_id", "item", [F.desc("ts"), F.desc("item")], lifecycle.RECENT_SOURCES)
    return out.select("user_id", F.array_join("recent", ",").alias("recent"))


def turn_reminders(s, d):
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(s, d, "events").select("user_id", "event_id", turn.alias("turn"))
    return rows.withColumn("reminder", guard.reminder(F.col("turn"))).where("reminder IS NOT NULL")


def prompt_guard(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", guard.classify(t, F.coalesce(F.contains(t, F.lit("corekit.telemetry")), F.lit(False))).alias("verdict"))


def prompt_fields(s, d):
    return table(s, d, "events").select("event_id", guard.json_field(F.col("props"), ["prompt", "text", "k"]).alias("field"))


def _judged(s, d):
    rows = Engine.from_tables(s, d).lexical(X.JUDGED_QUERIES).join(_chunks(s, d).dropDuplicates(["chunk_id"]).select("chunk_id", "text"), "chunk_id")
    return rows.join(F.broadcast(s.createDataFrame(X.JUDGED, "query_id int, relevant array<string>, irrelevant array<string>")), "query_id")


def retrieval_quality(s, d):
    r = evaluation.judged(_judged(s, d), 5)
    cols = [F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")]
    return r.select("query_id", *cols, evaluation.quality(F.col("precision"), F.col("recall")).alias("quality"))


def latency_percentiles(s, d):
    p = evaluation.percentiles(table(s, d, "events"), ["event_type"], "value")
    return p.select("event_type", "n", F.round("mean", 4).alias("mean"), "least", "most", "p50", "p95", "p99")


def code_imports(s, d):
    return graph.import_edges(_docs(s, d))


def import_resolution(s, d):
    return graph.resolve_imports(graph.import_edges(_docs(s, d)), _docs(s, d))


def known_dependencies(s, d):
    """New edges that the dependency table lacks, by language suffix."""
    known = table(s, d, "file_dependencies").select("source_file", "target_import").distinct()
    new = graph.import_edges(_docs(s, d)).join(known, ["source_file", "target_import"], "left_anti")
    return new.groupBy(T.suffix(F.col("source_file")).alias("suffix")).agg(F.count("*").alias("n"))


def imported_files(s, d):
    return table(s, d, "file_dependencies").where("resolved_file IS NOT NULL").select("source_file", "resolved_file").distinct()


def import_fan_in(s, d):
    return table(s, d, "file_dependencies").groupBy("target_import").agg(F.countDistinct("source_file").alias("files"), F.count("resolved_file").alias("resolved"))


def code_calls(s, d):
    rows = _docs(s, d).where(T.is_code_file(F.col("source")) & F.col("text").isNotNull())
    return rows.select("doc_id", F.explode(graph.calls(F.col("text"))).alias("name"))


def code_symbols(s, d):
    return graph.symbol_index(Engine.from_tables(s, d).sources())


def symbol_lookup(s, d):
    """Up to three definitions of each symbol name."""
    order = Window.partitionBy("symbol_name").orderBy("chunk_id", "file_path", "symbol_type", "signature")
    rows = code_symbols(s, d).withColumn("n", F.row_number().over(order)).where("n <= 3")
    return rows.select("symbol_name", "n", "file_path", "chunk_id")


def two_hop(s, d):
    e = Engine.from_tables(s, d)
    top = e.lexical(X.QUERIES).join(e.sources().select("chunk_id", "text"), "chunk_id")
    return graph.two_hop(top, code_symbols(s, d), e.chunks).select("query_id", "name", "file_path", "chunk_id", F.md5("definition").alias("digest"))


def imported_context(s, d):
    """For files that the selected chunks import, their two best chunks for the query."""
    e = Engine.from_tables(s, d)
    scored = e.bm25(X.QUERIES).where("live").drop("live").join(e.sources().select("chunk_id", "source"), "chunk_id")
    chosen = lexical.top_k(scored, 12).select("query_id", "source").distinct()
    edges = imported_files(s, d).withColumnRenamed("source_file", "source")
    targets = chosen.join(edges, "source").select("query_id", F.col("resolved_file").alias("source")).distinct().join(chosen, ["query_id", "source"], "left_anti")
    near = scored.join(targets, ["query_id", "source"])
    order = Window.partitionBy("query_id", "source").orderBy("bm25", "chunk_id")
    return near.withColumn("n", F.row_number().over(order)).where("n <= 2").select("query_id", "source", "chunk_id", "n", F.round("bm25", 6).alias("bm25"))


def patch_files(s, d):
    """Every text with a block that replaces its first line, in one transaction a file: it fails where that line is not unique."""
    rows = _docs(s, d).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    first = F.substring_index("content", "\n", 1)
    block = F.concat(F.lit("<<<<<<< SEARCH\n"), first, F.lit("\n=======\n"), F.lit("patched"), F.lit("\n>>>>>>> REPLACE\n"))
    plain = rows.where(~F.contains(first, F.lit("\r")) & ~first.rlike("^(<{5,}|={5,}|>{5,}|@@)"))
    out = patch.apply_patches(plain, plain.select("file", block.alias("patch")))
    return out.select("file", "applied", "failed", F.md5("content").alias("digest"))


def tree_segments(s, d):
    """Python sources by their outermost definitions."""
    rows = _docs(s, d).where("text IS NOT NULL").select("doc_id", syntax.segment_column(F.col("text"), T.suffix(F.col("source")) == ".py").alias("x")).where("size(x) > 0")
    return rows.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


def chunk_trees(s, d):
    docs = _docs(s, d).where(T.suffix(F.col("source")) == ".py")
    return chunking.chunk_documents(docs, 100, 20, text="text", trees=True).select("doc_id", "chunk_index", "token_estimate", F.md5("text").alias("digest"))


def upserted_index(s, d):
    """Tables after every path's latest row replaced the stale ones: (name, rows), the chunks cut anew."""
    docs = _docs(s, d).where("source IS NOT NULL")
    new = lifecycle.latest(docs, ["source"], [F.desc(F.coalesce("updated_at", "created_at")), F.desc("doc_id")]).select("doc_id", "source", "raw_text")
    e = Engine(s, docs.select("doc_id", "source", "raw_text", "cleaned_text"), _chunks(s, d)).upsert(new)
    dead = e.raw_chunks.join(e.documents.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "orphan")
    return lifecycle.index_stats({"documents": e.documents, "indexed": e.raw_chunks.join(new.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct(), "orphans": dead})


def queries() -> dict:
    names = (
        "token_stats token_estimate char_trigrams clean_text file_flags files_to_index query_validity query_terms sentence_split trimmed_snippets chunk_prose chunk_code doc_freq bm25_topk bm25_phrase "
        "weighted_rerank hybrid_rerank adaptive_paths packet_text query_costs model_slugs tree_segments chunk_trees upserted_index vector_topk rrf_fusion hybrid_packet hash_embedding ivf_topk kmeans_clusters sentence_jaccard sentence_pick code_signatures merge_runs budget_pack context_packet token_savings upsert_documents "
        "sync_diff sync_counts gc_counts gc_result remove_deleted index_stats time_range backend_counts query_cache query_embedding_cache session_recent session_sources turn_reminders prompt_guard prompt_fields "
        "retrieval_quality latency_percentiles code_imports import_resolution known_dependencies imported_files import_fan_in code_calls code_symbols symbol_lookup two_hop imported_context patch_files"
    )
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict:
    from strandwork.plans import oracles

    return oracles.oracle_sql()
