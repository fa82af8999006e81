"""python -m strandwork COMMAND: index, query, run, compress-raw, sync, gc, stats, patch, guard, benchmark over a store of parquet tables."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.functions import text as T
from strandwork.operators import evaluation, guard, lifecycle, patch
from strandwork.plans import fixtures
from strandwork.plans.engine import Engine
from strandwork.sources import files, settings
from strandwork.session import materialize
from strandwork.sources.store import Store

#: Words of a prompt that stand in for its query, words a prompt is cut to, and the budget of raw compression.
QUERY_WORDS, CUT_WORDS, RAW_BUDGET = 50, 800, 500


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("strandwork").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _read(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """Document rows (doc_id, source, raw_text, file_mtime) of files and folders; each path once."""
    out = None
    for path in inputs:
        one = files.read_files(spark, path)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["source"]).withColumn("doc_id", F.xxhash64("source"))


def open_engine(store: Store, config: settings.Settings) -> Engine:
    return Engine(store.spark, store.read("documents"), store.read("chunks"), store.read("chunk_embeddings"), config)


def index(store: Store, inputs: list[str], config: settings.Settings) -> dict | None:
    """Replaces the documents of these paths and what rests on them; None if there is no file."""
    rows = _read(store.spark, inputs)
    if rows.isEmpty():
        return None
    now = F.current_timestamp()
    engine = open_engine(store, config).upsert(rows.withColumn("created_at", now).withColumn("updated_at", now).withColumn("file_hash", F.md5("raw_text")))
    for name, df in (("documents", engine.documents), ("chunks", engine.raw_chunks), ("chunk_embeddings", engine.embeddings)):
        store.replace(name, df)  # the engine's tables are written apart from the store
    return {r.name: r.rows for r in lifecycle.index_stats({n: store.read(n) for n in ("documents", "chunks", "chunk_embeddings")}).collect()}


def query(engine: Engine, text: str, cache: str | None = None) -> dict | None:
    """The packet of one query as a dictionary; None for an invalid query."""
    if len(text.split()) > T.QUERY_WORDS or text.count("\n") >= T.QUERY_LINES:
        return None
    if cache:
        row = engine.answer([(0, text)], cache).first()
        packet = json.loads(row.payload) | {"cache": {"hit": row.hit, "key": row.cache_key}}
    else:
        row = engine.query([(0, text)]).select(F.to_json(F.struct("*")).alias("x")).first()
        packet = json.loads(row.x)
    metrics = {k: packet.pop(k) for k in ("compressed_tokens", "selected_tokens", "pool_tokens", "saved_tokens", "pool_saved_pct", "words")}
    how = {k: packet.pop(k) for k in ("fts_hits", "vector_hits", "path", "pool")}
    return packet | {"token_metrics": metrics, "retrieval": how}


def compress_raw(spark: SparkSession, text: str, asked: str | None, budget: int = RAW_BUDGET) -> dict | None:
    asked = asked or " ".join(text.split()[:QUERY_WORDS])
    rows = files.prompt_source(spark, text)
    return query(Engine.index(spark, rows, settings.replace(settings.Settings(), word_budget=budget)), asked)


def guard_prompt(spark: SparkSession, payload: str, turn: int) -> dict:
    """What to do with the prompt of a payload: verdict, the compressed or cut prompt, the reminder of the turn."""
    row = spark.createDataFrame([(payload, turn)], "payload string, turn int").select(guard.prompt_of(F.col("payload")).alias("prompt"), guard.session_of(F.col("payload")).alias("session"), "turn")
    row = row.select("*", guard.classify(F.col("prompt"), F.lit(False)).alias("verdict"), guard.reminder(F.col("turn")).alias("reminder")).first()
    out = {"session": row.session, "verdict": row.verdict, "reminder": row.reminder, "rejectInput": row.verdict == "reject"}
    if row.verdict == "compress":
        found = compress_raw(spark, row.prompt, None, 600)
        out["transformedPrompt"] = found["packet"] if found and found["bullets"] else " ".join(row.prompt.split()[:CUT_WORDS])
    return out


def sync(store: Store, inputs: list[str], config: settings.Settings) -> dict:
    """Indexes new and modified files and removes what is gone; counts by status."""
    disk = _read(store.spark, inputs)
    status = lifecycle.sync_status(disk.select("source", F.col("file_mtime").alias("mtime")), store.read("documents"))
    rows = {(r.source): r.status for r in status.where("status <> 'unchanged'").collect()}
    changed = [s for s, x in rows.items() if x in ("new", "modified")]
    gone = [s for s, x in rows.items() if x == "deleted"]
    if gone:
        dead = store.spark.createDataFrame([(s,) for s in gone], "source string")
        names = ("documents", "chunks", "chunk_embeddings", "file_dependencies")
        left = {n: materialize(df, n) for n, df in lifecycle.remove_documents({n: store.read(n) for n in names}, dead).items()}
        for name, df in left.items():
            store.replace(name, df)
    if changed:
        index(store, [s.removeprefix("file:") for s in changed], config)
    return {x: sum(v == x for v in rows.values()) for x in ("new", "modified", "deleted")}


def collect_garbage(store: Store, dry_run: bool) -> dict:
    d, c, e, f = (store.read(n) for n in ("documents", "chunks", "chunk_embeddings", "file_dependencies"))
    counts = {r.kind: r.orphans for r in lifecycle.gc_counts(d, c, e, f).collect()}
    if not dry_run:
        store.replace("chunks", c.join(d.select("doc_id").distinct(), "doc_id", "left_semi"))
        store.replace("chunk_embeddings", e.join(store.read("chunks").select("chunk_id").distinct(), "chunk_id", "left_semi"))
        store.replace("file_dependencies", f.join(d.select(F.col("source").alias("source_file")).distinct(), "source_file", "left_semi"))
        store.replace("query_cache", store.read("query_cache").where(F.col("expires") > int(time.time())))
    return counts


def benchmark(engine: Engine, judged=fixtures.JUDGMENTS, stress=fixtures.STRESS) -> dict:
    """The report over judged and stress queries, asked one after another as a user would."""
    spark, rows, times = engine.spark, [], []
    began = time.time()
    engine.stored
    index_ms = 1000 * (time.time() - began)
    asked = [q for q, _, _ in judged] + list(stress)
    for i, q in enumerate(asked):
        began = time.time()
        rows += engine.query([(i, q)]).select("query_id", "selected_tokens", "compressed_tokens", "pool_tokens").collect()
        times.append((1000 * (time.time() - began),))
    packets = spark.createDataFrame(rows, "query_id int, selected_tokens long, compressed_tokens int, pool_tokens long")
    found = engine.lexical([(i, q) for i, (q, _, _) in enumerate(judged)]).join(engine.chunks.select("chunk_id", "text"), "chunk_id")
    labels = spark.createDataFrame([(i, r, x) for i, (_, r, x) in enumerate(judged)], "query_id int, relevant array<string>, irrelevant array<string>")
    quality = evaluation.judged(found.join(F.broadcast(labels), "query_id"), 5)
    baseline = engine.documents.agg(F.coalesce(F.sum(T.token_estimate(F.col("raw_text")).cast("long")), F.lit(0))).first()[0]
    return evaluation.report(packets, quality, spark.createDataFrame(times, "ms double"), baseline, index_ms)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strandwork")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *options):
        one = sub.add_parser(name)
        for o in options:
            one.add_argument(o.rstrip("*!"), **({"nargs": "+", "required": True} if o.endswith("*") else {"action": "store_true"} if o.endswith("!") else {}))

    command("index", "--store", "--inputs*", "--settings")
    command("query", "--store", "--query", "--settings", "--json!", "--no-cache!")
    command("run", "--store", "--inputs*", "--query", "--settings", "--json!")
    command("compress-raw", "--query", "--json!")
    command("sync", "--store", "--inputs*", "--settings")
    command("gc", "--store", "--dry-run!", "--vacuum!")
    command("stats", "--store")
    command("patch", "--input", "--file", "--dir", "--dry-run!")
    command("guard", "--turn")
    command("benchmark", "--store", "--settings", "--markdown!")
    a = p.parse_args(argv)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if a.command == "patch":
        text = Path(a.input).read_text(encoding="utf-8") if a.input else sys.stdin.read()
        out = patch.apply_to_folder(text, Path(a.dir or "."), a.file, a.dry_run)
        show(out)
        return 1 if out["failed"] else 0
    spark = _session()
    if a.command == "guard":
        show(guard_prompt(spark, sys.stdin.read(), int(a.turn or 1)))
        return 0
    if a.command == "compress-raw":
        packet = compress_raw(spark, sys.stdin.read(), a.query)
    else:
        config = settings.load(*([a.settings] if getattr(a, "settings", None) else []))
        store = Store.open(spark, a.store)
        if a.command in ("index", "run"):
            stats = index(store, a.inputs, config)
            if stats is None:
                print("no files", file=sys.stderr)
                return 1
            if a.command == "index":
                show(stats)
                return 0
        elif a.command == "sync":
            show(sync(store, a.inputs, config))
            return 0
        elif a.command == "gc":
            show(collect_garbage(store, a.dry_run))
            if a.vacuum and not a.dry_run:
                store.vacuum()
            return 0
        elif a.command == "stats":
            rows = lifecycle.index_stats({n: store.read(n) for n in ("documents", "chunks", "chunk_embeddings", "query_cache", "query_embeddings", "file_dependencies", "symbol_index")})
            show({"rows": {r.name: r.rows for r in rows.collect()}, "bytes": {r.name: r.bytes for r in store.sizes().collect()}})
            return 0
        elif a.command == "benchmark":
            found = benchmark(open_engine(store, config))
            print(evaluation.report_markdown(found)) if a.markdown else show(found)
            return 0
        packet = query(open_engine(store, config), a.query or "", None if getattr(a, "no_cache", False) else f"{store.path}/query_cache")
    if packet is None:
        print("invalid query", file=sys.stderr)
        return 2
    show(packet) if a.json else print(packet["packet"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
