"""Change detection, upserts, removal, garbage, counts, caches and session memory over plain tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

LEAST_TTL, RECENT_QUERIES, RECENT_SOURCES = 30, 8, 12


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order (last write wins); nulls in the key are a key of their own."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with equal keys; null keys match nothing."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def sync_status(listing: DataFrame, index: DataFrame) -> DataFrame:
    """(source, status): new, modified (the disk's time is later, or the index has none), unchanged, deleted.

    Both sides count the latest row of a path: the listing's largest time, the index's largest time."""
    disk = listing.where("source IS NOT NULL").groupBy("source").agg(F.max("mtime").alias("disk"))
    known = index.where("source IS NOT NULL").groupBy("source").agg(F.max("file_mtime").alias("known"), F.lit(1).alias("there"))
    joined = disk.withColumn("seen", F.lit(1)).join(known, "source", "full_outer")
    status = (
        F.when(F.col("there").isNull(), "new")
        .when(F.col("seen").isNull(), "deleted")
        .when(F.col("known").isNull() | (F.col("disk") > F.col("known")), "modified")
        .otherwise("unchanged")
    )
    return joined.select("source", status.alias("status"))


def remove_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """documents, chunks, chunk_embeddings and file_dependencies without the sources in ``gone`` (source)."""
    docs = tables["documents"]
    dead = docs.join(gone, "source", "left_semi").select("doc_id")
    chunks = tables["chunks"].join(dead, "doc_id", "left_anti")
    return tables | {
        "documents": docs.join(gone, "source", "left_anti"),
        "chunks": chunks,
        "chunk_embeddings": tables["chunk_embeddings"].join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi"),
        "file_dependencies": tables["file_dependencies"].join(gone.withColumnRenamed("source", "source_file"), "source_file", "left_anti"),
    }


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key no row of ``parent`` has; a null key is an orphan."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def gc_counts(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(kind, orphans) of chunks without documents, embeddings without chunks, dependencies without sources or with dead targets."""
    count = lambda df, kind: df.agg(F.count("*").alias("orphans")).select(F.lit(kind).alias("kind"), "orphans")
    dead = orphans(dependencies.where("resolved_file IS NOT NULL"), "resolved_file", documents, "source")
    return (
        count(orphans(chunks, "doc_id", documents, "doc_id"), "chunks")
        .unionByName(count(orphans(embeddings, "chunk_id", chunks, "chunk_id"), "chunk_embeddings"))
        .unionByName(count(orphans(dependencies, "source_file", documents, "source"), "file_dependencies"))
        .unionByName(count(dead, "resolved_files"))
    )


def index_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(documents: DataFrame, chunks: DataFrame) -> str:
    """BLAKE2b-128 of the numbers of documents and chunks and the last update."""
    d = documents.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("updated_at").cast("string")), F.lit("")).alias("t")).first()
    return hashlib.blake2b(f"{d.n}|{chunks.count()}|{d.t}".encode(), digest_size=16).hexdigest()


def slug(value: Column) -> Column:
    """A name fit for a file: other characters than letters, digits and ._- become one _, at most 120; 'default' for an empty one."""
    clean = F.substring(F.regexp_replace(F.trim(value), r"[^a-zA-Z0-9._-]+", "_"), 1, 120)
    return F.when(clean == "", "default").otherwise(clean)


def embedding_key(text: str, backend: str, model: str | None, dimensions: int) -> str:
    """The key of a cached vector."""
    return f"{backend}|{model or ''}|{dimensions}|{hashlib.blake2b(text.encode(), digest_size=16).hexdigest()}"


def cache_key(knobs: dict, stamp: str) -> str:
    return hashlib.blake2b(json.dumps(knobs | {"fingerprint": stamp}, sort_keys=True).encode(), digest_size=16).hexdigest()


def expires_at(created: Column, ttl: int) -> Column:
    """Entries live for at least half a minute."""
    return created + max(LEAST_TTL, ttl)


def live_entries(cache: DataFrame, now: Column | int) -> DataFrame:
    """The last entry of each key among those that expire after ``now``; (cache_key, payload, created, expires)."""
    now = F.lit(now) if isinstance(now, int) else now
    return latest(cache.where(F.col("expires") > now), ["cache_key"], [F.desc("created"), "payload"])


def session_memory(events: DataFrame, session: str, item: str, order: list, most: int) -> DataFrame:
    """(session, recent): the last ``most`` items of each session, oldest first."""
    last = events.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col("_n") <= most)
    return last.groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(item).alias("x")))), lambda s: s["x"]).alias("recent"))
