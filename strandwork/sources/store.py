"""The store: a folder of parquet tables with fixed schemas, replaced by writing anew and swapping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from strandwork.session import file_system

#: The columns of each table.
SCHEMAS = {
    "documents": "doc_id long, source string, raw_text string, cleaned_text string, created_at timestamp, updated_at timestamp, file_mtime double, file_hash string",
    "chunks": "chunk_id long, doc_id long, chunk_index int, text string, token_estimate int",
    "chunk_embeddings": "chunk_id long, embedding_json string, backend string, dimensions int, model_name string",
    "query_embeddings": "query_key string, query_text_hash string, embedding_json string, backend string, dimensions int, model_name string, created_at timestamp, updated_at timestamp",
    "query_cache": "cache_key string, payload string, created long, expires long",
    "file_dependencies": "source_file string, target_import string, resolved_file string",
    "symbol_index": "file_path string, symbol_name string, symbol_type string, chunk_id long, signature string",
}


class Store:
    """Tables below ``path``; ``open`` makes what is missing and adds columns that a table lacks, as nulls."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Store":
        store = cls(spark, path)
        for name in SCHEMAS:
            if not store._exists(name):
                spark.createDataFrame([], SCHEMAS[name]).coalesce(1).write.parquet(store._at(name))
            elif set(store.schema(name).fieldNames()) - set(spark.read.parquet(store._at(name)).columns):
                store.replace(name, store.read(name))
        return store

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(SCHEMAS[name])

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _exists(self, name: str) -> bool:
        system, target = file_system(self.spark, self._at(name))
        return system.exists(target)

    def read(self, name: str) -> DataFrame:
        """The table with the columns of its schema; files written before a column was added read as null there."""
        return self.spark.read.schema(self.schema(name)).parquet(self._at(name))

    def _fit(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(name)])

    def append(self, name: str, df: DataFrame) -> None:
        self._fit(name, df).write.mode("append").parquet(self._at(name))

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes the rows beside the table, then swaps: a reader sees the old files or the new ones, and a failed write changes nothing."""
        new, old = (f"{self._at(name)}-{x}-{uuid.uuid4().hex}" for x in ("new", "old"))
        self._fit(name, df).write.parquet(new)
        system, target = file_system(self.spark, self._at(name))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if system.exists(target):
            system.rename(target, path(old))
        system.rename(path(new), target)
        system.delete(path(old), True)

    def upsert(self, name: str, df: DataFrame, key: str) -> None:
        """Rows of ``df`` in place of those with equal keys."""
        kept = self.read(name).join(df.select(key).distinct(), key, "left_anti")
        self.replace(name, kept.select(*self.schema(name).fieldNames()).unionByName(self._fit(name, df)))

    def vacuum(self, file_bytes: int = 128 << 20) -> DataFrame:
        """Rewrites every table in files of about ``file_bytes``; (name, bytes_before, bytes_after)."""
        before = {r.name: r.bytes for r in self.sizes().collect()}
        for name in SCHEMAS:
            self.replace(name, self.read(name).coalesce(max(1, before[name] // file_bytes)))
        after = {r.name: r.bytes for r in self.sizes().collect()}
        return self.spark.createDataFrame([(n, before[n], after[n]) for n in SCHEMAS], "name string, bytes_before long, bytes_after long")

    def sizes(self) -> DataFrame:
        """(name, files, bytes) of each table on disk."""
        rows = []
        for name in SCHEMAS:
            system, target = file_system(self.spark, self._at(name))
            summary = system.getContentSummary(target)
            rows.append((name, summary.getFileCount(), summary.getLength()))
        return self.spark.createDataFrame(rows, "name string, files long, bytes long")
