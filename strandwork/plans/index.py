"""The stored index: chunks with their sources, an inverted index in buckets by token, one row of statistics."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.functions import text as T
from strandwork.operators import lexical
from strandwork.session import file_system, shared_dir

#: Raised when the tables of an index change, so that one of an older layout is not opened.
LAYOUT = 1
_BUILT: dict[tuple[str, str], "Index"] = {}


def buckets_for(chunks: int) -> int:
    """Buckets of the inverted index: one for about 20,000 chunks."""
    return min(4096, max(8, chunks // 20_000))


@dataclass(frozen=True)
class Index:
    """chunks (chunk_id, doc_id, chunk_index, text, token_estimate, source, live, n_tokens), sorted by chunk_id; postings (token, chunk_id, pos, n_tokens,
    live) in folders by bucket, sorted by token. Duplicate chunk rows count once; live: whether the chunk's document is there."""

    spark: SparkSession
    path: str
    n: int
    mean: float
    buckets: int
    stamp: str

    @classmethod
    def build(cls, documents: DataFrame, chunks: DataFrame, path: str) -> "Index":
        """Two shuffles: the chunks by id, for duplicates and order; the postings by bucket."""
        spark = chunks.sparkSession
        owners = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("source").alias("source"), F.lit(True).alias("live"))
        once = chunks.select("chunk_id", "doc_id", "chunk_index", "text", "token_estimate").repartitionByRange("chunk_id").dropDuplicates(["chunk_id"])
        size = F.coalesce(F.size(T.index_tokens(F.col("text"))), F.lit(0)).alias("n_tokens")
        once = once.join(owners, "doc_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
        once.select("chunk_id", "doc_id", "chunk_index", "text", "token_estimate", "source", "live", size).sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{path}/chunks")
        stored = spark.read.parquet(f"{path}/chunks")
        content = F.sum(F.xxhash64("chunk_id", "text", "source").cast("decimal(38,0)")).cast("string")
        row = stored.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), F.coalesce(content, F.lit("")).alias("content")).first()
        buckets = buckets_for(row.n)
        each = stored.select("chunk_id", "n_tokens", "live", F.posexplode(T.index_tokens(F.col("text"))).alias("pos", "token"))
        each = each.withColumn("bucket", F.pmod(F.crc32("token"), F.lit(buckets)).cast("int"))
        each = each.repartition(buckets, "bucket").sortWithinPartitions("bucket", "token", "chunk_id", "pos")
        each.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        stats = {"n": row.n, "mean": row.mean or 0.0, "buckets": buckets, "stamp": f"{row.n}|{row.content}"}
        spark.createDataFrame([(json.dumps(stats),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")
        return cls(spark, path, **stats)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Index | None":
        """The index stored at a path, or None if there is none or it was not finished."""
        system, target = file_system(spark, f"{path}/stats/_SUCCESS")
        if not system.exists(target):
            return None
        return cls(spark, path, **json.loads(spark.read.text(f"{path}/stats").first()[0]))

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str, documents: DataFrame, chunks: DataFrame) -> "Index":
        """The index of a data directory: built at first use in the shared folder, opened as long as the files of its tables are the same."""
        parts = []
        for name in ("documents", "chunks"):
            system, target = file_system(spark, f"{sf_dir}/{name}.parquet")
            files = system.listFiles(target, True)
            while files.hasNext():
                f = files.next()
                parts.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        key = f"{zlib.crc32(chr(10).join(sorted(parts)).encode()):08x}-{len(parts)}"
        path = f"{shared_dir(spark)}/strandwork/index-{LAYOUT}-{key}"
        known = (spark.sparkContext.applicationId, path)
        system, done = file_system(spark, f"{path}/stats/_SUCCESS")
        if known not in _BUILT or not system.exists(done):
            _BUILT[known] = cls.open(spark, path) or cls.build(documents, chunks, path)
        return _BUILT[known]

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def texts(self, ids: list) -> DataFrame:
        """The chunks with these ids (a top-k); the filter reaches the scan, whose files are sorted by id."""
        return self.chunks().where(F.col("chunk_id").isin(ids))

    def hits(self, phrases: list[str]) -> DataFrame:
        """(chunk_id, phrase, tf, len, live) of the chunks that hold a phrase; reads the buckets of its words only."""
        words = [(w, p, i, len(p.split())) for p in sorted(set(phrases)) for i, w in enumerate(p.split())]
        tokens = sorted({w[0] for w in words})
        at = sorted({zlib.crc32(t.encode()) % self.buckets for t in tokens})
        rows = self.postings().where(F.col("bucket").isin(at) & F.col("token").isin(tokens))
        asked = F.broadcast(self.spark.createDataFrame(words, "token string, phrase string, ordinal int, words int"))
        each = rows.join(asked, "token").withColumn("start", F.col("pos") - F.col("ordinal"))
        one = each.where("words = 1").select("chunk_id", "phrase", "n_tokens", "live")
        if any(w[3] > 1 for w in words):
            more = each.where("words > 1").groupBy("chunk_id", "phrase", "start", "n_tokens", "live", "words").agg(F.count("*").alias("met")).where("met = words")
            one = one.unionByName(more.select("chunk_id", "phrase", "n_tokens", "live"))
        return one.groupBy("chunk_id", "phrase").agg(F.count("*").alias("tf"), F.first("n_tokens").alias("len"), F.first("live").alias("live"))

    def bm25(self, queries: list[tuple[int, str]]) -> DataFrame:
        """(query_id, chunk_id, bm25, live) of every chunk with a phrase of the query; smaller is better."""
        phrases = sorted({p for _, q in queries for p in lexical.phrase_terms(q)})
        if not phrases or not self.n:
            kind = self.chunks().schema["chunk_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id int, chunk_id {kind}, bm25 double, live boolean")
        return lexical.score_hits(self.hits(phrases), queries, self.n, self.mean, ["live"])

    def frequencies(self) -> DataFrame:
        """(token, df, cf) of every index token; a bucket holds whole tokens."""
        return self.postings().groupBy("token", "chunk_id").agg(F.count("*").alias("tf")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
