"""BM25 over chunks: terms and phrases, counted where the text is read, so that only hits are shuffled."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from strandwork.functions import text as T

K1, B, FLOOR = 1.2, 0.75, 1e-6


def phrase_terms(query: str) -> list[str]:
    """The query's first terms as phrases of index tokens ('foo_bar' is the phrase 'foo bar'); duplicates stay."""
    terms = re.findall("[a-z0-9_]+", query.lower())[: T.QUERY_TERMS]
    return [p for p in (" ".join(t.replace("_", " ").split()) for t in terms) if p]


def query_phrases(spark, queries: list[tuple[int, str]]) -> DataFrame:
    """(query_id, ordinal, phrase): one row per term, a handful per query."""
    rows = [(q, i, p) for q, text in queries for i, p in enumerate(phrase_terms(text))]
    return spark.createDataFrame(rows, "query_id int, ordinal int, phrase string")


def document_frequencies(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(token, df, cf): documents and occurrences of each index token."""
    each = chunks.select(key, F.explode(T.index_tokens(F.col(text))).alias("token"))
    return each.groupBy("token", key).agg(F.count("*").alias("tf")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(chunks: DataFrame, text: str = "text") -> tuple[int, float]:
    """(number of chunks, mean number of index tokens); a null text has no tokens."""
    size = F.coalesce(F.size(T.index_tokens(F.col(text))), F.lit(0))
    row = chunks.agg(F.count("*").alias("n"), F.avg(size).alias("a")).first()
    return row.n, row.a or 0.0


def phrase_hits(chunks: DataFrame, phrases: list[str], key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, phrase, tf, len) for chunks that hold a phrase; one projection, the phrases are a literal."""
    toks = T.index_tokens(F.col(text))
    parts = [p.split(" ") for p in sorted(set(phrases))]

    def count(p: list[str]):
        if len(p) == 1:
            return F.size(F.filter("toks", lambda t: t == p[0]))
        want = F.array(*map(F.lit, p))
        starts = F.filter(F.transform("toks", lambda t, i: F.when(t == p[0], i)), lambda i: i.isNotNull())
        return F.size(F.filter(starts, lambda i: F.slice("toks", i + 1, len(p)) == want))

    words = sorted({w for p in parts for w in p})
    some = chunks.select(key, toks.alias("toks")).where(F.arrays_overlap("toks", F.array(*map(F.lit, words))))
    found = F.array(*[F.struct(F.lit(" ".join(p)).alias("phrase"), count(p).alias("tf")) for p in parts])
    each = some.select(key, F.size("toks").alias("len"), F.explode(F.filter(found, lambda s: s["tf"] > 0)).alias("s"))
    return each.select(key, "s.phrase", "s.tf", "len")


def bm25_scores(chunks: DataFrame, queries: list[tuple[int, str]], key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(query_id, key, bm25) of every chunk with a phrase of the query; smaller is better.

    A duplicated term counts twice. A phrase in more than half of the chunks has the idf floor 1e-6."""
    spark = chunks.sparkSession
    n, mean = corpus_stats(chunks, text)
    phrases = sorted({p for _, q in queries for p in phrase_terms(q)})
    if not phrases or not n:
        return spark.createDataFrame([], f"query_id int, {key} {chunks.schema[key].dataType.simpleString()}, bm25 double")
    return score_hits(phrase_hits(chunks, phrases, key, text), queries, n, mean, [], key)


def score_hits(hits: DataFrame, queries: list[tuple[int, str]], n: int, mean: float, carried: list[str], key: str = "chunk_id") -> DataFrame:
    """(query_id, key, bm25, carried) from (key, phrase, tf, len, carried) among ``n`` chunks of ``mean`` tokens. df and terms have a row a phrase."""
    terms = query_phrases(hits.sparkSession, queries)
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, FLOOR).otherwise(idf)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    scored = hits.join(F.broadcast(df.select("phrase", weight.alias("idf"))), "phrase").select(key, "phrase", part.alias("s"), *carried)
    return scored.join(F.broadcast(terms), "phrase").groupBy("query_id", key).agg((-F.sum("s")).alias("bm25"), *[F.first(c).alias(c) for c in carried])


def top_k(scores: DataFrame, k: int, key: str = "chunk_id", score: str = "bm25", descending: bool = False, by: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank; ties go to the smaller key."""
    order = F.desc(score) if descending else F.asc(score)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("rank") <= k)


def idf(n: int, df: int) -> float:
    value = math.log((n - df + 0.5) / (df + 0.5))
    return value if value > 0 else FLOOR
