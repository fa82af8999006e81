"""Retrieval quality, latency percentiles, savings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def judged(results: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """(by, precision, recall, mrr, ndcg) of results (by, rank, text, relevant array, irrelevant array).

    Precision: a text with a relevant and no irrelevant keyword, over min(k, n). Recall: share of relevant keywords in the first k texts.
    MRR: first text with a relevant keyword, at any rank. nDCG: gain is a text's share of keywords."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.exists("relevant", lambda x: F.contains(low, F.lower(x)))
    bad = F.exists("irrelevant", lambda x: F.contains(low, F.lower(x)))
    share = F.size(F.filter("relevant", lambda x: F.contains(low, F.lower(x)))) / F.greatest(F.lit(1), F.size("relevant"))
    top = F.col("rank") <= k
    log2 = F.log2(F.col("rank") + 1.0)
    seen = F.when(top, F.filter("relevant", lambda x: F.contains(low, F.lower(x)))).otherwise(F.array().cast("array<string>"))
    rows = results.select(by, "rank", "relevant", hit.alias("hit"), (hit & ~bad & top).cast("int").alias("good"), F.when(top, share / log2).otherwise(0.0).alias("gain"), seen.alias("seen"))
    out = rows.groupBy(by).agg(
        (F.sum("good") / F.least(F.lit(k), F.count("*"))).alias("precision"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("seen")))) / F.greatest(F.lit(1), F.max(F.size("relevant")))).alias("recall"),
        F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum("gain").alias("dcg"),
        F.max(F.size("relevant")).alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n")))), F.lit(0.0), lambda s, i: s + F.lit(math.log(2)) / F.log(i + 1.0))
    return out.select(by, "precision", "recall", "mrr", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def quality(precision: Column, recall: Column) -> Column:
    return (
        F.when((precision >= 0.8) & (recall >= 0.7), "Excellent")
        .when((precision >= 0.6) & (recall >= 0.5), "Good")
        .when((precision >= 0.4) | (recall >= 0.4), "Fair")
        .otherwise("Needs Improvement")
    )


def percentiles(df: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99), buckets: int = 4096) -> DataFrame:
    """(by, n, mean, least, most, pXX): the element at floor(n * p / 100) of the sorted values; nulls are out.

    Equal values are one row. Each group's range is cut into ``buckets`` of equal width; running counts over the buckets, a bounded number of
    rows a group, tell in which bucket a rank lies, and only the values of these buckets are put in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    whole = counts.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0))
    placed = counts.join(whole, by)
    placed = placed.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(share * buckets)).cast("int"))
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*by, "bucket").agg(F.sum("c").alias("in")).withColumn("before", F.coalesce(F.sum("in").over(order), F.lit(0)))
    want = F.explode(F.array(*[F.lit(p) for p in percents])).alias("p")
    ranks = whole.select(*by, "n", want).withColumn("rank", F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1))
    hit = ranks.join(runs, by).where("rank >= before AND rank < before + in").select(*by, "bucket", "p", "rank", "before")
    inside = placed.join(hit, [*by, "bucket"])
    ordered = Window.partitionBy(*by, "p").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside.withColumn("upto", F.col("before") + F.sum("c").over(ordered)).where("upto > rank")
    picked = found.groupBy(*by).agg(*[F.min(F.when(F.col("p") == p, F.col(value))).alias(f"p{p}") for p in percents])
    return whole.join(picked, by)


#: Prices of tokens in dollars, for a thousand and for a million.
PER_THOUSAND, PER_MILLION = 0.01, 3.0


def cost(tokens: Column, per_million: float = PER_MILLION) -> Column:
    return tokens * per_million / 1_000_000


def costs(raw: Column, compressed: Column, per_million: float = PER_MILLION) -> list[Column]:
    """raw_cost, compressed_cost and saved_cost of a query, and what a hundred queries spare."""
    spared = F.round(cost(raw, per_million) - cost(compressed, per_million), 6)
    return [F.round(cost(raw, per_million), 6).alias("raw_cost"), F.round(cost(compressed, per_million), 6).alias("compressed_cost"), spared.alias("saved_cost"), F.round(spared * 100, 4).alias("saved_cost_100")]


def report(packets: DataFrame, quality_rows: DataFrame, latencies: DataFrame, baseline_tokens: int, index_ms: float) -> dict:
    """A nested report from packets (selected_tokens, compressed_tokens, pool_tokens), quality (precision, recall, mrr, ndcg) and latencies (ms): three
    one-row aggregates, read by the driver."""
    p = packets.agg(F.count("*").alias("queries"), F.coalesce(F.sum("selected_tokens"), F.lit(0)).alias("selected"), F.coalesce(F.sum("compressed_tokens"), F.lit(0)).alias("compressed"), F.coalesce(F.avg(F.try_divide("selected_tokens", "compressed_tokens")), F.lit(0.0)).alias("ratio")).first()
    q = quality_rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "mrr", "ndcg")]).first()
    t = percentiles(latencies.withColumn("all", F.lit(1)), ["all"], "ms").drop("all").first()
    each = p.compressed / max(1, p.queries)
    raw, small = baseline_tokens * PER_MILLION / 1e6, each * PER_MILLION / 1e6
    label = packets.sparkSession.range(1).select(quality(F.lit(q.precision), F.lit(q.recall))).first()[0]
    return {
        "summary": {"queries": p.queries, "index_ms": round(index_ms, 2)},
        "tokens": {"baseline": baseline_tokens, "per_query": round(each), "reduction_pct": round(100 * (1 - each / max(1, baseline_tokens)), 1), "selected": p.selected, "compressed": p.compressed, "ratio": round(p.ratio, 2)},
        "latency_ms": {k: round(v, 2) for k, v in (("mean", t.mean), ("min", t.least), ("max", t.most), ("p50", t.p50), ("p95", t.p95), ("p99", t.p99))} if t else {},
        "quality": {**{c: round(q[c], 3) for c in ("precision", "recall", "mrr", "ndcg")}, "label": label},
        "cost_usd": {"baseline": round(raw, 6), "compressed": round(small, 6), "saved_100": round(100 * (raw - small), 4)},
    }


def report_markdown(found: dict) -> str:
    """The report as headed tables of names and values."""
    out = ["# Benchmark"]
    for part, values in found.items():
        out += ["", f"## {part.replace('_', ' ')}", "", "| name | value |", "|-|-|"]
        out += [f"| {k} | {v:,} |" if isinstance(v, (int, float)) else f"| {k} | {v} |" for k, v in values.items()]
    return "\n".join(out) + "\n"


def savings(raw: Column, compressed: Column) -> list[Column]:
    """saved and pct: what compression spares of the raw tokens; 0 % of nothing."""
    saved = F.greatest(F.lit(0), raw - compressed)
    return [saved.alias("saved"), F.coalesce(F.round(F.try_divide(100.0 * saved, raw), 2), F.lit(0.0)).alias("pct")]
