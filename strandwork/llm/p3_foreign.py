"""p3: generated, minified, vendored and data files told apart from hand-written source.

Signs in path, remarks and content are read per file (see ``signs``). Copies are found by winnowing: the token stream of a file,
numbers blanked, gives fingerprints (the smallest hash of each window of ``WINDOW`` runs of ``K`` tokens); a fingerprint
counts the repositories it occurs in, and those in which it occurs in a file marked as somebody else's. A file is a
vendored copy if at least ``SHARE`` of its fingerprints recur in ``MANY`` or more repositories, or in marked
files of ``MARKED`` or more other repositories. Counts are over all documents; copies within a repository count once.

Defined results: a null path has no path sign and no repository (its fingerprints count for none); null and empty texts are judged by
their path; repeated rows give one row; a null id gives none; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandwork.llm import signs
from strandwork.llm.textpairs import mix
from strandwork.session import materialize, table

K, WINDOW, MANY, MARKED, SHARE = 12, 24, 8, 2, 0.6
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|[^\s\w]").findall
_HASHES: dict[str, int] = {}
_PART = "id long, repo long, sign string, print long"


def fingerprints(text: str, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Distinct winnowed hashes of a text's normalised tokens; a text shorter than k tokens has none."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    known = _HASHES
    ids = []
    for t in _TOKEN(text):
        h = known.get(t)
        if h is None:
            h = known[t] = xxhash.xxh3_64_intdigest("0" if t.isdigit() else t)
        ids.append(h)
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    t = np.array(ids, dtype=np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h + t[i : i + n])
    w, width, low = min(window, n), 1, h
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if w > width:
        low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
    return np.unique(low).view(np.int64)


def _read(code_suffixes):
    def run(batches):
        for batch in batches:
            ids, repos, found, prints = [], [], [], []
            for key, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                sign = signs.path_sign(source)
                if sign != "foreign":
                    sign = signs.content_sign(source, text, code_suffixes) or sign
                fp = fingerprints(text) if text and source else np.empty(0, np.int64)
                repo = xxhash.xxh3_64_intdigest(source.partition("/")[0]) >> 1 if source else 0
                n = len(fp) + 1
                ids += [key] * n
                repos += [repo] * n
                found += [sign] * n
                prints.append(np.append(fp, 0))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(repos, pa.int64()), pa.array(found, pa.string()), pa.array(np.concatenate(prints))], names=["id", "repo", "sign", "print"])

    return run


def not_hand_written(df: DataFrame, suffixes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sign, copied): files with a sign, or recognised as vendored copies ('copy'); copied: the share of a file's fingerprints that recur in many
    repositories or in marked files of others (null without fingerprints).

    The driver reads the code suffixes (see ``suffix_rows``). A fingerprint that a third of the files share is one row of ``spread``; the other side of
    its join is left to adaptive execution to split."""
    code = frozenset(r[0].lower() for r in signs.suffix_rows(suffixes.where("is_code").select("suffix")) if r[0])
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "source", "raw_text")
    read = materialize(rows.mapInArrow(_read(code), _PART), "prints")
    signed = read.where("print = 0").groupBy("id").agg(F.max("sign").alias("sign"))
    prints = read.where("print <> 0")
    by_repo = prints.where("repo <> 0").groupBy("print", "repo").agg(F.max((F.col("sign") == "foreign").cast("int")).alias("marked"))
    spread = by_repo.groupBy("print").agg(F.count("*").alias("repos"), F.sum(F.coalesce("marked", F.lit(0))).alias("marked"))
    spread = spread.where((F.col("repos") >= MANY) | (F.col("marked") >= MARKED)).select("print", F.lit(1).alias("hit"))
    share = prints.select("id", "print").join(spread, "print", "left").groupBy("id").agg((F.count("hit") / F.count("*")).alias("copied"))
    found = signed.join(share, "id", "left").withColumn("sign", F.when(F.col("sign").isNull() & (F.col("copied") >= SHARE), "copy").otherwise(F.col("sign")))
    return found.where("sign IS NOT NULL").select(F.col("id").alias(key), "sign", "copied")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return not_hand_written(table(spark, sf_dir, "documents"), table(spark, sf_dir, "code_suffixes")).select("doc_id")


def p3_signs(spark, sf_dir: str) -> DataFrame:
    return not_hand_written(table(spark, sf_dir, "documents"), table(spark, sf_dir, "code_suffixes"))
