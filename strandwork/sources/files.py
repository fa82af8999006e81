"""Files of a directory tree as document rows, and packets as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.functions import text as T


def _decode(content: pd.Series) -> pd.Series:
    """UTF-8, else UTF-16, else Latin-1."""

    def one(b: bytes) -> str:
        for name in ("utf-8", "utf-16", "latin-1"):
            try:
                return b.decode(name)
            except UnicodeError:
                pass

    return content.map(one)


def read_files(spark: SparkSession, path: str, skip_minified: bool = True) -> DataFrame:
    """(source, raw_text, file_mtime, size): text files below a path, without skipped directories and files.

    The filters on path and size are on the file listing, so that dropped files are never opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = ~F.exists(F.split("path", "/"), lambda d: d.isin(T.SKIPPED_DIRS))
    kept = files.where(inside & T.is_text_file(F.col("path")) & ~T.is_skipped(F.col("path"), F.col("length")))
    rows = kept.select(F.col("path").alias("source"), F.pandas_udf(_decode, "string")("content").alias("raw_text"), F.col("modificationTime").cast("double").alias("file_mtime"), F.col("length").alias("size"))
    return rows.where(~T.is_minified(F.col("raw_text"))) if skip_minified else rows


def prompt_source(spark: SparkSession, prompt: str) -> DataFrame:
    """A prompt as a single document."""
    return spark.createDataFrame([(1, "intercepted_prompt.txt", prompt)], "doc_id long, source string, raw_text string")


def packet_json(packet: Column) -> Column:
    return F.to_json(packet)
