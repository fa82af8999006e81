"""p7: token ids of every text of a corpus by a public byte-level vocabulary.

A narrow map: no shuffle, one pass over the text column. Each worker inserts the distinct words it has not met into
a trie and encodes them once (see ``bpe``). The vocabulary file is read by the driver and broadcast (fixed size).

Defined results: null and empty texts give an empty list; every input row gives one row, repeated rows too; strings of
special tokens are ordinary text; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandwork.llm import bpe
from strandwork.session import table


def shared_vocabulary(spark, path: str = bpe.VOCABULARY):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(key, ids array<int>) for every row."""
    ranks = shared_vocabulary(df.sparkSession, vocabulary)

    def run(batches):
        e = bpe.encoder(ranks.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids = e.encode_batch(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
