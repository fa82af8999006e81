"""p5: oversized items cut into pieces within limits, at natural boundaries, with overlap.

Lexical cohesion: at every boundary between two units (a line end, else a sentence end, else a word end) the words of the ``BLOCK``
units before and after are compared (cosine of their counts); the depth of a boundary is how far its similarity lies
below the peaks on either side. Of the line and sentence ends that keep a piece within both limits, and that lie in the last half of what would fit,
the one in the deepest valley ends the piece (ties: a line end, then the latest); where there is neither, the word end in the deepest valley does. The next piece starts about
``OVERLAP`` words before that end, at a word. A word longer than the limit is cut between characters.

Defined results: null texts give no row, nor do items within both limits; limits count words (runs of other than space, tab, CR
and LF) and code points of the text as it is; duplicate rows give one set of pieces; the pieces joined without their overlaps give the
text again; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.session import table

WORDS, CHARS, OVERLAP, BLOCK = 300, 3000, 20, 6
_WORD = re.compile(r"[^ \t\r\n]+")
_TERM = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?。！？…][\"')\]»”’]*$")
_PIECE = "kind string, item_id long, piece int, start int, text string, words int, token_estimate int"


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    spans = [m.span() for m in _WORD.finditer(text)]
    a = np.array(spans, dtype=np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the kind of boundary after it: 2 line end, 1 sentence end, 0 word end."""
    kind = np.zeros(len(starts), dtype=np.int8)
    for i in range(len(starts)):
        stop = starts[i + 1] if i + 1 < len(starts) else len(text)
        gap = text[ends[i] : stop]
        if "\n" in gap or "\r" in gap:
            kind[i] = 2
        elif _SENTENCE.search(text[max(starts[i], ends[i] - 6) : ends[i]]):
            kind[i] = 1
    return kind


def depths(text: str, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Depth of the similarity valley after each word; 0 inside units. Units end at lines and sentences, and after 25 words at most."""
    n = len(starts)
    cut, last = [], -1
    for i in range(n):
        if kind[i] or i - last >= 25:
            cut.append(i)
            last = i
    if not cut or cut[-1] != n - 1:
        cut.append(n - 1)
    terms, first = [], 0
    for c in cut:
        terms.append(Counter(_TERM.findall(text[starts[first] : ends[c]].lower())))
        first = c + 1
    m = len(terms)
    similar = np.ones(m)
    left, right = Counter(), Counter()
    for t in terms[:block]:
        right.update(t)
    for i in range(m - 1):  # the blocks slide by one unit
        left.update(terms[i])
        if i >= block:
            left.subtract(terms[i - block])
        right.subtract(terms[i])
        if i + block < m:
            right.update(terms[i + block])
        small, large = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(c * large.get(w, 0) for w, c in small.items())
        norm = sum(c * c for c in left.values()) * sum(c * c for c in right.values())
        similar[i] = dot / norm**0.5 if norm else 0.0
        if i % 64 == 0:
            left, right = +left, +right
    up, down = similar.copy(), similar.copy()
    for i in range(1, m):  # the peak that a climb to the left reaches
        if similar[i - 1] >= similar[i]:
            up[i] = up[i - 1]
    for i in range(m - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            down[i] = down[i + 1]
    out = np.zeros(n)
    out[cut] = up + down - 2 * similar
    return out


def pieces(text: str, max_words: int = WORDS, max_chars: int = CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of each piece; one piece if the text is within both limits. A piece takes the blanks after its last word."""
    starts, ends = word_spans(text)
    n = len(starts)
    if n <= max_words and len(text) <= max_chars:
        return [(0, len(text))]
    if n == 0:  # blanks only
        return [(i, min(i + max_chars, len(text))) for i in range(0, len(text), max_chars)]
    kind = boundaries(text, starts, ends)
    depth = depths(text, starts, ends, kind)
    stop = np.append(starts[1:], len(text))  # a word and the blanks behind it
    out: list[tuple[int, int]] = []
    begin, first = 0, 0  # position, and the first word that starts at or after it
    while True:
        if n - first <= max_words and len(text) - begin <= max_chars:
            out.append((begin, len(text)))
            return out
        reach = min(first + max_words, int(np.searchsorted(ends, begin + max_chars, side="right")))
        previous = out[-1][1] if out else begin
        least = int(np.searchsorted(ends, previous, side="right"))  # at least one word more than the piece before
        if reach <= max(first, least):  # not one whole word fits: between characters
            end = begin + max_chars
            out.append((begin, end))
            begin, first = end, int(np.searchsorted(starts, end))
            if first > 0 and ends[first - 1] > end:  # the rest of that word counts as a word
                starts = np.insert(starts, first, end)
                ends = np.insert(ends, first, ends[first - 1])
                ends[first - 1] = end
                stop = np.insert(stop, first, stop[first - 1])
                stop[first - 1] = end
                kind, depth = np.insert(kind, first, kind[first - 1]), np.insert(depth, first, depth[first - 1])
                kind[first - 1] = 0
                n += 1
            continue
        low = max(least, first + (reach - first) // 2, first + min(overlap + 1, reach - first - 1))
        low = min(low, reach - 1)
        span = np.arange(low, reach)
        best = span[np.lexsort((span, kind[span], depth[span], kind[span] > 0))[-1]]
        end = int(min(stop[best], begin + max_chars))
        out.append((begin, end))
        back = max(first + 1, best + 1 - overlap)
        begin, first = int(starts[back]) if back <= best else end, int(min(back, best + 1))
        if first > best:
            begin = end


def _cut(max_words, max_chars, overlap):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for kind, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, (a, b) in enumerate(pieces(text, max_words, max_chars, overlap)):
                    words = len(_WORD.findall(text[a:b]))
                    for column, value in zip(out, (kind, key, i, a, text[a:b], words, max(1, words * 13 // 10))):
                        column.append(value)
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["kind", "item_id", "piece", "start", "text", "words", "token_estimate"])

    return run


def split_oversized(items: DataFrame, max_words: int = WORDS, max_chars: int = CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items (kind, item_id, text) over a limit: (kind, item_id, piece, start, text, words, token_estimate)."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0)))
    over = items.where(F.col("item_id").isNotNull() & (F.length("text") > 2 * max_words - 2)).select("kind", "item_id", "text")
    over = over.where((F.length("text") > max_chars) | (words > max_words)).withColumn("hash", F.xxhash64("text"))
    parts = 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in the cutting: not to be coalesced by bytes
    over = over.repartition(parts, "kind", "item_id", "hash").dropDuplicates(["kind", "item_id", "hash"]).drop("hash")
    return over.mapInArrow(_cut(max_words, max_chars, overlap), _PIECE)


def _items(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("item_id"), F.col("cleaned_text").alias("text"))
    return d.unionByName(table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item_id"), "text"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """The items that were cut: those with a second piece."""
    return split_oversized(_items(spark, sf_dir)).where("piece = 1").select("kind", "item_id").distinct()


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    return split_oversized(_items(spark, sf_dir))
