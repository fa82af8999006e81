"""Text scalars as Columns; every one stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Suffixes that are read as text, suffixes that hold code, file names that are skipped.
TEXT_SUFFIXES = ".md .txt .rst .adoc .py .js .ts .tsx .jsx .json .yaml .yml .toml .ini .sh .ps1 .java .kt .go .rs .c .h .cpp .cs .php .rb .swift .sql .xml .html .css .scss .env".split()
CODE_SUFFIXES = ".py .js .ts .tsx .jsx .java .kt .go .rs .c .h .cpp .cs .php .rb .swift .sh .ps1".split()
SKIPPED_NAMES = "package-lock.json yarn.lock pnpm-lock.yaml composer.lock poetry.lock bun.lockb shrinkwrap.json npm-shrinkwrap.json".split()
SKIPPED_DIRS = ".git .hg .svn .venv venv node_modules dist build coverage __pycache__ .next .idea .vscode".split()
SKIPPED_ENDINGS = r"(\.min\.(js|css)|\.bundle\.js|\.chunk\.js|\.map|\.svg)$"
#: Lines that cleaning drops, in lower case: whole lines, the start of a line, and a start that a year follows.
NOISE_LINES, NOISE_START, NOISE_YEAR = ("table of contents", "all rights reserved", "all rights reserved."), "generated by ", "copyright (c) "
MAX_FILE_BYTES, MINIFIED_LINE, MINIFIED_LINES = 524_288, 500, 10
QUERY_WORDS, QUERY_LINES, QUERY_TERMS = 500, 80, 20
SPACES = r"[ \t\n\x0B\f\r]+"

_LETTERS = [chr(i) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
_BASE = {c: unicodedata.normalize("NFD", c)[0] for c in _LETTERS}
_BASE = {c: b for c, b in _BASE.items() if b.isascii() and b.isalpha()}
ACCENTED, PLAIN = "".join(_BASE), "".join(_BASE.values())


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and _ of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def index_text(text: Column) -> Column:
    """Lower case without accents on Latin letters and without combining marks."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{M}+", "")


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits as the inverted index sees them."""
    return F.regexp_extract_all(index_text(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(token: Column, n: int = 3) -> Column:
    """Sliding n-grams of ^token$; the padded token itself if it is shorter than n."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    slid = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(padded) < n, F.array(padded)).otherwise(slid)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """max(1, floor(1.3 * words)) in whole numbers; 1 for null."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(word_count(text), F.lit(0)) * 13 / 10).cast("int"))


def suffix(path: Column) -> Column:
    """Lower-cased suffix of the file name; '' for none and for names that only start with a dot."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def is_text_file(path: Column) -> Column:
    return suffix(path).isin(TEXT_SUFFIXES)


def is_code_file(path: Column) -> Column:
    return suffix(path).isin(CODE_SUFFIXES)


def is_skipped(path: Column, size: Column) -> Column:
    """Lock files, built files, maps, drawings, and files over the size cap or of unknown size."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.isin(SKIPPED_NAMES) | name.rlike(SKIPPED_ENDINGS) | (suffix(path) == ".svg") | F.coalesce(size > MAX_FILE_BYTES, F.lit(True))


def is_minified(text: Column) -> Column:
    return F.exists(F.slice(F.split(text, "\n"), 1, MINIFIED_LINES), lambda x: F.length(x) > MINIFIED_LINE)


def clean_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACES, " "))


def is_noise(line: Column) -> Column:
    """Whether a cleaned line is a heading of contents or a notice."""
    low = F.lower(line)
    year = F.substring(line, len(NOISE_YEAR) + 1, 4).rlike("^[0-9]{4}$")
    return low.isin(*NOISE_LINES) | F.startswith(low, F.lit(NOISE_START)) | (F.startswith(low, F.lit(NOISE_YEAR)) & year)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def clean_text(text: Column) -> Column:
    """Lines with collapsed blanks, without noise, short lines and repeats (ignoring case), joined by newlines.

    Repeats are found over the whole text by sorting (lower-cased line, position)."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), clean_line)
    kept = F.filter(lines, lambda x: (F.length(x) >= 2) & ~is_noise(x))
    keyed = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))

    def once(s: Column) -> Column:
        first = F.filter(s, lambda e, j: (j == 0) | (F.get(s, j - 1)["k"] != e["k"]))
        return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])

    return F.array_join(let(keyed, once), "\n")


def validate_query(text: Column) -> Column:
    """'ok' or why a query is rejected."""
    lines = F.size(F.split(text, "\n"))
    return F.when(word_count(text) > QUERY_WORDS, "too many words").when(lines > QUERY_LINES, "too many lines").otherwise("ok")


def query_terms(text: Column) -> Column:
    return F.slice(tokens(text), 1, QUERY_TERMS)


def sentences(text: Column) -> Column:
    """Split after . ! or ? followed by blanks; trimmed, none empty."""
    return F.filter(F.transform(F.split(F.trim(text), rf"(?<=[.!?]){SPACES}"), lambda s: F.trim(s)), lambda s: s != "")


def trim_words(text: Column, n) -> Column:
    """The first n words without trailing punctuation, and dots."""
    w = words(text)
    cut = F.regexp_replace(F.array_join(F.slice(w, 1, n), " "), r"[.,;:]+$", "")
    return F.when(F.size(w) <= n, F.array_join(w, " ")).otherwise(F.concat(cut, F.lit("...")))


def overlap_ratio(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for an empty query."""
    both = F.size(F.array_intersect(query, text))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_distinct(query)).cast("double")), F.lit(0.0))


def rank_score(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / rank).otherwise(0.0)


def bm25_signal(score: Column) -> Column:
    """1 / (1 + |score|): the stronger the match, the smaller; kept as the ranking defines it."""
    return F.when(score.isNotNull(), 1.0 / (1.0 + F.abs(score))).otherwise(0.0)


def citation(source: Column, index: Column) -> Column:
    return F.concat(F.lit("["), F.element_at(F.split(source, "/"), -1), F.lit("#chunk-"), index.cast("string"), F.lit("]"))


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for empty vectors and unequal lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), product).otherwise(0.0)
