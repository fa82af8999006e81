"""Imports, calls, symbols and their expansion, as extraction by regular expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strandwork.functions import text as T
from strandwork.functions.forms import form


def _spread(table: dict[str, list]) -> dict[str, list]:
    """A table by single suffixes from one by groups of suffixes."""
    return {suffix: rows for group, rows in table.items() for suffix in group.split()}


#: Import expressions by suffix, each with one group; a form that starts with ^ holds at the start of a line.
IMPORTS = {
    suffix: [(form(x.lstrip("^"), start=x.startswith("^")), 1) for x in forms]
    for suffix, forms in _spread({
        ".py": ["^from DOTTED import", "^import DOTTED"],
        ".js .ts .tsx .jsx": ["import LITTLE from PATH", "require ( PATH )"],
        ".go": ["import (? PATH"],
        ".rs": ["use SCOPED", "mod NAME"],
        ".java": ["import DOTTED ;"],
        ".c .h .cpp": ["# include HEADER"],
        ".rb": ["require PATH", "require_relative PATH"],
    }).items()
}
#: Names before a parenthesis that are no calls worth keeping.
NOT_CALLS = "if else for while return function def class import from try except catch finally with as print len str int float list dict set tuple True False None self this new const let var".split()
#: (kind, expression, head of the signature, whether arguments follow) of symbols by suffix.
SYMBOLS = {
    suffix: [(kind, form(x.lstrip("^"), start=x.startswith("^")), head, arguments) for kind, x, head, arguments in rows]
    for suffix, rows in _spread({
        ".py": [("function", "^async? def NAME ARGS", "def ", True), ("class", "^class NAME SPAN? :", "class ", False)],
        ".js .ts .tsx .jsx": [("function", "async? function NAME ARGS", "function ", True), ("function", "const|let|var NAME = async? SPAN =>", "const ", None), ("class", "class NAME", "class ", False)],
        ".go": [("function", "func RECEIVER? NAME ARGS", "func ", True), ("struct", "type NAME struct", "type ", None)],
        ".rs": [("function", "fn NAME GENERICS? ARGS", "fn ", True), ("struct", "struct NAME", "struct ", False)],
    }).items()
}


def _by_suffix(source: Column, choices: dict[str, Column], otherwise: Column) -> Column:
    end = T.suffix(source)
    out = None
    for s, c in choices.items():
        out = F.when(end == s, c) if out is None else out.when(end == s, c)
    return out.otherwise(otherwise)


def imports(text: Column, source: Column) -> Column:
    """array<string> of imported names; [] for suffixes without patterns."""
    none = F.array().cast("array<string>")
    return _by_suffix(source, {s: F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ps]) for s, ps in IMPORTS.items()}, none)


def import_edges(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """(source_file, target_import), distinct."""
    some = docs.where(F.col(text).isNotNull() & F.col("source").isNotNull())
    return some.select(F.col("source").alias("source_file"), F.explode(imports(F.col(text), F.col("source"))).alias("target_import")).distinct()


def candidate_paths(source: Column, target: Column) -> Column:
    """The files an import may mean, in order of preference, relative to the importing file's directory."""
    folder = F.regexp_replace(source, r"[^/]*$", "")
    plain = [F.concat(folder, target, F.lit(e)) for e in (".py", ".ts", ".js", "/__init__.py", "/index.ts", "/index.js")]
    dotted = [F.concat(folder, F.translate(target, ".", "/"), F.lit(e)) for e in (".py", ".ts")]
    return F.array(*map(tidy, plain + dotted))


def tidy(path: Column) -> Column:
    """A path without . and .. parts, however many: each .. takes back the part before it; one with nothing before it stays."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part == ".", done).when(back, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, target_import, resolved_file): the first candidate that is an indexed file, else null."""
    each = edges.select("source_file", "target_import", F.posexplode(candidate_paths(F.col("source_file"), F.col("target_import"))).alias("pos", "path"))
    known = files.select(F.col("source").alias("path")).distinct()
    hit = each.join(known, "path").groupBy("source_file", "target_import").agg(F.min_by("path", "pos").alias("resolved_file"))
    return edges.join(hit, ["source_file", "target_import"], "left")


#: A word before a parenthesis; one that starts with a digit is no name.
CALLED = form("NAME (")


def calls(text: Column) -> Column:
    """Distinct names before a parenthesis, sorted, without keywords, builtins and names that start with _."""
    names = F.regexp_extract_all(text, F.lit(CALLED), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin(NOT_CALLS) & ~F.substring(n, 1, 1).isin("_", *"0123456789"))))


def symbols(text: Column, source: Column) -> Column:
    """array<struct<name, kind, signature>>, by kind of declaration."""

    def found(kind: str, pattern: str, head: str, arguments: bool | None) -> Column:
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if arguments:
            given = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
            sign = F.zip_with(names, given, lambda n, a: F.struct(n.alias("name"), F.lit(kind).alias("kind"), F.concat(F.lit(head), n, F.lit("("), a, F.lit(")")).alias("signature")))
        else:
            tail = {"const ": " = () =>", "type ": " struct"}.get(head, "")
            sign = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"), F.concat(F.lit(head), n, F.lit(tail)).alias("signature")))
        return sign

    none = F.array().cast("array<struct<name:string,kind:string,signature:string>>")
    return _by_suffix(source, {s: F.concat(*[found(*x) for x in xs]) for s, xs in SYMBOLS.items()}, none)


def symbol_index(chunks: DataFrame) -> DataFrame:
    """(file_path, symbol_name, symbol_type, signature, chunk_id) from rows (chunk_id, source, text)."""
    each = chunks.where(F.col("text").isNotNull()).select("chunk_id", "source", F.explode(symbols(F.col("text"), F.col("source"))).alias("s"))
    return each.select(F.col("source").alias("file_path"), F.col("s.name").alias("symbol_name"), F.col("s.kind").alias("symbol_type"), F.col("s.signature").alias("signature"), "chunk_id").distinct()


def two_hop(candidates: DataFrame, index: DataFrame, chunks: DataFrame, most: int = 5, by: str = "query_id") -> DataFrame:
    """(by, name, file_path, chunk_id, definition): the first definitions of what the top candidates call, at most ``most`` per query.

    Candidates: (by, rank, text), of which the first three count. A name is taken at its first candidate; names of one candidate in
    order; definitions by (file, chunk); the definition's text is cut to 500 characters."""
    called = candidates.where(F.col("rank") <= 3).select(by, "rank", F.explode(calls(F.col("text"))).alias("name")).groupBy(by, "name").agg(F.min("rank").alias("rank"))
    first = index.groupBy(F.col("symbol_name").alias("name")).agg(F.min(F.struct("file_path", "chunk_id")).alias("d")).select("name", "d.file_path", "d.chunk_id")
    some = called.join(first, "name").withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("rank", "name"))).where(F.col("n") <= most)
    text = chunks.select("chunk_id", F.substring("text", 1, 500).alias("definition")).dropDuplicates(["chunk_id"])
    return some.join(text, "chunk_id").select(by, "name", "file_path", "chunk_id", "definition")
