"""Operators against exact values and against an independent full-text index."""

import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import text as T
from strandwork.operators import chunking, compress, evaluation, fusion, graph, guard, lexical, lifecycle, patch, vectors
from strandwork.operators.components import connected_components
from strandwork.plans.engine import Engine, retrieval_tier
from strandwork.sources import files, settings


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_text_scalars(spark):
    assert column(spark, ["", "one", "one two", "w " * 100, None], T.token_estimate) == [1, 1, 2, 130, 1]
    assert column(spark, ["Foo_bar, 9!", "", None], T.tokens) == [["foo_bar", "9"], [], None]
    assert column(spark, ["abc", "a", ""], T.ngrams) == [["^ab", "abc", "bc$"], ["^a$"], ["^$"]]
    assert column(spark, ["a/B.PY", ".env", "x/y"], T.suffix) == [".py", "", ""]
    assert column(spark, ["One. Two!  Three?", ""], T.sentences) == [["One.", "Two!", "Three?"], []]
    assert column(spark, ["Café Déjà x_y"], T.index_tokens) == [["cafe", "deja", "x", "y"]]
    assert column(spark, ["a b c, d", "a b"], lambda c: T.trim_words(c, 3)) == ["a b c...", "a b"]
    text = "Copyright (c) 2020 X\nAll rights reserved.\n  a   line \nA LINE\n\nx\nTable of Contents\nGenerated by y\nkept"
    assert column(spark, [text, "", None], T.clean_text) == ["a line\nkept", "", None]
    assert column(spark, ["w " * 501, "x\n" * 81, "ok"], T.validate_query) == ["too many words", "too many lines", "ok"]
    assert column(spark, ["\n" * 9 + "y" * 501, "\n" * 10 + "y" * 501], T.is_minified) == [True, False]


def test_skipped_files(spark):
    rows = spark.createDataFrame([("a/x.min.js", 1), ("a/yarn.lock", 1), ("a/b.py", 524_289), ("a/b.py", 524_288), ("a/c.svg", 1), ("d.py", None)], "p string, n long")
    assert [r[0] for r in rows.select(T.is_skipped(F.col("p"), F.col("n"))).collect()] == [True, True, True, False, True, True]


DOCS = ["auth token auth check foo_bar baz", "token foo bar in cookie cookie", "css palette notes for page", "bar foo reversed words only here", "nothing at all relevant in this one", "Café déjà vu naïve x", "more filler words", "and again filler text"]


@pytest.mark.parametrize("query", ["auth", "auth token", "auth auth", "foo_bar", "filler", "cafe", "missing"])
def test_bm25_equals_an_independent_index(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", list(enumerate(DOCS, 1)))
    match = " OR ".join(f'"{t}"' for t in query.split())
    want = {r: s for r, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
    rows = spark.createDataFrame(list(enumerate(DOCS, 1)), "chunk_id long, text string")
    got = {r.chunk_id: r.bm25 for r in lexical.bm25_scores(rows, [(0, query)]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_bm25_edges(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "d e"), (4, None)], "chunk_id long, text string")
    got = {r.chunk_id: r.bm25 for r in lexical.bm25_scores(rows.where("chunk_id < 4"), [(0, "a")]).collect()}
    assert got == pytest.approx({1: -1e-6, 2: -1e-6})
    assert lexical.bm25_scores(rows, [(0, "???")]).count() == 0
    assert lexical.bm25_scores(rows.limit(0), [(0, "a")]).count() == 0
    assert {r.token: (r.df, r.cf) for r in lexical.document_frequencies(rows).collect()}["a"] == (2, 2)


def ranges(lines, size, overlap):
    """Brute force of the line ranges."""
    w, out, i = [max(1, n) for n in lines], [], 0
    while i < len(w):
        e, total = i + 1, w[i]
        while e < len(w) and total + w[e] <= size:
            total += w[e]
            e += 1
        out.append((i, e))
        if e == len(w):
            break
        j, back = e, 0
        while j > 0 and back < overlap:
            j -= 1
            back += w[j]
        i = max(i + 1, j)
    return out


@pytest.mark.parametrize("lines,size,overlap", [([30] * 7, 100, 40), ([120, 10, 120], 100, 20), ([5, 0, 90, 3, 3, 60, 60, 1], 80, 10), ([1], 80, 20), ([10] * 40, 100, 0)])
def test_line_ranges(spark, lines, size, overlap):
    text = "\n".join(" ".join(["w"] * n) for n in lines)
    got = column(spark, [text], lambda c: chunking.line_ranges(F.split(c, "\n"), size, overlap))[0]
    assert [(r.s, r.e) for r in got] == ranges(lines, size, overlap)


def test_normalise():
    assert [chunking.normalise(*x) for x in ((220, 40), (50, 10), (1000, 40), (100, 100), (100, 90))] == [(220, 40), (80, 10), (300, 40), (100, 20), (100, 45)]


def test_chunk_code(spark):
    source = "import x\n" + "\n".join(f"def f{i}(a):\n" + "\n".join(f"b{j} = {j} + a" for j in range(10)) for i in range(8)) + "\ndef big():\n" + "\n".join("c = 1 + 2 + 3" for _ in range(60))
    docs = spark.createDataFrame([(1, "a.py", source), (2, "b.xyz.sh", "echo hi"), (3, "c.py", ""), (4, "d.py", None)], "doc_id long, source string, cleaned_text string")
    rows = chunking.chunk_documents(docs, 100, 20).orderBy("doc_id", "chunk_index").collect()
    texts = [r.text for r in rows if r.doc_id == 1]
    assert {r.doc_id for r in rows} == {1, 2}
    joined = "\n".join(texts)
    assert all(f"def f{i}(a):" in joined for i in range(8)) and joined.count("c = 1 + 2 + 3") == 60
    assert all(len(t.split()) <= 200 for t in texts) and sum(t.startswith("def") or "import x" in t for t in texts) >= 3


def test_fusion(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id int, chunk_id long, rank int")
    b = spark.createDataFrame([(0, 1, 2), (0, 3, 1)], "query_id int, chunk_id long, rank int")
    got = {r.chunk_id: round(r.rrf, 6) for r in fusion.rrf(a, b).collect()}
    assert got == {1: 0.032522, 2: 0.016129, 3: 0.016393}
    c = spark.createDataFrame([(1, -2.889897877, None, 0.0, 1.0), (2, -0.912122933, None, 0.0, 0.5)], "fts_rank int, bm25 double, vector_rank int, vector_score double, overlap double")
    w = fusion.weighted(c).orderBy("fts_rank").collect()
    assert [round(r.fts_score, 6) for r in w] == [0.5171, 0.514936] and [round(r.final_score, 6) for r in w] == [0.40855, 0.332468]


@pytest.mark.parametrize("sizes,kept,used", [((60, 100, 50, 40, 30), [0, 2, 3], 150), ((200, 10), [0], 150), ((90, 70, 60), [0, 2], 150)])
def test_packing(spark, sizes, kept, used):
    rows = spark.createDataFrame([(0, i, " ".join([f"w{i}"] * n)) for i, n in enumerate(sizes)], "query_id int, rank int, bullet string")
    r = compress.pack_bullets(rows, 150).first()
    assert [int(b.split()[0].removeprefix("w").rstrip(".")) for b in r.bullets] == kept and r.words == used


def test_sentences(spark):
    parts = ["Tokens are checked by the middleware.", "The middleware checks session tokens.", "Cats sleep."]
    assert compress.textrank(parts) == pytest.approx([1, 1, 0.15])
    rows = spark.createDataFrame([(1, " ".join(parts)), (2, None)], "chunk_id long, text string")
    scored = compress.sentence_scores(rows, "session tokens")
    assert [round(r.score, 6) for r in scored.orderBy("pos").collect()] == [0.7, 0.870833, 0.083333]
    assert compress.pick_sentences(scored).first().summary == f"{parts[1]} {parts[0]}"
    assert compress.sentence_pairs(rows).first().jaccard == 0.375


def test_hash_embedding(spark):
    assert [vectors.hash_key(k, 256) for k in ("w:auth", "g:^au", "g:uth", "g:th$")] == [(6, -1), (145, 1), (204, -1), (166, -1)]
    rows = spark.createDataFrame([(1, "auth auth"), (2, ""), (3, None)], "chunk_id long, text string")
    got = {r.chunk_id: r.vector for r in vectors.hash_embeddings(rows, 8).collect()}
    assert got[1] == pytest.approx([0, 0.340562, 0, -0.340562, -0.340562, 0, -0.807498, 0], abs=1e-6)
    assert got[2] == [0.0] * 8 and 3 not in got


def test_vectors(spark):
    rows = [(1, "[1, 0]", "hash", 2, None), (2, "[0.6, 0.8]", " HASH", 2, None), (3, "[0,0]", "hash", 2, None), (4, "[1", "hash", 2, None), (5, "null", "hash", 2, None), (6, "[-1, 0]", "hash", 2, None), (7, "[1, 0]", "ml", 2, "m")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding_json string, backend string, dimensions int, model_name string")
    q = {"vector": [1.0, 0.0], "backend": "hash", "dimensions": 2, "model_name": None}
    assert [(r.chunk_id, r.rank) for r in vectors.scan_top_k(df, q).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "chunk_id long, vector array<double>")
    assert vectors.kmeans_clusters(v, 4).select("cluster").distinct().count() == 4
    assert vectors.kmeans_clusters(v.where("chunk_id < 3"), 4).select("cluster").distinct().count() == 3
    best = max(range(30), key=lambda i: math.cos(i))
    assert vectors.ivf_top_k(v, [1.0, 0.0], 3).first().chunk_id == best


def test_ivf_is_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, vector array<double>")  # 38 lists, more than 16 probes
    for q in rng.normal(size=(3, 16)):
        want = np.argsort(-(x @ q), kind="stable")[:20]
        assert [r.chunk_id for r in vectors.ivf_top_k(v, q.tolist()).collect()] == want.tolist()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (100, 100), (None, 3), (7, 3)], "u long, v long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    hub = spark.createDataFrame([(0, i) for i in range(1, 500)], "u long, v long")
    assert {r.label for r in connected_components(hub).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def test_lifecycle(spark):
    listing = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 1.0), ("c", 5.0), ("e", 1.0), (None, 1.0)], "source string, mtime double")
    index = spark.createDataFrame([("b", 1.0), ("c", 4.0), ("d", 1.0), ("e", None)], "source string, file_mtime double")
    assert {r.source: r.status for r in lifecycle.sync_status(listing, index).collect()} == {"a": "new", "b": "unchanged", "c": "modified", "d": "deleted", "e": "modified"}
    cache = spark.createDataFrame([("k", "old", 0, 30), ("k", "new", 5, 35), ("x", "gone", 0, 10)], "cache_key string, payload string, created long, expires long")
    assert [(r.cache_key, r.payload) for r in lifecycle.live_entries(cache, 10).collect()] == [("k", "new")]
    assert spark.range(1).select(lifecycle.expires_at(F.lit(0), 0)).first()[0] == 30
    assert lifecycle.upsert(index, spark.createDataFrame([("b", 9.0)], "source string, file_mtime double"), "source").where("source = 'b'").first().file_mtime == 9.0
    empty = spark.createDataFrame([], "doc_id long, updated_at timestamp")
    assert lifecycle.fingerprint(empty, empty) != lifecycle.fingerprint(spark.createDataFrame([(1, None)], "doc_id long, updated_at timestamp"), empty)
    assert lifecycle.cache_key({"b": 1, "a": 2}, "f") == lifecycle.cache_key({"a": 2, "b": 1}, "f")


def test_evaluation(spark):
    rows = [(0, 1, "css only"), (0, 2, "auth token"), (0, 3, "auth css"), (1, 1, None)]
    df = spark.createDataFrame([(q, r, t, ["auth", "token"], ["css"]) for q, r, t in rows], "query_id int, rank int, text string, relevant array<string>, irrelevant array<string>")
    got = {r.query_id: r for r in evaluation.judged(df, 5).collect()}
    assert got[0].precision == pytest.approx(1 / 3) and got[0].recall == 1 and got[0].mrr == 0.5
    assert got[0].ndcg == pytest.approx((1 / math.log2(3) + 0.5 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert (got[1].precision, got[1].mrr, got[1].ndcg) == (0, 0, 0)
    values = [float(x * 7 % 101) for x in range(101)] + [3.0] * 5
    p = evaluation.percentiles(spark.createDataFrame([("a", v) for v in values] + [("a", None)], "k string, v double"), ["k"], "v").first()
    s = sorted(values)
    assert (p.p50, p.p95, p.p99) == tuple(s[len(s) * q // 100] for q in (50, 95, 99))


def test_guard(spark):
    prompts = ["w " * 801, "w " * 3001, "w " * 800, "x\n" * 121, None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string").orderBy("i")
    assert [r[0] for r in rows.select(guard.classify(F.col("p"), F.lit(False))).collect()] == ["compress", "reject", "pass", "warn", "pass"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in (5, 10, 45, 50, 41)], "t int").select(guard.reminder(F.col("t"))).collect()]
    assert got == ["remind", "compact", "reset", "critical", None]
    assert column(spark, ['{"a": {"text": "deep"}}', '{"prompt": "top", "text": "no"}', "{"], lambda c: guard.json_field(c, ["prompt", "text"]))[1] == "top"


def test_graph(spark):
    py = "from a.b import c\nimport d\n\nclass K(Base):\n    pass\n\nasync def run(x, y):\n    return _hidden(len(helper(x)))\n"
    js = "import { a } from './mod';\nconst q = require('lib/q');\nfunction go(a) {}\nconst f = async (x) => 1;\nclass W extends V {}\n"
    rows = spark.createDataFrame([(1, "p/m.py", py), (2, "p/n.js", js), (3, "p/mod.js", "export const z = 1;"), (4, "p/x.zz", py), (5, None, py), (6, "p/d.py", None)], "doc_id long, source string, raw_text string")
    edges = graph.import_edges(rows)
    assert {(r.source_file, r.target_import) for r in edges.collect()} == {("p/m.py", "a.b"), ("p/m.py", "d"), ("p/n.js", "./mod"), ("p/n.js", "lib/q")}
    resolved = {(r.source_file, r.target_import): r.resolved_file for r in graph.resolve_imports(edges, rows).collect()}
    assert resolved[("p/n.js", "./mod")] == "p/mod.js" and resolved[("p/m.py", "d")] == "p/d.py" and resolved[("p/m.py", "a.b")] is None
    assert column(spark, [py], graph.calls) == [["K", "helper", "run"]]
    index = graph.symbol_index(rows.withColumnRenamed("doc_id", "chunk_id").withColumnRenamed("raw_text", "text"))
    assert {(r.symbol_name, r.symbol_type, r.signature) for r in index.collect()} == {("run", "function", "def run(x, y)"), ("K", "class", "class K"), ("go", "function", "function go(a)"), ("f", "function", "const f = () =>"), ("W", "class", "class W")}


def test_patch(spark):
    from strandwork.plans import fixtures

    got = {r.file: r for r in patch.apply_patches(*fixtures.patch_tables(spark)).collect()}
    assert "return 10" in got["a.py"].content and "return 20" in got["a.py"].content and got["a.py"].applied
    assert got["b.py"].content == "x = 1\nx = 1\n" and not got["b.py"].applied and "2 times" in got["b.py"].message
    assert not got["c.py"].applied and got["c.py"].message == "ok"


def test_sources_and_engine(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("skip = 1")
    (tmp_path / "auth.md").write_text("# Auth\nThe middleware checks session tokens. It rejects stale ones.\n")
    (tmp_path / "css.md").write_bytes("# Css\nPalette notes only. Größe zählt.\n".encode("latin-1"))
    (tmp_path / "big.min.js").write_text("x")
    rows = files.read_files(spark, str(tmp_path))
    assert sorted(r.source.rsplit("/", 1)[1] for r in rows.collect()) == ["auth.md", "css.md"]
    e = Engine.index(spark, rows.withColumn("doc_id", F.xxhash64("source")))
    packet = e.query([(0, "session tokens"), (1, "w " * 600)]).collect()
    assert len(packet) == 1 and "session tokens" in packet[0].bullets[0] and "auth.md#chunk-0" in packet[0].bullets[0]
    assert [retrieval_tier(n) for n in (10, 500, 5000)] == ["fts_only", "fts_with_hash", "full_hybrid"]
    assert files.prompt_source(spark, "x").first().source == "intercepted_prompt.txt"


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"tokenReducer": {"chunkSizeWords": 100, "topK": 0, "wordBudget": True, "relevanceFloor": 0.18}}))
    s = settings.load(str(tmp_path / "none.json"), str(p))
    assert (s.chunk_words, s.top_k, s.word_budget, s.relevance_floor) == (100, 3, 150, 0.18)


def test_streams(spark, tmp_path, small):
    from strandwork.streaming import sessions

    ev = spark.createDataFrame([("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-01 00:10:00", "x"), ("b", "2024-01-01 02:00:00", "y")], "session string, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = sessions.turns(stream).writeStream.format("memory").queryName("turns").start()
    q.processAllAvailable(); q.stop()
    assert sorted((r.session, r.turn) for r in spark.table("turns").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    q = sessions.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").start()
    q.processAllAvailable(); q.stop()
    assert sorted(r.n for r in spark.table("activity").collect()) == [1, 2]


def test_pruning_and_pushdown(spark, small):
    from strandwork.plans import catalogue

    plan = catalogue.imported_files(spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(resolved_file)]" in plan and "ReadSchema: struct<source_file:string,resolved_file:string>" in plan


def test_forms():
    import re

    from strandwork.functions.forms import either, form

    assert re.findall(form("async? def NAME ARGS"), "async  def f( a )\nxdef g()") == [("f", " a "), ("g", "")]
    assert re.findall(form("func RECEIVER? NAME ARGS"), "func (r *T) Go(a int) {}\nfunc f()") == [("Go", "a int"), ("f", "")]
    assert re.findall(form("fn NAME GENERICS? ARGS"), "fn f<T: X>(a: T)\nfn g ()") == [("f", "a: T"), ("g", "")]
    assert re.findall(form("import LITTLE from PATH"), "import { a } from './m'") == ["./m"]
    assert not re.search(form("from DOTTED import", start=True), " from a import b") and re.search(form("from DOTTED import", start=True), "x\nfrom a.b import c")
    one = either("export? class NAME", "type WORD struct|interface")
    assert [m.group() for m in re.finditer(one, "class A\n class B\nexport class C\ntype D interface")] == ["class A", "export class C", "type D interface"]
    assert [bool(re.search(chunking.BOUNDARIES[s], x)) for s, x in ((".py", "@dec"), (".py", "x = class y"), (".rs", "impl<T> A for B"), (".java", "public static void main("), (".c", "return;"))] == [True, False, True, True, False]


def test_syntax_trees(spark):
    from strandwork.operators import syntax

    text = "import x\n@dec\ndef f(a):\n    def g():\n        pass\n    return g\n\nif x:\n    class K:\n        def m(self):\n            return 1\n"
    assert syntax.segments(text) == ["@dec\ndef f(a):\n    def g():\n        pass\n    return g", "    class K:\n        def m(self):\n            return 1"]
    assert syntax.segments("def (") == syntax.segments(None) == syntax.segments("x = 1") == []
    new, why = syntax.replace_definition(text, "method", "K.m", "def m(self):\n  return 2\n")
    assert why == "ok" and "        def m(self):\n          return 2\n" in new and new.startswith("import x\n@dec\ndef f")
    assert syntax.replace_definition(text, "function", "nope", "x")[0] is None and syntax.replace_definition("def (", "class", "K", "x") == (None, "no syntax tree")
    docs = spark.createDataFrame([(1, "a.py", text), (2, "b.py", "def ("), (3, "c.md", "plain words")], "doc_id long, source string, cleaned_text string")
    got = {r.doc_id: r.text for r in chunking.chunk_documents(docs, 100, 20, trees=True).collect()}
    assert "import x" not in got[1] and "@dec" in got[1] and got[2] == "def (" and got[3] == "plain words"


def test_patch_transactions(spark, tmp_path):
    from strandwork.plans.fixtures import BLOCK

    named = lambda f, a, b: BLOCK.format(a, b).replace("SEARCH", f"SEARCH ({f})", 1)
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "b.py").write_text("z = 1\n")
    text = named("a.py", "x = 1", "x = 5") + named("b.py", "z = 1", "z = 9") + named("b.py", "nope", "no") + named("c.py", "a", "b") + BLOCK.format("q", "r")
    dry = patch.apply_to_folder(text, tmp_path, dry_run=True)
    assert (tmp_path / "a.py").read_text() == "x = 1\ny = 2\n" and (dry["applied"], dry["failed"]) == (1, 4)
    assert patch.apply_to_folder(text, tmp_path)["applied"] == 1
    assert (tmp_path / "a.py").read_text() == "x = 5\ny = 2\n" and (tmp_path / "b.py").read_text() == "z = 1\n"
    files = spark.createDataFrame([("a.py", "x = 1\n")], "file string, content string")
    patches = spark.createDataFrame([("a.py", BLOCK.format("x = 1", "x = 2")), ("gone.py", BLOCK.format("a", "b")), ("a.py", None)], "file string, patch string")
    rows = {r.file: r for r in patch.apply_patches(files, patches, dry_run=True).collect()}
    assert rows["a.py"].content == "x = 1\n" and rows["a.py"].applied == 1 and rows["gone.py"].failed == 1 and rows["gone.py"].content is None


def test_deep_prompt_fields(spark):
    payloads = ['{"a": [{"b": {"message": "deep"}}], "session_id": " "}', '{"prompt": "top", "x": {"user_prompt": "no"}}', '{"n": 1, "list": ["leaf"], "meta": {"conversationId": " c7 "}}', "[]", "{", None, '{"a":' * 300 + '"end"' + "}" * 300]
    assert column(spark, payloads, guard.prompt_of) == ["deep", "top", "leaf", "", None, None, "end"]
    assert column(spark, payloads[:4], guard.session_of) == ["default", "default", "c7", "default"]


def test_fusion_of_rows_and_weights(spark):
    a = spark.createDataFrame([(0, 1, 1, -2.0, 0.0)], "query_id int, chunk_id long, fts_rank int, bm25 double, vector_score double")
    b = spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 1, 0.9)], "query_id int, chunk_id long, vector_rank int, vector_score double")
    got = {r.chunk_id: r for r in fusion.fuse(a, b).collect()}
    assert (got[1].vector_score, got[1].vector_rank, got[1].fts_rank) == (0.0, 2, 1) and (got[2].vector_score, got[2].bm25) == (0.9, None)
    assert fusion.weights({"overlap": 0.5}).overlap == 0.5 and fusion.weights().fts == 0.5
    for bad in ({"nope": 1}, {"fts": True}, {"fts": "1"}):
        with pytest.raises(ValueError):
            fusion.weights(bad)
    runs = spark.createDataFrame([("s", i, i + 10, "t", 5, 0.1 * i, 1.0 - i, i) for i in (0, 1, 3)], "source string, chunk_index int, chunk_id long, text string, token_estimate int, final_score double, overlap double, fts_rank int")
    got = {r.first_index: r for r in fusion.merge_runs(runs, ["source"]).collect()}
    assert (got[0].merged, got[0].token_estimate, got[0].overlap, got[0].fts_rank, got[0].chunk_id) == (2, 10, 1.0, 0, 10) and got[3].merged == 1


def test_report(spark):
    p = spark.createDataFrame([(100, 20, 300), (50, 10, 60)], "selected_tokens long, compressed_tokens int, pool_tokens long")
    q = spark.createDataFrame([(0.9, 0.8, 1.0, 0.7)], "precision double, recall double, mrr double, ndcg double")
    t = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    r = evaluation.report(p, q, t, 1_000_000, 5.0)
    assert r["tokens"]["ratio"] == 5.0 and r["quality"]["label"] == "Excellent" and r["latency_ms"]["p95"] == 96.0 and r["cost_usd"]["baseline"] == 3.0
    assert "| p95 | 96.0 |" in evaluation.report_markdown(r) and "## cost usd" in evaluation.report_markdown(r)
    values = [1e9] + [float(x % 37) for x in range(500)]
    got = evaluation.percentiles(spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)], "k string, v double"), ["k"], "v").where("k = 'a'").first()
    assert (got.p50, got.p95, got.p99) == tuple(sorted(values)[len(values) * x // 100] for x in (50, 95, 99))


def test_embedding_backends(spark):
    from strandwork.operators import embedding

    rows = spark.createDataFrame([(i, "abc"[: i % 4]) for i in range(150)] + [(999, None)], "chunk_id long, text string")
    load = lambda: (lambda texts: np.array([[len(t), 1.0] for t in texts]))
    got = {r.chunk_id: r for r in embedding.embed_with(rows, " ML", {"ml": load}, 2).collect()}
    assert len(got) == 150 and got[3].vector == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[3].backend == "ml"
    assert embedding.resolve("onnx", {}) == embedding.resolve(None, {}) == embedding.resolve("odd", {"odd": load}) == "hash"
    assert embedding.embed_with(rows, "onnx", {}, 8).first().backend == "hash"
    pooled = embedding.mean_pool(np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert pooled.tolist() == [[2.0, 3.0]]
    with pytest.raises(Exception, match="instead of"):
        embedding.embed(rows, "narrow", load, 3).count()


@pytest.mark.parametrize("n", [40, 1400])
def test_stored_ann(spark, tmp_path, n):
    from strandwork.operators import ann

    x = np.random.default_rng(3).normal(size=(n, 8))
    path = ann.open_or_build(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, vector array<double>"), str(tmp_path / "ann"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = ann.search(spark, path, x[5].tolist(), 10)
    assert [r.chunk_id for r in found.collect()] == np.argsort(-(unit @ unit[5]), kind="stable")[:10].tolist()
    assert ann.stem(spark, "ml", 96, "a/b c") == "ml_96_a_b_c" and ann.stem(spark, "hash", 8, None) == "hash_8_none"
    texts = spark.createDataFrame([(5, "five"), (6, "six")], "chunk_id long, text string")
    assert "five" in {r.text for r in ann.with_chunks(found, texts).collect()}


def test_store(spark, tmp_path):
    from strandwork.sources.store import SCHEMAS, Store

    spark.createDataFrame([(1, 2)], "chunk_id long, doc_id long").write.parquet(str(tmp_path / "s" / "chunks"))  # an older table
    store = Store.open(spark, str(tmp_path / "s"))
    assert store.read("chunks").collect() == [(1, 2, None, None, None)] and set(spark.read.parquet(str(tmp_path / "s" / "chunks")).columns) == {"chunk_id", "doc_id", "chunk_index", "text", "token_estimate"}
    store.append("chunks", spark.createDataFrame([(7, "x", "clash")], "chunk_id long, text string, extra string"))
    store.upsert("chunks", spark.createDataFrame([(7, "y")], "chunk_id long, text string"), "chunk_id")
    assert {(r.chunk_id, r.text) for r in store.read("chunks").collect()} == {(1, None), (7, "y")}
    assert {r.name for r in store.vacuum().collect()} == set(SCHEMAS) and store.read("chunks").count() == 2
    with pytest.raises(Exception):
        store.replace("chunks", spark.range(1).select(F.raise_error(F.lit("no")).alias("chunk_id")))
    assert store.read("chunks").count() == 2


def test_upsert_cache_and_adaptive_search(spark, tmp_path):
    from strandwork.plans.engine import vector_path

    files_ = spark.createDataFrame([(1, "a.md", "Session tokens are checked here. They expire."), (2, "b.md", "Palette notes only."), (3, "c.md", "Tokens of another kind.")], "doc_id long, source string, raw_text string")
    e = Engine.index(spark, files_)
    e.embeddings = spark.createDataFrame([], "chunk_id long, embedding_json string, backend string, dimensions int, model_name string")
    again = e.upsert(spark.createDataFrame([(9, "b.md", "Now about session tokens too."), (4, "d.md", "")], "doc_id long, source string, raw_text string"))
    assert {r.doc_id for r in again.raw_chunks.collect()} == {1, 3, 9} == {r.doc_id for r in again.documents.collect()}
    assert again.embeddings.count() == 1 and {r.chunk_id for r in again.lexical([(0, "palette")]).collect()} == set()
    cache, q = str(tmp_path / "cache"), [(0, "session tokens"), (1, "???")]
    first, second, late = ({r.query_id: r for r in again.answer(q, cache, now=t).collect()} for t in (1000, 1500, 5000))
    assert [r[0].hit for r in (first, second, late)] == [False, True, False] and first[0].payload == second[0].payload
    packet = json.loads(first[0].payload)
    assert packet["packet"].startswith("CONTEXT_PACKET_START\nquery: session tokens\nselected_chunks: ") and "\n- " in packet["packet"] and json.loads(first[1].payload)["bullets"] == []
    assert again.with_settings(top_k=1).answer(q[:1], cache, now=1500).first().hit is False  # settings are part of the key
    assert e.answer(q[:1], cache, now=1500).first().hit is False  # so is the state of the index
    hits = spark.createDataFrame([(0,), (5,)], "n long").orderBy("n")
    path = lambda *a: [r[0] for r in hits.select(vector_path(*a[:2], F.col("n"), 3, a[2])).collect()]
    assert path("fts_only", "fallback", "ml") == ["disabled_small_codebase"] * 2 and path("fts_only", "always", "ml") == ["scan"] * 2
    assert path("full_hybrid", "fallback", "ml") == ["scan", "disabled"] and path("fts_with_hash", "fallback", "hash") == ["skipped_hash_backend", "disabled"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import io

    from strandwork import __main__ as cli

    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "auth.md").write_text("The middleware checks session tokens. It rejects stale ones.\n")
    (src / "css.md").write_text("Palette notes only.\n")
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    monkeypatch.setattr(cli, "_session", lambda: spark)
    code, out = run("run", "--store", store, "--inputs", str(src), "--query", "session tokens", "--json")
    found = json.loads(out.strip().splitlines()[-1])
    assert code == 0 and {"query", "selected_chunks", "token_metrics", "retrieval", "packet"} <= found.keys() and found["selected_chunks"] == 1 and not found["cache"]["hit"]
    assert json.loads(run("query", "--store", store, "--query", "session tokens", "--json")[1])["cache"]["hit"]
    assert run("query", "--store", store, "--query", "w " * 600)[0] == 2
    (tmp_path / "none").mkdir()
    assert run("index", "--store", store, "--inputs", str(tmp_path / "none"))[0] == 1
    (src / "css.md").unlink()
    (src / "new.md").write_text("Fresh ledger words.\n")
    assert json.loads(run("sync", "--store", store, "--inputs", str(src))[1]) == {"new": 1, "modified": 0, "deleted": 1}
    assert json.loads(run("gc", "--store", store, "--vacuum")[1])["chunks"] == 0
    stats = json.loads(run("stats", "--store", store)[1])
    assert stats["rows"]["documents"] == stats["rows"]["chunks"] == 2 and stats["bytes"]["chunks"] > 0
    monkeypatch.setattr("sys.stdin", io.StringIO("Alpha beta. Gamma delta words here."))
    code, out = run("compress-raw")
    assert code == 0 and "intercepted_prompt.txt#chunk-0" in out and out.startswith("CONTEXT_PACKET_START")
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"deep": {"prompt": "word " * 900}, "session_id": "s"})))
    told = json.loads(run("guard", "--turn", "10")[1])
    assert (told["verdict"], told["reminder"], told["session"]) == ("compress", "compact", "s") and told["transformedPrompt"]
    report = cli.benchmark(cli.open_engine(cli.Store.open(spark, store), settings.Settings()), [("session tokens", ["session"], ["css"])], ["ledger"])
    assert report["summary"]["queries"] == 2 and report["quality"]["mrr"] == 1.0
