"""SQL equivalents of the registered queries, for another engine to run on the same tables.

Queries without one (hash features, k-means, syntax trees) are tested against brute force or exact values."""

from __future__ import annotations

from strandwork.functions import text as T
from strandwork.operators import chunking, compress, evaluation, graph, guard, lexical
from strandwork.plans import fixtures as X

_WS = r"[ \t\n\x0B\f\r]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def _words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^ \t\n\x0B\f\r]+')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9_]+')"


def _index(x: str) -> str:
    return rf"regexp_extract_all(regexp_replace(translate(lower({x}), {_q(T.ACCENTED)}, {_q(T.PLAIN)}), '\p{{M}}+', '', 'g'), '[\p{{L}}\p{{N}}]+')"


def _estimate(x: str) -> str:
    return f"greatest(1, coalesce(len({_words(x)}), 0) * 13 // 10)::INT"


def _name(x: str) -> str:
    return f"string_split({x}, '/')[-1]"


def _suffix(x: str) -> str:
    return rf"regexp_extract(lower({_name(x)}), '^.+(\.[^.]+)$', 1)"


def _is_code(x: str) -> str:
    return f"{_suffix(x)} IN {_in(T.CODE_SUFFIXES)}"


def _trim_words(x: str, n: int) -> str:
    w = _words(x)
    return f"CASE WHEN len({w}) <= {n} THEN array_to_string({w}, ' ') ELSE regexp_replace(array_to_string(list_slice({w}, 1, {n}), ' '), '[.,;:]+$', '') || '...' END"


def _cite(source: str, index: str) -> str:
    return f"'[' || {_name(source)} || '#chunk-' || {index} || ']'"


_C = "(SELECT DISTINCT * FROM chunks)"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace(trim(text, ' '), '([.!?]){_WS}', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
_BACKEND = "CASE WHEN lower(trim(backend, ' ')) IN ('hash', 'onnx', 'ml') THEN lower(trim(backend, ' ')) ELSE 'hash' END"


def _bm25(queries) -> str:
    """CTEs up to scored (query_id, chunk_id, bm25)."""
    rows = ", ".join(f"({q}, {i}, {_q(p)})" for q, t in queries for i, p in enumerate(lexical.phrase_terms(t)))
    return f"""ck AS (SELECT DISTINCT * FROM chunks),
      tk AS (SELECT chunk_id, ' ' || array_to_string({_index('text')}, '  ') || ' ' AS body, coalesce(len({_index('text')}), 0) AS n FROM ck),
      terms(query_id, ordinal, phrase) AS (VALUES {rows}),
      stats AS (SELECT count(*) AS total, avg(n) AS mean FROM tk),
      hits AS (SELECT chunk_id, phrase, n, (len(body) - len(replace(body, ' ' || replace(phrase, ' ', '  ') || ' ', ''))) // (len(replace(phrase, ' ', '  ')) + 2) AS tf
        FROM tk, (SELECT DISTINCT phrase FROM terms) p WHERE contains(body, ' ' || replace(phrase, ' ', '  ') || ' ')),
      df AS (SELECT phrase, count(*) AS df FROM hits GROUP BY phrase),
      idf AS (SELECT phrase, CASE WHEN ln((total - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - df + 0.5) / (df + 0.5)) END AS idf FROM df, stats),
      scored AS (SELECT query_id, chunk_id, -sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS bm25
        FROM hits JOIN idf USING (phrase) JOIN terms USING (phrase), stats GROUP BY query_id, chunk_id)"""


_TOP = "live AS (SELECT s.* FROM scored s WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents))), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS rank FROM live QUALIFY rank <= 12)"
_VEC = "list_transform(json_extract(CASE WHEN json_valid(embedding_json) AND json_type(embedding_json) = 'ARRAY' THEN embedding_json ELSE '[]' END, '$[*]'), lambda x: TRY_CAST(x AS DOUBLE))"
_USABLE = "len(v) = dimensions AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"
_LATEST = f"""qv AS (SELECT * FROM (SELECT *, {_VEC} AS v FROM query_embeddings WHERE embedding_json IS NOT NULL) WHERE {_USABLE}),
      lq AS (SELECT * FROM qv WHERE coalesce(updated_at, created_at) IS NOT NULL ORDER BY coalesce(updated_at, created_at) DESC, query_key DESC LIMIT 1),
      cv AS (SELECT DISTINCT chunk_id, v FROM (SELECT c.chunk_id, c.dimensions, {_VEC.replace('embedding_json', 'c.embedding_json')} AS v FROM chunk_embeddings c, lq WHERE lower(trim(c.backend, ' ')) = lower(trim(lq.backend, ' ')) AND c.dimensions = lq.dimensions AND c.model_name IS NOT DISTINCT FROM lq.model_name AND c.embedding_json IS NOT NULL) WHERE {_USABLE}),
      vs AS (SELECT DISTINCT chunk_id, list_sum(list_transform(range(1, len(cv.v) + 1), lambda i: cv.v[i] * lq.v[i])) AS score FROM cv, lq),
      vt AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM vs WHERE score > 0 QUALIFY rank <= 20)"""
_DISK = "disk AS (SELECT source, max(mtime) AS disk FROM file_listing WHERE source IS NOT NULL GROUP BY source), known AS (SELECT source, max(file_mtime) AS known FROM documents WHERE source IS NOT NULL GROUP BY source)"
_SYNC = _DISK + """, sync AS (SELECT coalesce(d.source, k.source) AS source, CASE WHEN k.source IS NULL THEN 'new' WHEN d.source IS NULL THEN 'deleted' WHEN k.known IS NULL OR d.disk > k.known THEN 'modified' ELSE 'unchanged' END AS status
      FROM disk d FULL OUTER JOIN known k ON d.source = k.source)"""


def _imports() -> str:
    parts = []
    for s, patterns in graph.IMPORTS.items():
        for p, g in patterns:
            parts.append(f"SELECT DISTINCT source AS source_file, unnest(regexp_extract_all(raw_text, {_q(p)}, {g})) AS target_import FROM documents WHERE raw_text IS NOT NULL AND source IS NOT NULL AND {_suffix('source')} = {_q(s)}")
    return "edges AS (" + " UNION ".join(parts) + ")"


def _symbols() -> str:
    parts = []
    for s, kinds in graph.SYMBOLS.items():
        for kind, p, head, arguments in kinds:
            name = f"regexp_extract_all(text, {_q(p)}, 1)"
            if arguments:
                sign = f"list_transform(list_zip({name}, regexp_extract_all(text, {_q(p)}, 2)), lambda z: {{'n': z[1], 's': {_q(head)} || z[1] || '(' || z[2] || ')'}})"
            else:
                tail = {"const ": " = () =>", "type ": " struct"}.get(head, "")
                sign = f"list_transform({name}, lambda z: {{'n': z, 's': {_q(head)} || z || {_q(tail)}}})"
            parts.append(f"SELECT source AS file_path, unnest({sign}) AS s, {_q(kind)} AS symbol_type, chunk_id FROM src WHERE {_suffix('source')} = {_q(s)}")
    return f"""src AS (SELECT chunk_id, source, text FROM {_C} c JOIN documents USING (doc_id) WHERE c.text IS NOT NULL),
      sym AS (SELECT DISTINCT file_path, s.n AS symbol_name, symbol_type, s.s AS signature, chunk_id FROM ({" UNION ALL ".join(parts)}))""".replace("SELECT chunk_id, source, text FROM", "SELECT c.chunk_id, source, c.text FROM")


def _tidy(path: str, depth: int = 12) -> str:
    out = rf"regexp_replace({path}, '/(\./)+', '/', 'g')"
    for _ in range(depth):
        out = rf"regexp_replace({out}, '(^|/)[^/.][^/]*/\.\./', '\1')"
    return out


def _chunked_lines(rows: str, size: int) -> str:
    """CTEs up to lines(key, n, t): the chunks of (key, text) of at most ``size`` words, whole lines, without overlap."""
    return f"""ll AS (SELECT key, string_split(text, chr(10)) AS l FROM {rows}), lw AS (SELECT key, l, list_transform(l, lambda x: greatest(1, len({_words('x')}))) AS w FROM ll),
      lp AS (SELECT key, l, len(l) AS c, list_transform(range(0, len(l) + 1), lambda k: coalesce(list_sum(list_slice(w, 1, k)), 0)::INT) AS p FROM lw),
      lr AS (SELECT key, l, c, p, 0 AS n, 0 AS s, greatest(1, len(list_filter(p, lambda x: x <= {size})) - 1) AS e FROM lp UNION ALL SELECT key, l, c, p, n + 1, e, greatest(e + 1, len(list_filter(p, lambda x: x <= p[e + 1] + {size})) - 1) FROM lr WHERE e < c),
      lines AS (SELECT key, n, array_to_string(list_slice(l, s + 1, e), chr(10)) AS t FROM lr)"""


def _chunk_code(size: int = 100) -> str:
    """Boundaries cut segments; segments are packed; what is too long, or has no boundaries, is cut by lines."""
    most = max(size, chunking.SMALLEST)
    opens = " OR ".join(f"(sfx = {_q(k)} AND regexp_matches(l[i], {_q(v)}))" for k, v in chunking.BOUNDARIES.items())
    return f"""WITH RECURSIVE d AS (SELECT doc_id, cleaned_text, {_suffix('source')} AS sfx, string_split(cleaned_text, chr(10)) AS l FROM documents WHERE {_is_code('source')} AND length(cleaned_text) > 0),
      b AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: {opens}) AS st FROM d), a AS (SELECT *, list_distinct(list_concat([1], st)) AS al FROM b WHERE len(st) > 0), so AS (SELECT *, list_sort(al) AS ss FROM a),
      pt AS (SELECT doc_id, k, {_strip("array_to_string(list_slice(l, ss[k], coalesce(ss[k + 1] - 1, len(l))), chr(10))")} AS text FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS k FROM so)),
      sg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, text, len({_words('text')}) AS w FROM pt WHERE text <> ''),
      plain AS (SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM sg)),
      whole AS (SELECT 's:' || doc_id || ':' || k AS key, text FROM sg WHERE w > {2 * most} UNION ALL SELECT 'd:' || doc_id, cleaned_text FROM d WHERE doc_id IN (SELECT doc_id FROM plain)),
      {_chunked_lines('whole', size)}, cut AS (SELECT key, list(t ORDER BY n) AS ts FROM lines GROUP BY key),
      sc AS (SELECT sg.*, coalesce(ts, []) AS ts FROM sg LEFT JOIN cut ON cut.key = 's:' || doc_id || ':' || k),
      f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::VARCHAR[] AS buf, 0::BIGINT AS n, []::VARCHAR[] AS done FROM sc
        UNION ALL SELECT f.doc_id, sc.k, CASE WHEN w > {2 * most} THEN []::VARCHAR[] WHEN n + w > {most} AND len(buf) > 0 THEN [text] ELSE list_append(buf, text) END,
          CASE WHEN w > {2 * most} THEN 0 WHEN n + w > {most} AND len(buf) > 0 THEN w ELSE n + w END,
          CASE WHEN w > {2 * most} THEN list_concat(CASE WHEN len(buf) > 0 THEN list_append(done, array_to_string(buf, chr(10) || chr(10))) ELSE done END, ts) WHEN n + w > {most} AND len(buf) > 0 THEN list_append(done, array_to_string(buf, chr(10) || chr(10))) ELSE done END
        FROM f JOIN sc ON sc.doc_id = f.doc_id AND sc.k = f.k + 1),
      o AS (SELECT doc_id, CASE WHEN len(buf) > 0 THEN list_append(done, array_to_string(buf, chr(10) || chr(10))) ELSE done END AS ts FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1
        UNION ALL SELECT doc_id, ts FROM plain JOIN cut ON cut.key = 'd:' || doc_id),
      kept AS (SELECT doc_id, list_filter(ts, lambda x: {_strip('x')} <> '') AS ts FROM o), e AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS chunk_index FROM kept)
      SELECT doc_id, chunk_index, {_estimate('t')} AS token_estimate, md5(t) AS digest FROM e"""


def _queries(queries) -> str:
    return "q(query_id, query) AS (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in queries) + ")"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _signatures(x: str) -> str:
    heads = f"list_filter(list_transform(regexp_extract_all({x}, {_q(compress.SIGNATURES)}, 0), lambda h: {_strip('h')}), lambda h: len({_words('h')}) >= 2)"
    short = "CASE WHEN len(string_split(h, chr(10))) > 3 THEN array_to_string(list_slice(string_split(h, chr(10)), 1, 3), chr(10)) || ' ...' ELSE h END"
    docs = f"list_filter(list_transform(list_transform(regexp_extract_all({x}, {_q(compress.DOCS)}, 0), lambda h: {_strip('h')}), lambda h: {short}), lambda h: len({_words('h')}) >= 3)"
    return f"list_concat({heads}, {docs})"


def _ranked_sentences(rows: str) -> str:
    """CTEs up to picked (key, summary) from a relation of (key, text, query)."""
    overlap = "len(list_intersect(t[i + 1], t[j + 1]))::DOUBLE / (len(t[i + 1]) + len(t[j + 1]) - len(list_intersect(t[i + 1], t[j + 1])))"
    return f"""sn AS (SELECT key, query, {_SENT} AS ss FROM {rows} WHERE text IS NOT NULL),
      st AS (SELECT key, query, ss, len(ss) AS n, list_transform(ss, lambda s: list_distinct({_tokens('s')})) AS t FROM sn WHERE len(ss) > 0),
      mx AS (SELECT key, n, list_transform(range(n), lambda i: list_transform(range(n), lambda j: CASE WHEN i = j OR len(t[i + 1]) + len(t[j + 1]) = 0 THEN 0 ELSE {overlap} END)) AS m FROM st WHERE n > 2),
      tot AS (SELECT key, n, list_transform(m, lambda r: list_sum(r)) AS o, m FROM mx),
      it AS (SELECT key, 0 AS k, list_transform(range(n), lambda i: 1.0::DOUBLE / n) AS v FROM tot
        UNION ALL SELECT it.key, k + 1, list_transform(range(n), lambda j: 0.15::DOUBLE / n + 0.85::DOUBLE * list_sum(list_transform(range(n), lambda i: CASE WHEN o[i + 1] > 0 THEN m[i + 1][j + 1] / o[i + 1] * v[i + 1] ELSE 0 END))) FROM it JOIN tot USING (key) WHERE k < 30),
      ce AS (SELECT st.key, query, ss, t, CASE WHEN n <= 2 THEN list_transform(range(n), lambda i: 1.0::DOUBLE) WHEN list_max(v) > 0 THEN list_transform(v, lambda x: x / list_max(v)) ELSE v END AS r FROM st LEFT JOIN it ON it.key = st.key AND k = 30),
      sc AS (SELECT key, pos, ss[pos + 1] AS sentence, 0.5::DOUBLE * r[pos + 1] + CASE WHEN len(qt) > 0 THEN 0.35::DOUBLE * len(list_intersect(qt, t[pos + 1])) / len(qt) ELSE 0 END + 0.1::DOUBLE * least(1.0::DOUBLE, len({_words('ss[pos + 1]')})::DOUBLE / 24) AS score
        FROM (SELECT *, list_distinct({_tokens('query')}) AS qt, unnest(range(len(ss))) AS pos FROM ce)),
      rs AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(score, 9) DESC, pos) AS place FROM sc QUALIFY place <= 2),
      picked AS (SELECT key, string_agg(sentence, ' ' ORDER BY place) AS summary FROM rs GROUP BY key)"""


def _packet(vector: bool) -> str:
    """CTEs up to packet (one row a query)."""
    near = "vr AS (SELECT query_id, chunk_id, rank AS vector_rank, score AS vector_score FROM vt, q)" if vector else "vr AS (SELECT 0 AS query_id, 0 AS chunk_id, 0 AS vector_rank, 0.0 AS vector_score WHERE false)"
    final = "coalesce(1.0::DOUBLE / (60 + fts_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0)" if vector else f"0.5::DOUBLE * (0.35::DOUBLE / fts_rank + 0.65::DOUBLE / (1 + abs(bm25))) + 0.15::DOUBLE * {_overlap('query', 'text')}"
    n, cut = f"len({_words('bullet')})", _trim_words("bullet", 150)
    return f"""WITH RECURSIVE {_bm25(X.QUERIES)}, {_TOP}, {_LATEST}, {_queries(X.QUERIES)}, {near},
      src AS (SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(chunk_index) AS chunk_index, any_value(c.text) AS text, any_value(token_estimate) AS token_estimate, any_value(source) AS source FROM ck c JOIN documents USING (doc_id) GROUP BY chunk_id),
      cand AS (SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.chunk_id, v.chunk_id) AS chunk_id, bm25, t.rank AS fts_rank, vector_rank FROM top t FULL OUTER JOIN vr v ON t.query_id = v.query_id AND t.chunk_id = v.chunk_id),
      pool AS (SELECT *, {final} AS final_score FROM cand JOIN src USING (chunk_id) JOIN q USING (query_id)),
      chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS place FROM pool QUALIFY place <= 3),
      once AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, source, chunk_index ORDER BY chunk_id) = 1),
      isl AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, doc_id, source ORDER BY chunk_index, chunk_id) AS run FROM once),
      runs AS (SELECT query_id, any_value(query) AS query, source, min(chunk_index) AS first_index, arg_min(chunk_id, chunk_index) AS chunk_id, max(final_score) AS final_score, string_agg(coalesce(text, ''), chr(10) ORDER BY chunk_index) AS text FROM isl GROUP BY query_id, doc_id, source, run),
      rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS place, {_cite('source', 'first_index')} AS cite, coalesce({_is_code('source')}, false) AS code FROM runs),
      ov AS (SELECT *, query_id || ':' || place AS key FROM rk WHERE final_score >= 0.15), pt AS (SELECT key, text, query FROM ov WHERE NOT code), {_ranked_sentences('pt')},
      cs AS (SELECT query_id, place, cite, {_signatures('text')} AS sg, list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '') AS pl FROM ov WHERE code),
      said AS (SELECT query_id, place, cite, trim(array_to_string(list_slice(CASE WHEN len(sg) > 0 THEN sg ELSE pl END, 1, 4), ' | '), ' ') AS summary FROM cs UNION ALL SELECT query_id, place, cite, summary FROM ov JOIN picked USING (key)),
      bl AS (SELECT query_id, summary || ' ' || cite AS bullet, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM said WHERE summary <> ''),
      fo AS (SELECT DISTINCT query_id, 0::BIGINT AS r, []::VARCHAR[] AS kept, 0::BIGINT AS used FROM bl
        UNION ALL SELECT fo.query_id, bl.r, CASE WHEN used >= 150 THEN kept WHEN len(kept) = 0 AND {n} > 150 THEN list_append(kept, {cut}) WHEN len(kept) = 0 OR used + {n} <= 150 THEN list_append(kept, bullet) ELSE kept END,
        CASE WHEN used >= 150 THEN used WHEN len(kept) = 0 AND {n} > 150 THEN 150 WHEN len(kept) = 0 OR used + {n} <= 150 THEN used + {n} ELSE used END FROM fo JOIN bl ON bl.query_id = fo.query_id AND bl.r = fo.r + 1),
      pk AS (SELECT query_id, kept FROM fo QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC) = 1),
      sp AS (SELECT query_id, list(array_to_string(list_slice({_words('text')}, 1, 35), ' ') || '... ' || cite ORDER BY place) AS spare FROM rk WHERE place <= 3 GROUP BY query_id),
      agg AS (SELECT q.query_id, count(p.chunk_id) AS pool, coalesce(sum(token_estimate), 0) AS pool_tokens FROM q LEFT JOIN pool p USING (query_id) GROUP BY q.query_id),
      sel AS (SELECT query_id, count(*) AS selected_chunks, count(DISTINCT source) AS sources, sum(token_estimate) AS selected_tokens FROM chosen GROUP BY query_id),
      hit AS (SELECT q.query_id, any_value(query) AS query, count(t.chunk_id) AS fts_hits FROM q LEFT JOIN top t USING (query_id) GROUP BY q.query_id),
      one AS (SELECT query_id, query, fts_hits, (SELECT count(*) FROM vr WHERE vr.query_id = hit.query_id) AS vector_hits, coalesce(kept, spare, []) AS bullets, coalesce(selected_chunks, 0) AS selected_chunks, coalesce(sources, 0) AS sources, coalesce(selected_tokens, 0) AS selected_tokens, pool, pool_tokens
        FROM hit JOIN agg USING (query_id) LEFT JOIN sel USING (query_id) LEFT JOIN pk USING (query_id) LEFT JOIN sp USING (query_id)),
      used AS (SELECT *, coalesce(list_sum(list_transform(bullets, lambda b: {_estimate('b')})), 0)::INT AS compressed_tokens FROM one),
      packet AS (SELECT *, greatest(0, selected_tokens - compressed_tokens)::BIGINT AS saved_tokens, CASE WHEN pool_tokens > 0 THEN round(100.0::DOUBLE * greatest(0, pool_tokens - compressed_tokens) / pool_tokens, 2) ELSE 0 END AS pool_saved_pct FROM used)"""


def _overlap(query: str, text: str) -> str:
    return f"len(list_intersect(list_distinct({_tokens(query)}), {_tokens(f'coalesce({text}, chr(32))')}))::DOUBLE / len(list_distinct({_tokens(query)}))"


def oracle_sql() -> dict[str, str]:
    calls = f"list_sort(list_distinct(list_filter(regexp_extract_all(text, {_q(graph.CALLED)}, 1), lambda n: n NOT IN {_in(graph.NOT_CALLS)} AND n[1] NOT IN {_in('_0123456789')})))"
    line = rf"trim(regexp_replace(line, '{_WS}', ' ', 'g'), ' ')"
    low = "lower(coalesce(text, ''))"
    noise = f"lower(x) IN {_in(T.NOISE_LINES)} OR starts_with(lower(x), {_q(T.NOISE_START)}) OR (starts_with(lower(x), {_q(T.NOISE_YEAR)}) AND regexp_matches(substring(x, {len(T.NOISE_YEAR) + 1}, 4), '^[0-9]{{4}}$'))"
    judged = ", ".join(f"({q}, {r}, {i}::VARCHAR[])" for q, r, i in X.JUDGED)
    keywords = "list_filter(relevant, lambda k: contains(body, lower(k)))"
    g = guard
    tables = ("documents", "chunks", "chunk_embeddings", "query_embeddings", "file_dependencies")
    dirs = f"len(list_filter(string_split(source, '/'), lambda x: x IN {_in(T.SKIPPED_DIRS)})) = 0"
    skipped = lambda size: rf"(lower({_name('source')}) IN {_in(T.SKIPPED_NAMES)} OR regexp_matches(lower({_name('source')}), {_q(T.SKIPPED_ENDINGS)}) OR {_suffix('source')} = '.svg' OR coalesce({size} > {T.MAX_FILE_BYTES}, true))"
    return {
        "token_stats": f"SELECT doc_id, len({_tokens('text')})::INT AS n_tokens, len(list_distinct({_tokens('text')}))::INT AS n_distinct FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        "token_estimate": f"SELECT chunk_id, chunk_index, {_estimate('text')} AS estimate, {_estimate('text')} - coalesce(token_estimate, 0) AS off_by FROM {_C}",
        "char_trigrams": f"""WITH w AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({_tokens('text')})) AS token FROM {_C}) GROUP BY token),
            p AS (SELECT n, '^' || token || '$' AS p FROM w), g AS (SELECT n, unnest(list_transform(range(1, len(p) - 1), lambda i: substring(p, i, 3))) AS gram FROM p)
            SELECT gram, sum(n)::BIGINT AS n, count(*) AS places FROM g GROUP BY gram""",
        "clean_text": rf"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split_regex(raw_text, '\r\n|\n|\r') AS ls FROM documents WHERE raw_text IS NOT NULL)),
            c AS (SELECT doc_id, i, {line} AS x FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS n FROM c WHERE length(x) >= 2 AND NOT ({noise})),
            t AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM k WHERE n = 1 GROUP BY doc_id)
            SELECT d.doc_id, length(coalesce(t, ''))::INT AS n_chars, md5(coalesce(t, '')) AS digest FROM documents d LEFT JOIN t USING (doc_id) WHERE raw_text IS NOT NULL""",
        "file_flags": f"""SELECT doc_id, {_suffix('source')} IN {_in(T.TEXT_SUFFIXES)} AS is_text, {_is_code('source')} AS is_code, {skipped('strlen(raw_text)')} AS skipped,
            coalesce(len(list_filter(list_slice(string_split(raw_text, chr(10)), 1, 10), lambda x: length(x) > 500)) > 0, false) AS minified FROM documents WHERE source IS NOT NULL""",
        "files_to_index": f"""WITH r AS (SELECT source, arg_max(size_bytes, {{'a': seen_at, 'b': mtime, 'c': size_bytes}}) AS size_bytes FROM file_listing WHERE source IS NOT NULL GROUP BY source)
            SELECT source, size_bytes, {_suffix('source')} AS suffix FROM r WHERE {dirs} AND {_suffix('source')} IN {_in(T.TEXT_SUFFIXES)} AND NOT {skipped('size_bytes')}""",
        "query_validity": f"SELECT doc_id, CASE WHEN len({_words('text')}) > 500 THEN 'too many words' WHEN len(string_split(text, chr(10))) > 80 THEN 'too many lines' ELSE 'ok' END AS verdict FROM documents WHERE text IS NOT NULL",
        "query_terms": f"SELECT chunk_id, chunk_index, array_to_string(list_slice({_tokens('text')}, 1, 20), ' ') AS terms FROM {_C} WHERE text IS NOT NULL",
        "sentence_split": f"SELECT chunk_id, chunk_index, len({_SENT})::INT AS n, md5(array_to_string({_SENT}, '|')) AS digest FROM {_C} WHERE text IS NOT NULL",
        "trimmed_snippets": f"SELECT c.chunk_id, c.chunk_index, {_trim_words('c.text', 35)} || ' ' || {_cite('source', 'c.chunk_index')} AS snippet FROM {_C} c JOIN documents d USING (doc_id) WHERE c.text IS NOT NULL",
        "chunk_prose": f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(cleaned_text, chr(10)) AS l FROM documents WHERE length(cleaned_text) > 0 AND NOT coalesce({_is_code('source')}, false)),
            w AS (SELECT doc_id, l, list_transform(l, lambda x: greatest(1, len({_words('x')}))) AS w FROM d),
            p AS (SELECT doc_id, l, len(l) AS n, list_transform(range(0, len(l) + 1), lambda k: coalesce(list_sum(list_slice(w, 1, k)), 0)::INT) AS p FROM w),
            r AS (SELECT doc_id, l, n, p, 0 AS chunk_index, 0 AS s, greatest(1, len(list_filter(p, lambda x: x <= 100)) - 1) AS e FROM p
              UNION ALL SELECT doc_id, l, n, p, chunk_index + 1, s2, greatest(s2 + 1, len(list_filter(p, lambda x: x <= p[s2 + 1] + 100)) - 1)
              FROM (SELECT *, greatest(s + 1, len(list_filter(p, lambda x: x <= p[e + 1] - 20)) - 1) AS s2 FROM r WHERE e < n)),
            o AS (SELECT doc_id, chunk_index, s, e, array_to_string(list_slice(l, s + 1, e), chr(10)) AS t FROM r)
            SELECT doc_id, chunk_index, s AS first_line, e AS end_line, {_estimate('t')} AS token_estimate, md5(t) AS digest FROM o""",
        "chunk_code": _chunk_code(),
        "upserted_index": rf"""WITH new AS (SELECT doc_id, source, raw_text FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, doc_id DESC) = 1),
            l AS (SELECT doc_id, source, unnest(string_split_regex(raw_text, '\r\n|\n|\r')) AS line FROM new WHERE raw_text IS NOT NULL), c AS (SELECT DISTINCT doc_id, source FROM (SELECT doc_id, source, {line} AS x FROM l) WHERE length(x) >= 2 AND NOT ({noise}))
            SELECT 'documents' AS name, (SELECT count(*) FROM c) + (SELECT count(*) FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM c)) AS rows
            UNION ALL SELECT 'indexed', count(*) FROM new WHERE doc_id IN (SELECT doc_id FROM c) OR (source NOT IN (SELECT source FROM c) AND doc_id IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL))
            UNION ALL SELECT 'orphans', count(*) FROM {_C} WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE source IS NOT NULL)""",
        "doc_freq": f"""WITH t AS (SELECT chunk_id, unnest({_index('text')}) AS token FROM {_C}), f AS (SELECT token, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM t GROUP BY token), n AS (SELECT count(*) AS n FROM {_C})
            SELECT token, df, cf, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END, 6) AS idf FROM f, n""",
        "bm25_topk": f"WITH {_bm25(X.QUERIES)}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS rank FROM scored QUALIFY rank <= 12) SELECT query_id, chunk_id, rank, round(bm25, 6) AS bm25 FROM t",
        "bm25_phrase": f"WITH {_bm25(X.PHRASE_QUERIES)} SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM scored",
        "weighted_rerank": f"""WITH {_bm25(X.QUERIES)}, {_TOP}, q(query_id, query) AS (VALUES {", ".join(f"({i}, {_q(t)})" for i, t in X.QUERIES)}),
            o AS (SELECT top.*, len(list_intersect(list_distinct({_tokens('query')}), {_tokens("coalesce(c.text, '')")}))::DOUBLE / len(list_distinct({_tokens('query')})) AS overlap FROM top JOIN q USING (query_id) JOIN ck c USING (chunk_id)),
            f AS (SELECT *, 0.35::DOUBLE / rank + 0.65::DOUBLE / (1 + abs(bm25)) AS fts FROM o)
            SELECT query_id, chunk_id, rank AS fts_rank, round(overlap, 6) AS overlap, round(fts, 6) AS fts_score, round(0.5::DOUBLE * fts + 0.15::DOUBLE * overlap, 6) AS final_score FROM f""",
        "vector_topk": f"WITH {_LATEST} SELECT chunk_id, rank, round(score, 6) AS score FROM vt",
        "rrf_fusion": f"""WITH {_bm25(X.QUERIES)}, {_TOP}, {_LATEST}, {_queries(X.QUERIES)}, vr AS (SELECT query_id, chunk_id, rank FROM vt, q)
            SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.chunk_id, v.chunk_id) AS chunk_id, coalesce(t.rank, 0) AS fts_rank, coalesce(v.rank, 0) AS vector_rank,
            round(coalesce(1.0::DOUBLE / (60 + t.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0), 8) AS rrf FROM top t FULL OUTER JOIN vr v ON t.query_id = v.query_id AND t.chunk_id = v.chunk_id""",
        "hybrid_rerank": f"""WITH {_bm25(X.QUERIES)}, {_TOP}, {_LATEST}, {_queries(X.QUERIES)}, vr AS (SELECT query_id, chunk_id, rank, score FROM vt, q), src AS (SELECT DISTINCT chunk_id, c.text FROM ck c JOIN documents USING (doc_id)),
            b AS (SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.chunk_id, v.chunk_id) AS chunk_id, t.rank AS fts_rank, v.rank AS vector_rank, score, bm25 FROM top t FULL OUTER JOIN vr v ON t.query_id = v.query_id AND t.chunk_id = v.chunk_id)
            SELECT query_id, chunk_id, coalesce(fts_rank, 0) AS fts_rank, coalesce(vector_rank, 0) AS vector_rank,
            round(0.5::DOUBLE * coalesce(0.35::DOUBLE / fts_rank + 0.65::DOUBLE / (1 + abs(bm25)), 0) + 0.35::DOUBLE * coalesce(score, 0) + 0.15::DOUBLE * {_overlap('query', 'text')}, 6) AS final_score FROM b JOIN src USING (chunk_id) JOIN q USING (query_id)""",
        "adaptive_paths": f"""WITH {_bm25(X.STRESS_QUERIES)}, {_TOP}, {_LATEST}, {_queries(X.STRESS_QUERIES)}, h AS (SELECT q.query_id, count(t.chunk_id) AS fts_hits FROM q LEFT JOIN top t USING (query_id) GROUP BY q.query_id),
            m AS (SELECT *, unnest(['fallback', 'always']) AS mode, (SELECT count(*) FROM (SELECT DISTINCT chunk_id FROM chunks)) AS n FROM h),
            p AS (SELECT query_id, fts_hits, mode, CASE WHEN mode = 'always' THEN 'scan' WHEN n < 200 THEN 'disabled_small_codebase' WHEN fts_hits < 3 THEN 'scan' ELSE 'disabled' END AS path FROM m)
            SELECT query_id, fts_hits, CASE WHEN path = 'scan' THEN (SELECT count(*) FROM vt) ELSE 0 END AS vector_hits, path, mode,
            fts_hits + CASE WHEN path = 'scan' THEN (SELECT count(*) FROM vt WHERE chunk_id NOT IN (SELECT chunk_id FROM top WHERE top.query_id = p.query_id)) ELSE 0 END AS pool FROM p""",
        "context_packet": f"{_packet(False)} SELECT query_id, array_to_string(bullets, chr(10)) AS bullets, compressed_tokens, selected_tokens, pool_tokens, saved_tokens, pool_saved_pct FROM packet",
        "hybrid_packet": f"{_packet(True)} SELECT query_id, query, fts_hits, vector_hits, 'scan' AS path, pool, pool_tokens, selected_chunks, sources, selected_tokens, array_to_string(bullets, chr(10)) AS bullets, compressed_tokens, saved_tokens, pool_saved_pct FROM packet",
        "packet_text": f"""{_packet(False)}, tx AS (SELECT query_id, bullets, array_to_string(list_concat(['CONTEXT_PACKET_START', 'query: ' || query, 'selected_chunks: ' || selected_chunks, 'sources: ' || sources, 'retrieval_mode: compact', 'hybrid_mode: fallback', 'fts_ranking: bm25',
            'vector_backend_used: disabled', 'vector_retrieval_path: disabled', 'fts_hits: ' || fts_hits, 'vector_hits: ' || vector_hits, 'estimated_token_savings: ' || saved_tokens, 'candidate_pool_token_reduction_pct: ' || pool_saved_pct::DOUBLE, '', 'compressed_context:'],
            list_concat(list_transform(bullets, lambda b: '- ' || b), ['', 'CONTEXT_PACKET_END'])), chr(10)) AS packet FROM packet)
            SELECT query_id, md5(packet) AS digest, 'CONTEXT_PACKET_START' AS first, len(regexp_extract_all(packet, '(?m)^- ', 0))::INT AS said FROM tx""",
        "ivf_topk": f"""WITH {_LATEST}, n AS (SELECT c.chunk_id, any_value(c.v) AS v FROM (SELECT c.chunk_id, c.dimensions, {_VEC.replace('embedding_json', 'c.embedding_json')} AS v FROM chunk_embeddings c, lq
            WHERE {_BACKEND.replace('backend', 'c.backend')} = {_BACKEND.replace('backend', 'lq.backend')} AND c.dimensions = lq.dimensions AND c.model_name IS NOT DISTINCT FROM lq.model_name AND c.embedding_json IS NOT NULL) c WHERE {_USABLE} GROUP BY c.chunk_id),
            s AS (SELECT chunk_id, list_sum(list_transform(range(1, len(n.v) + 1), lambda i: n.v[i] * lq.v[i])) / sqrt(list_sum(list_transform(n.v, lambda x: x * x))) / sqrt(list_sum(list_transform(lq.v, lambda x: x * x))) AS score FROM n, lq)
            SELECT chunk_id, round(greatest(0, score), 6) AS score FROM s ORDER BY greatest(0, score) DESC, chunk_id LIMIT 20""",
        "sentence_pick": f"""WITH RECURSIVE {_queries(X.QUERIES)}, pr AS (SELECT chunk_id, any_value(text) AS text FROM {_C} WHERE doc_id IN (SELECT doc_id FROM documents WHERE NOT ({_is_code('source')})) GROUP BY chunk_id),
            pt AS (SELECT query_id || ':' || chunk_id AS key, text, query FROM pr, q), {_ranked_sentences('pt')} SELECT key, md5(summary) AS digest FROM picked""",
        "code_signatures": f"WITH x AS (SELECT doc_id, {_signatures('text')} AS x FROM documents WHERE {_is_code('source')} AND text IS NOT NULL) SELECT doc_id, len(x)::INT AS n, md5(array_to_string(x, '|')) AS digest FROM x",
        "query_costs": f"""WITH s AS (SELECT lang, sum({_estimate('raw_text')})::BIGINT AS raw, sum({_estimate('cleaned_text')})::BIGINT AS clean FROM documents GROUP BY lang), c AS (SELECT lang, raw * {evaluation.PER_MILLION}::DOUBLE / 1000000 AS a, clean * {evaluation.PER_MILLION}::DOUBLE / 1000000 AS b FROM s)
            SELECT lang, round(a, 6) AS raw_cost, round(b, 6) AS compressed_cost, round(a - b, 6) AS saved_cost, round(round(a - b, 6) * 100, 4) AS saved_cost_100 FROM c""",
        "model_slugs": f"""WITH c AS (SELECT DISTINCT dimensions, trim(coalesce(backend, ''), ' ') AS b, trim(coalesce(model_name, 'none'), ' ') AS m FROM chunk_embeddings), r AS (SELECT dimensions, left(regexp_replace(b, '[^a-zA-Z0-9._-]+', '_', 'g'), 120) AS b, left(regexp_replace(m, '[^a-zA-Z0-9._-]+', '_', 'g'), 120) AS m FROM c)
            SELECT DISTINCT dimensions, CASE WHEN b = '' THEN 'default' ELSE b END AS backend, CASE WHEN m = '' THEN 'default' ELSE m END AS model FROM r""",
        "patch_files": """WITH r AS (SELECT doc_id::VARCHAR AS file, text, string_split(text, chr(10))[1] AS f FROM documents WHERE text IS NOT NULL), p AS (SELECT * FROM r WHERE NOT contains(f, chr(13)) AND NOT regexp_matches(f, '^(<{5,}|={5,}|>{5,}|@@)')),
            n AS (SELECT *, CASE WHEN f = '' THEN 0 ELSE (length(text) - length(replace(text, f, ''))) // length(f) END AS n FROM p)
            SELECT file, CASE WHEN n = 1 THEN 1 ELSE 0 END AS applied, CASE WHEN n = 1 THEN 0 ELSE 1 END AS failed, md5(CASE WHEN n = 1 THEN replace(text, f, 'patched') ELSE text END) AS digest FROM n""",
        "sentence_jaccard": f"""WITH pr AS (SELECT chunk_id, any_value(text) AS text FROM {_C} WHERE doc_id IN (SELECT doc_id FROM documents WHERE NOT ({_is_code('source')})) GROUP BY chunk_id),
            s AS (SELECT chunk_id, list_transform({_SENT}, lambda s: list_distinct({_tokens('s')})) AS ss FROM pr), e AS (SELECT chunk_id, unnest(ss) AS x, generate_subscripts(ss, 1) - 1 AS i FROM s)
            SELECT a.chunk_id, a.i AS i, b.i AS j, round(len(list_intersect(a.x, b.x))::DOUBLE / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))), 6) AS jaccard FROM e a JOIN e b ON a.chunk_id = b.chunk_id AND a.i < b.i WHERE len(list_intersect(a.x, b.x)) > 0""",
        "merge_runs": f"""WITH c AS (SELECT c.*, source FROM {_C} c JOIN documents USING (doc_id) WHERE c.text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.doc_id, chunk_index ORDER BY chunk_id) = 1),
            r AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS run FROM c)
            SELECT doc_id, min(chunk_index) AS first_index, count(*) AS merged, arg_min(chunk_id, chunk_index) AS chunk_id, coalesce(sum(token_estimate), 0)::BIGINT AS token_estimate, max(chunk_index)::DOUBLE AS final_score, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS digest FROM r GROUP BY doc_id, run""",
        "budget_pack": f"""WITH RECURSIVE b AS (SELECT doc_id, text AS bullet, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, text) AS r FROM (SELECT DISTINCT ON (chunk_id) * FROM {_C} WHERE text IS NOT NULL)),
            f AS (SELECT doc_id, 0::BIGINT AS r, []::VARCHAR[] AS kept, 0::BIGINT AS used FROM b WHERE r = 1
              UNION ALL SELECT f.doc_id, b.r, CASE WHEN used >= 150 THEN kept WHEN len(kept) = 0 AND len({_words('bullet')}) > 150 THEN list_append(kept, {_trim_words('bullet', 150)}) WHEN len(kept) = 0 OR used + len({_words('bullet')}) <= 150 THEN list_append(kept, bullet) ELSE kept END,
              CASE WHEN used >= 150 THEN used WHEN len(kept) = 0 AND len({_words('bullet')}) > 150 THEN 150 WHEN len(kept) = 0 OR used + len({_words('bullet')}) <= 150 THEN used + len({_words('bullet')}) ELSE used END FROM f JOIN b ON b.doc_id = f.doc_id AND b.r = f.r + 1)
            SELECT doc_id, len(kept)::INT AS kept, used::INT AS words, md5(array_to_string(kept, '|')) AS digest FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) = 1""",
        "token_savings": f"""WITH s AS (SELECT lang, sum({_estimate('raw_text')})::BIGINT AS raw, sum({_estimate('cleaned_text')})::BIGINT AS clean FROM documents GROUP BY lang)
            SELECT lang, raw, clean, greatest(0, raw - clean) AS saved, round(100.0::DOUBLE * greatest(0, raw - clean) / raw, 2) AS pct FROM s""",
        "upsert_documents": "SELECT source, doc_id, coalesce(length(cleaned_text), -1)::INT AS n_clean FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, doc_id DESC) = 1",
        "sync_diff": f"WITH {_SYNC} SELECT source, status FROM sync",
        "sync_counts": f"WITH {_SYNC} SELECT status, count(*) AS n FROM sync GROUP BY status",
        "gc_counts": f"""SELECT 'chunks' AS kind, count(*) AS orphans FROM {_C} c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.doc_id)
            UNION ALL SELECT 'chunk_embeddings', count(*) FROM (SELECT DISTINCT * FROM chunk_embeddings) e WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = e.chunk_id)
            UNION ALL SELECT 'file_dependencies', count(*) FROM (SELECT DISTINCT * FROM file_dependencies) f WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = f.source_file)
            UNION ALL SELECT 'resolved_files', count(*) FROM (SELECT DISTINCT * FROM file_dependencies) f WHERE resolved_file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = f.resolved_file)""",
        "gc_result": f"SELECT {_BACKEND} AS backend, count(*) AS kept FROM (SELECT DISTINCT * FROM chunk_embeddings) WHERE chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY 1",
        "remove_deleted": f"""WITH {_SYNC}, gone AS (SELECT source FROM sync WHERE status = 'deleted'), dead AS (SELECT doc_id FROM documents WHERE source IN (SELECT source FROM gone)),
            lc AS (SELECT DISTINCT * FROM chunks WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM dead))
            SELECT 'documents' AS name, count(*) AS rows FROM (SELECT DISTINCT * FROM documents) WHERE source IS NULL OR source NOT IN (SELECT source FROM gone)
            UNION ALL SELECT 'chunks', count(*) FROM lc UNION ALL SELECT 'chunk_embeddings', count(*) FROM (SELECT DISTINCT * FROM chunk_embeddings) WHERE chunk_id IN (SELECT chunk_id FROM lc)
            UNION ALL SELECT 'file_dependencies', count(*) FROM (SELECT DISTINCT * FROM file_dependencies) WHERE source_file IS NULL OR source_file NOT IN (SELECT source FROM gone)""",
        "index_stats": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM (SELECT DISTINCT * FROM {t})" for t in tables),
        "time_range": "SELECT epoch_us(min(created_at)) AS first, epoch_us(max(updated_at)) AS last, count(*) AS n FROM documents",
        "backend_counts": f"SELECT {_BACKEND} AS backend, dimensions, count(*) AS n FROM (SELECT DISTINCT * FROM chunk_embeddings) GROUP BY 1, 2",
        "query_cache": """WITH c AS (SELECT DISTINCT query_key AS cache_key, coalesce(query_text_hash, '') AS payload, floor(epoch(created_at))::BIGINT AS created FROM query_embeddings WHERE query_key IS NOT NULL AND created_at IS NOT NULL),
            e AS (SELECT *, created + 31536000 AS expires FROM c) SELECT cache_key, payload, created, expires FROM e WHERE expires > (SELECT max(created) - 86400 FROM c) QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created DESC, payload) = 1""",
        "query_embedding_cache": f"""SELECT query_key, {_BACKEND} AS backend, dimensions, length(embedding_json)::INT AS n_json FROM (SELECT DISTINCT * FROM query_embeddings WHERE query_key IS NOT NULL)
            QUALIFY row_number() OVER (PARTITION BY query_key ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, embedding_json DESC NULLS LAST) = 1""",
        "session_recent": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC) AS recent FROM r WHERE n <= 8 GROUP BY user_id",
        "session_sources": """WITH l AS (SELECT user_id, concat_ws(':', event_type, props) AS item, max(ts) AS ts FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item DESC) AS n FROM l)
            SELECT user_id, string_agg(item, ',' ORDER BY n DESC) AS recent FROM r WHERE n <= 12 GROUP BY user_id""",
        "turn_reminders": f"""WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS turn FROM events),
            r AS (SELECT *, CASE WHEN turn >= {g.CRITICAL_TURN} AND turn % 10 = 0 THEN 'critical' WHEN turn >= {g.RESET_TURN} AND turn % 5 = 0 THEN 'reset' WHEN turn = {g.COMPACT_TURN} THEN 'compact' WHEN turn IN {_in(g.REMINDER_TURNS)} THEN 'remind' END AS reminder FROM t)
            SELECT * FROM r WHERE reminder IS NOT NULL""",
        "prompt_guard": f"""SELECT doc_id, CASE WHEN text IS NULL OR contains(text, 'corekit.telemetry') THEN 'pass' WHEN len({_words('text')}) > 3000 THEN 'reject' WHEN len({_words('text')}) > 800 THEN 'compress'
            WHEN len({_words('text')}) > 900 OR len(string_split(text, chr(10))) > 120 THEN 'warn' ELSE 'pass' END AS verdict FROM documents""",
        "prompt_fields": "SELECT event_id, coalesce(json_extract_string(props, '$.prompt'), json_extract_string(props, '$.text'), json_extract_string(props, '$.k')) AS field FROM events",
        "retrieval_quality": f"""WITH {_bm25(X.JUDGED_QUERIES)}, {_TOP}, j(query_id, relevant, irrelevant) AS (VALUES {judged}),
            r AS (SELECT query_id, rank, relevant, irrelevant, {low} AS body FROM top JOIN (SELECT chunk_id, any_value(text) AS text FROM ck GROUP BY chunk_id) USING (chunk_id) JOIN j USING (query_id)),
            h AS (SELECT *, {keywords} AS k, len(list_filter(irrelevant, lambda k: contains(body, lower(k)))) AS bad FROM r),
            a AS (SELECT query_id, sum(CASE WHEN rank <= 5 AND len(k) > 0 AND bad = 0 THEN 1 ELSE 0 END) / least(5, count(*)) AS p, len(list_distinct(flatten(list(CASE WHEN rank <= 5 THEN k ELSE [] END)))) / max(len(relevant)) AS rc,
              coalesce(1.0::DOUBLE / min(CASE WHEN len(k) > 0 THEN rank END), 0) AS m, sum(CASE WHEN rank <= 5 THEN (len(k)::DOUBLE / len(relevant)) / log2(rank + 1) ELSE 0 END) AS dcg, max(len(relevant)) AS n FROM h GROUP BY query_id)
            SELECT query_id, round(p, 6) AS precision, round(rc, 6) AS recall, round(m, 6) AS mrr, round(dcg / list_sum(list_transform(range(1, least(5, n) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg,
              CASE WHEN p >= 0.8 AND rc >= 0.7 THEN 'Excellent' WHEN p >= 0.6 AND rc >= 0.5 THEN 'Good' WHEN p >= 0.4 OR rc >= 0.4 THEN 'Fair' ELSE 'Needs Improvement' END AS quality FROM a""",
        "latency_percentiles": """WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS mean, min(value) AS least, max(value) AS most, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
            SELECT event_type, n, round(mean, 4) AS mean, least, most, v[least(n - 1, n * 50 // 100) + 1] AS p50, v[least(n - 1, n * 95 // 100) + 1] AS p95, v[least(n - 1, n * 99 // 100) + 1] AS p99 FROM s""",
        "code_imports": f"WITH {_imports()} SELECT * FROM edges",
        "import_resolution": rf"""WITH {_imports()}, c AS (SELECT source_file, target_import, regexp_replace(source_file, '[^/]*$', '') AS dir FROM edges),
            e AS (SELECT source_file, target_import, unnest([dir || target_import || '.py', dir || target_import || '.ts', dir || target_import || '.js', dir || target_import || '/__init__.py', dir || target_import || '/index.ts', dir || target_import || '/index.js', dir || replace(target_import, '.', '/') || '.py', dir || replace(target_import, '.', '/') || '.ts']) AS p, unnest(range(8)) AS pos FROM c),
            n AS (SELECT source_file, target_import, pos, {_tidy("p")} AS p FROM e),
            h AS (SELECT source_file, target_import, arg_min(p, pos) AS resolved_file FROM n WHERE p IN (SELECT source FROM documents) GROUP BY 1, 2)
            SELECT source_file, target_import, resolved_file FROM edges LEFT JOIN h USING (source_file, target_import)""",
        "known_dependencies": f"WITH {_imports()} SELECT {_suffix('source_file')} AS suffix, count(*) AS n FROM edges e WHERE NOT EXISTS (SELECT 1 FROM file_dependencies f WHERE f.source_file = e.source_file AND f.target_import = e.target_import) GROUP BY 1",
        "imported_files": "SELECT DISTINCT source_file, resolved_file FROM file_dependencies WHERE resolved_file IS NOT NULL",
        "import_fan_in": "SELECT target_import, count(DISTINCT source_file) AS files, count(resolved_file) AS resolved FROM file_dependencies GROUP BY target_import",
        "code_calls": f"SELECT doc_id, unnest({calls}) AS name FROM documents WHERE {_is_code('source')} AND text IS NOT NULL",
        "code_symbols": f"WITH {_symbols()} SELECT * FROM sym",
        "symbol_lookup": f"WITH {_symbols()} SELECT symbol_name, row_number() OVER (PARTITION BY symbol_name ORDER BY chunk_id, file_path, symbol_type, signature)::INT AS n, file_path, chunk_id FROM sym QUALIFY n <= 3",
        "two_hop": f"""WITH {_bm25(X.QUERIES)}, {_TOP}, {_symbols()}, ct AS (SELECT chunk_id, any_value(text) AS text FROM ck GROUP BY chunk_id),
            cl AS (SELECT query_id, name, min(rank) AS rank FROM (SELECT query_id, rank, unnest({calls}) AS name FROM top JOIN ct USING (chunk_id) WHERE rank <= 3) GROUP BY 1, 2),
            d AS (SELECT symbol_name AS name, file_path, chunk_id FROM sym QUALIFY row_number() OVER (PARTITION BY symbol_name ORDER BY file_path, chunk_id) = 1),
            f AS (SELECT query_id, name, file_path, chunk_id FROM cl JOIN d USING (name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, name) <= 5)
            SELECT query_id, name, file_path, f.chunk_id, md5(substring(text, 1, 500)) AS digest FROM f JOIN ct USING (chunk_id)""",
        "imported_context": f"""WITH {_bm25(X.QUERIES)}, cs AS (SELECT DISTINCT chunk_id, source FROM chunks c JOIN documents USING (doc_id)), sc AS (SELECT scored.*, source FROM scored JOIN cs USING (chunk_id)),
            ch AS (SELECT DISTINCT query_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS r FROM sc) WHERE r <= 12),
            tg AS (SELECT DISTINCT query_id, resolved_file AS source FROM ch JOIN (SELECT DISTINCT source_file, resolved_file FROM file_dependencies WHERE resolved_file IS NOT NULL) f ON f.source_file = ch.source),
            t2 AS (SELECT * FROM tg WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.query_id = tg.query_id AND ch.source = tg.source))
            SELECT query_id, source, chunk_id, row_number() OVER (PARTITION BY query_id, source ORDER BY bm25, chunk_id)::INT AS n, round(bm25, 6) AS bm25 FROM sc JOIN t2 USING (query_id, source) QUALIFY n <= 2""",
    }
