"""Registered queries for text, search and graph operators (TXT, SRCH, GRF)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import search as S
from quarry.operators import text as TX
from quarry.plans.registry import query, rounded, table

_ALLOW = "(?i)(?:" + "|".join(TX.DEFAULT_ALLOWLIST) + ")"


def _duck_redact_chain(src: str, id_col: str, text_expr: str, allow: bool, extra_cols: str = "") -> tuple[str, str]:
    """CTE chain applying the patterns in order in DuckDB; returns (ctes, last cte name)."""
    ctes = [f"r0 AS (SELECT {id_col}{extra_cols}, {text_expr} AS t FROM {src})"]
    for i, (_n, p, rep) in enumerate(TX.DEFAULT_PATTERNS):
        if allow:
            ms = f"regexp_extract_all(t, '{p}')"
            pcs = f"string_split_regex(t, '{p}')"
            expr = (f"CASE WHEN t IS NULL THEN NULL ELSE {pcs}[1] || array_to_string(list_transform("
                    f"range(1, len({ms}) + 1), lambda i: CASE WHEN regexp_matches({ms}[i], '{_ALLOW}') "
                    f"THEN {ms}[i] ELSE '{rep}' END || {pcs}[i + 1]), '') END")
        else:
            expr = f"regexp_replace(t, '{p}', '{rep}', 'g')"
        ctes.append(f"r{i + 1} AS (SELECT * EXCLUDE (t), {expr} AS t FROM r{i})")
    return ",\n".join(ctes), f"r{len(TX.DEFAULT_PATTERNS)}"


_C1, _L1 = _duck_redact_chain("documents", "doc_id", "text", allow=False)


@query("redact_simple", f"WITH {_C1} SELECT doc_id, t AS redacted FROM {_L1}")
def q_redact_simple(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.redact(F.col("text"), allowlist=()).alias("redacted"))


_C2, _L2 = _duck_redact_chain("documents", "doc_id", "text", allow=True)


@query("redact_allowlist", f"WITH {_C2} SELECT doc_id, t AS redacted FROM {_L2}")
def q_redact_allowlist(spark, sf):
    d = table(spark, sf, "documents")
    return TX.redact_df(d.select("doc_id", "text"), "text", "redacted").drop("text")


def _counts_sql() -> str:
    ctes = ["s0 AS (SELECT doc_id, text AS t FROM documents)"]
    sel = []
    for i, (name, p, rep) in enumerate(TX.DEFAULT_PATTERNS):
        ctes.append(f"s{i + 1} AS (SELECT doc_id, regexp_replace(t, '{p}', '{rep}', 'g') AS t FROM s{i})")
        sel.append(f"SELECT doc_id, '{name}' AS type, CAST(len(regexp_extract_all(t, '{p}')) AS BIGINT) AS count FROM s{i}")
    return "WITH " + ",\n".join(ctes) + " SELECT * FROM (" + " UNION ALL ".join(sel) + ") WHERE count > 0"


@query("redaction_counts", _counts_sql())
def q_redaction_counts(spark, sf):
    return TX.redaction_counts(table(spark, sf, "documents"), "doc_id", "text", allowlist=())


def _chunk_sql(pattern: str, strategy: str, whole: str) -> str:
    strip = r"regexp_replace(piece, '^\s+|\s+$', '', 'g')"
    return f"""
WITH s AS (SELECT doc_id, text, string_split_regex(text, '{pattern}') AS pieces,
                  regexp_extract_all(text, '{pattern}') AS delims FROM documents),
e AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS idx, delims FROM s),
f AS (SELECT doc_id, idx, piece,
             CAST(coalesce(sum(length(piece) + coalesce(length(delims[idx + 1]), 0))
                  OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
             AS start_char FROM e),
c AS (SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, {strip} AS content, start_char,
             start_char + length(piece) AS end_char, CAST(length(piece) // 4 AS BIGINT) AS token_count,
             '{strategy}' AS strategy FROM f WHERE length({strip}) > 0)
SELECT * FROM c
UNION ALL
SELECT doc_id, 0, coalesce(text, ''), 0, coalesce(length(text), 0), CAST(coalesce(length(text), 0) // 4 AS BIGINT),
       '{whole}' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)
"""


@query("chunk_paragraphs", _chunk_sql(r"\n\n+", "paragraphs", "single"))
def q_chunk_paragraphs(spark, sf):
    return TX.chunk_text(table(spark, sf, "documents"), "doc_id", "text", strategy="paragraphs")


@query("chunk_lines", _chunk_sql(r"\n", "custom", "single"))
def q_chunk_lines(spark, sf):
    return TX.chunk_text(table(spark, sf, "documents"), "doc_id", "text", pattern="\n")


def _marked(prefixes: list[str]) -> str:
    """SQL for texts whose n-th line begins with one of ``prefixes``, in turn."""
    cases = " ".join(f"WHEN i % {len(prefixes) + 1} = {k + 1} THEN '{p}'" for k, p in enumerate(prefixes))
    return f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
               lambda x, i: CASE {cases} ELSE '' END || x), chr(10)) AS text FROM documents"""


def _marked_docs(spark, sf, prefixes):
    lines = F.split("text", "\n", -1)

    def mark(x, i):
        head = F.lit("")
        for k, p in enumerate(prefixes):
            head = F.when((i + 1) % (len(prefixes) + 1) == k + 1, F.lit(p)).otherwise(head)
        return F.concat(head, x)

    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(lines, mark), "\n").alias("text"))


def _chunk_before_sql(prefixes: list[str], strategy: str) -> str:
    """Chunks that begin at the lines with a prefix, by line numbers."""
    starts = " OR ".join(f"starts_with(line, '{p}')" for p in prefixes)
    strip = r"regexp_replace(piece, '^\s+|\s+$', '', 'g')"
    return f"""
WITH d AS ({_marked(prefixes)}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
g AS (SELECT *, sum(CASE WHEN n > 1 AND ({starts}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS idx FROM l),
c AS (SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, string_agg(line, chr(10) ORDER BY n) AS piece FROM g GROUP BY doc_id, idx),
f AS (SELECT *, CAST(coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM c)
SELECT doc_id, chunk_index, {strip} AS content, start_char, start_char + length(piece) AS end_char, CAST(length(piece) // 4 AS BIGINT) AS token_count,
       '{strategy}' AS strategy FROM f WHERE length({strip}) > 0"""


_MD, _PY = ["## "], ["def ", "class ", "async def "]


@query("chunk_markdown", _chunk_before_sql(_MD, "markdown_headers"))
def q_chunk_markdown(spark, sf):
    return TX.chunk_text(_marked_docs(spark, sf, _MD), "doc_id", "text", strategy="markdown_headers")


@query("chunk_python", _chunk_before_sql(_PY, "python_functions"))
def q_chunk_python(spark, sf):
    return TX.chunk_text(_marked_docs(spark, sf, _PY), "doc_id", "text", strategy="python_functions")


@query("chunk_json", """
WITH d AS (SELECT doc_id, ' {"n": ' || n_chars || '}' || chr(10) AS t FROM documents)
SELECT doc_id, 0 AS chunk_index, t AS content, CAST(0 AS BIGINT) AS start_char, length(t) AS end_char,
       CAST(length(t) // 4 AS BIGINT) AS token_count, 'json_whole' AS strategy FROM d
""")
def q_chunk_json(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit(".json").alias("ext"),
                                             F.concat(F.lit(' {"n": '), F.col("n_chars").cast("string"), F.lit("}\n")).alias("text"))
    return TX.chunk_text(d, "doc_id", "text", ext_col="ext")


_IDENTITY_PATHS = """
WITH d AS (SELECT doc_id, text, n_chars, CASE doc_id % 5
       WHEN 0 THEN 'r/.plans/PLAN-' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '_x.md'
       WHEN 1 THEN 'r/.Sessions/session_' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '.md'
       WHEN 2 THEN 'r/.adrs/some-thing_' || doc_id || '.json'
       WHEN 3 THEN 'r/docs/specs/SPEC-00' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '.md'
       ELSE 'r/notes/my-note_' || doc_id || '.md' END AS path FROM documents),
t AS (SELECT *, CASE WHEN doc_id % 5 = 2 AND doc_id % 2 = 0 THEN '{"id": "ADR-' || doc_id || '", "title": "T ' || doc_id || '"}'
                     WHEN doc_id % 5 = 2 THEN '{"name": "N"}' ELSE text END AS t FROM d)
"""


@query("document_identity", _IDENTITY_PATHS + r"""
SELECT doc_id, substr(sha256(t), 1, 16) AS content_hash, length(t) AS n_chars,
       CASE doc_id % 5 WHEN 0 THEN 'PLAN-' || lpad((doc_id % 1000)::VARCHAR, 3, '0')
            WHEN 1 THEN 'SESSION-' || lpad((doc_id % 1000)::VARCHAR, 3, '0')
            WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'ADR-' || doc_id ELSE 'adr_' || substr(sha256(path), 1, 16) END
            WHEN 3 THEN 'SPEC-00' || lpad((doc_id % 100)::VARCHAR, 2, '0')
            ELSE 'session_' || substr(sha256(path), 1, 16) END AS artifact_id,
       CASE WHEN doc_id % 5 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'T ' || doc_id ELSE 'N' END
            ELSE coalesce(nullif(trim(regexp_extract(t, '(?m)^#\s+(.+)$', 1)), ''),
                 CASE doc_id % 5 WHEN 0 THEN 'Plan ' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ' X'
                      WHEN 1 THEN 'Session ' || lpad((doc_id % 1000)::VARCHAR, 3, '0')
                      WHEN 3 THEN 'Spec 00' || lpad((doc_id % 100)::VARCHAR, 2, '0')
                      ELSE 'My Note ' || doc_id END) END AS title,
       CASE doc_id % 5 WHEN 0 THEN 'plan' WHEN 1 THEN 'session' WHEN 2 THEN 'adr' WHEN 3 THEN 'spec' ELSE 'session' END AS type
FROM t
""")
def q_document_identity(spark, sf):
    i, text = F.col("doc_id"), F.col("text")
    three = F.lpad((i % 1000).cast("string"), 3, "0")
    path = (F.when(i % 5 == 0, F.concat(F.lit("r/.plans/PLAN-"), three, F.lit("_x.md")))
            .when(i % 5 == 1, F.concat(F.lit("r/.Sessions/session_"), three, F.lit(".md")))
            .when(i % 5 == 2, F.concat(F.lit("r/.adrs/some-thing_"), i.cast("string"), F.lit(".json")))
            .when(i % 5 == 3, F.concat(F.lit("r/docs/specs/SPEC-00"), F.lpad((i % 100).cast("string"), 2, "0"), F.lit(".md")))
            .otherwise(F.concat(F.lit("r/notes/my-note_"), i.cast("string"), F.lit(".md"))))
    body = (F.when((i % 5 == 2) & (i % 2 == 0), F.format_string('{"id": "ADR-%s", "title": "T %s"}', i.cast("string"), i.cast("string")))
            .when(i % 5 == 2, F.lit('{"name": "N"}')).otherwise(text))
    return TX.document_meta(table(spark, sf, "documents").select("doc_id", path.alias("path"), body.alias("text")), "doc_id", "text", "path")


@query("document_meta", r"""
SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, length(text) AS n_chars,
       nullif(trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1)), '') AS title
FROM documents
""")
def q_document_meta(spark, sf):
    return TX.document_meta(table(spark, sf, "documents"), "doc_id", "text")


_OLD_TS = dt.datetime(2024, 1, 1)


def _old_snapshot(d):
    return d.filter(F.col("lang") != "de").select(
        "doc_id",
        F.sha2(F.when(F.col("lang") == "fr", F.concat(F.col("text"), F.lit("~"))).otherwise(F.col("text")), 256)
        .alias("content_hash"),
        F.when(F.col("source") == "src3", F.lit(_OLD_TS)).alias("archived_at"))


@query("upsert_actions", """
WITH o AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN text || '~' ELSE text END) AS h,
                  CASE WHEN source = 'src3' THEN TIMESTAMP '2024-01-01' END AS a FROM documents WHERE lang <> 'de'),
     n AS (SELECT doc_id, sha256(text) AS h FROM documents)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id,
       CASE WHEN o.h IS NULL THEN 'inserted' WHEN n.h IS NULL THEN 'kept' WHEN n.h <> o.h THEN 'updated'
            WHEN o.a IS NOT NULL THEN 'revived' ELSE 'unchanged' END AS action
FROM n FULL JOIN o ON n.doc_id = o.doc_id
""")
def q_upsert_actions(spark, sf):
    d = table(spark, sf, "documents")
    new = d.select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"))
    return TX.hash_upsert(_old_snapshot(d), new, "doc_id").select("doc_id", "action")


@query("soft_delete", """
SELECT doc_id, CASE WHEN source IN ('src5', 'src7') AND archived_at IS NULL THEN TIMESTAMP '2025-01-01'
                    ELSE archived_at END AS archived_at
FROM (SELECT doc_id, source, CASE WHEN source = 'src7' THEN TIMESTAMP '2024-06-01' END AS archived_at FROM documents)
""")
def q_soft_delete(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "source",
        F.when(F.col("source") == "src7", F.lit(dt.datetime(2024, 6, 1))).cast("timestamp_ntz").alias("archived_at"))
    ids = d.filter(F.col("source").isin("src5", "src7")).select("doc_id")
    out = TX.soft_delete(d, ids, "doc_id", dt.datetime(2025, 1, 1))
    return out.select("doc_id", F.col("archived_at").cast("timestamp_ntz").alias("archived_at"))


@query("rechunk_changed", "SELECT doc_id, chunk_index, content, token_count FROM (" + _chunk_sql(r"\n", "custom", "single") + ")")
def q_rechunk_changed(spark, sf):
    d = table(spark, sf, "documents")
    old_docs = d.withColumn("text", F.when(F.col("lang") == "fr", F.concat(F.col("text"), F.lit("\nstale line")))
                            .otherwise(F.col("text")))
    old_chunks = TX.chunk_text(old_docs, "doc_id", "text", pattern="\n")
    changed = d.filter(F.col("lang") == "fr")
    return TX.rechunk_changed(old_chunks, changed, "doc_id", "text", pattern="\n").select(
        "doc_id", "chunk_index", "content", "token_count")


@query("extract_refs", """
SELECT DISTINCT doc_id AS source, target, 'references' AS relation FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS target FROM documents)
WHERE target <> CAST(doc_id AS VARCHAR)
""")
def q_extract_refs(spark, sf):
    return TX.extract_refs(table(spark, sf, "documents"), "doc_id", "text", patterns=[r"[A-Z][a-z]{7,}"])


_STOP_SQL = ", ".join(f"'{w}'" for w in TX.STOP_WORDS)


@query("keywords", rf"""
SELECT DISTINCT doc_id, kw AS keyword FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+')) AS kw FROM documents)
WHERE regexp_full_match(kw, '[a-z][a-z0-9_-]{{2,}}') AND length(kw) > 3 AND kw NOT IN ({_STOP_SQL})
""")
def q_keywords(spark, sf):
    return TX.keywords(table(spark, sf, "documents"), "doc_id", "text")


_QUERIES = [("q1", "then"), ("q2", "ment"), ("q3", "xylophone"), ("q4", "@mail")]


def _kw_sql(top_k: int) -> str:
    parts = [f"""SELECT '{q}' AS query_id, doc_id, NULL::VARCHAR AS title, substr(text, 1, 200) AS snippet, 1.0 AS score,
       row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains(lower(text), '{t}')
       QUALIFY rank <= {top_k}""" for q, t in _QUERIES]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query("search_keyword", _kw_sql(10))
def q_search_keyword(spark, sf):
    return S.keyword_search(table(spark, sf, "documents"), _QUERIES, "doc_id", "text", top_k=10)


def _query_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    qs = e.join(first, ["label", "vec_id"]).select(F.concat(F.lit("label_"), F.col("label")).alias("query_id"),
                                                     "embedding")
    return S.collect_query_vectors(qs, "query_id", "embedding")


_VEC_SQL = """
WITH q AS (SELECT 'label_' || label AS query_id, CAST(embedding AS DOUBLE[]) AS qv
           FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT q.query_id, e.vec_id AS doc_id,
             CASE WHEN list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) = 0
                    OR list_dot_product(q.qv, q.qv) = 0 THEN 0.0
                  ELSE list_dot_product(CAST(e.embedding AS DOUBLE[]), q.qv)
                       / (sqrt(list_dot_product(q.qv, q.qv))
                          * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) END AS score
      FROM embeddings e, q)
SELECT query_id, doc_id, round(score, 5) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM s QUALIFY rank <= {k}
"""


@query("search_vector", _VEC_SQL.format(k=10))
def q_search_vector(spark, sf):
    hits = S.vector_search(table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vectors(spark, sf), 10)
    return hits.withColumn("score", F.round("score", 5))


@query("search_hybrid", f"""
WITH kw AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents
            WHERE contains(lower(text), 'then') QUALIFY rank <= 10),
     vs AS (SELECT doc_id, rank FROM ({_VEC_SQL.format(k=10)}) WHERE query_id = 'label_0'),
     u AS (SELECT doc_id, 0.5 / (60 + rank) AS rrf FROM kw UNION ALL SELECT doc_id, 0.5 / (60 + rank) FROM vs),
     g AS (SELECT doc_id, sum(rrf) AS score FROM u GROUP BY doc_id)
SELECT 'q1' AS query_id, doc_id, round(score, 9) AS score,
       row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM g QUALIFY rank <= 5
""")
def q_search_hybrid(spark, sf):
    kw = S.keyword_search(table(spark, sf, "documents"), [("q1", "then")], "doc_id", "text", top_k=10)
    qv = _query_vectors(spark, sf).where("query_id = 'label_0'").select(F.lit("q1").alias("query_id"), "vector")
    vs = S.vector_search(table(spark, sf, "embeddings"), "vec_id", "embedding", qv, top_k=10)
    out = S.hybrid_search(kw, vs, top_k=5)
    return out.withColumn("score", F.round("score", 9))


_C3, _L3 = _duck_redact_chain("hits", "query_id", "snippet", allow=True, extra_cols=", rank, doc_id")


@query("token_budget", f"""
WITH hits AS ({_kw_sql(10)}),
{_C3},
b AS (SELECT query_id, rank, doc_id, '### None' || chr(10) || t || chr(10) || chr(10) AS block FROM {_L3}),
r AS (SELECT *, sum(length(block) // 4) OVER (PARTITION BY query_id ORDER BY rank
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 5 AS running FROM b)
SELECT query_id, '## Relevant Context' || chr(10) || chr(10) || string_agg(block, '' ORDER BY rank) AS context,
       string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS sources, CAST(max(running) AS BIGINT) AS token_count
FROM r WHERE running <= 200 GROUP BY query_id
""")
def q_token_budget(spark, sf):
    hits = S.keyword_search(table(spark, sf, "documents"), _QUERIES, "doc_id", "text", top_k=10)
    return S.token_budget_context(hits, max_tokens=200)


@query("related_documents", f"""
WITH hits AS ({_kw_sql(10)}),
e AS (SELECT doc_id AS a, doc_id * 7 % 1000 AS b FROM documents),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
n AS (SELECT DISTINCT query_id, b AS doc_id FROM hits JOIN u ON hits.doc_id = u.a)
SELECT n.query_id, d.doc_id, d.source, row_number() OVER (PARTITION BY n.query_id ORDER BY d.doc_id) AS rank
FROM n JOIN documents d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = n.query_id AND h.doc_id = n.doc_id) QUALIFY rank <= 3
""")
def q_related_documents(spark, sf):
    d = table(spark, sf, "documents")
    hits = S.keyword_search(d, _QUERIES, "doc_id", "text", top_k=10)
    edges = d.select(F.col("doc_id").alias("src"), (F.col("doc_id") * 7 % 1000).alias("dst"))
    return S.related_documents(hits, edges, d.select("doc_id", "source")).select("query_id", "doc_id", "source", "rank")


def _li_edges(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"),
                     F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))


@query("graph_neighbors", """
SELECT src, dst, CASE WHEN src = 'p7' THEN dst ELSE src END AS neighbor,
       CASE WHEN src = 'p7' THEN 'outgoing' ELSE 'incoming' END AS direction
FROM (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem) WHERE src = 'p7' OR dst = 'p7'
""")
def q_graph_neighbors(spark, sf):
    return G.neighbors(_li_edges(spark, sf), "p7")


_KHOP_EDGES = """
SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


@query("graph_khop", f"""
WITH RECURSIVE e0 AS ({_KHOP_EDGES}),
e AS (SELECT src AS a, dst AS b FROM e0 UNION SELECT dst, src FROM e0),
walk(node, depth) AS (SELECT 's1', 0 UNION SELECT e.b, w.depth + 1 FROM walk w JOIN e ON e.a = w.node WHERE w.depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node
""")
def q_graph_khop(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("src"),
                                           F.concat(F.lit("n"), F.col("s_nationkey")).alias("dst"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"),
                                         F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    return G.k_hop(s.unionByName(n), ["s1"], 3)


@query("lineage_closure", """
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
                     UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
walk(node, depth) AS (SELECT 'r1', 0 UNION SELECT e.child, w.depth + 1 FROM walk w JOIN e ON e.parent = w.node
                      WHERE w.depth < 50)
SELECT node, CAST(min(depth) AS INTEGER) AS depth, 'down' AS direction FROM walk WHERE node <> 'r1' GROUP BY node
""")
def q_lineage_closure(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"),
                                         F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"),
                                           F.concat(F.lit("c"), F.col("c_custkey")).alias("child"))
    return G.lineage(n.unionByName(c), "r1", "down")



_REF_SQL = """
WITH t AS (SELECT doc_id, 'see ADR-' || lpad((doc_id % 90)::VARCHAR, 4, '0') || ', SPEC-' || lpad((doc_id % 70)::VARCHAR, 4, '0') || ' and DISC-' ||
       lpad((doc_id % 50)::VARCHAR, 3, '0') || ' or PLAN-' || lpad((doc_id % 30)::VARCHAR, 3, '0') || '.' AS x FROM documents)
SELECT DISTINCT doc_id AS source, unnest(regexp_extract_all(x, '(ADR|SPEC)-[0-9]{4}|(DISC|PLAN)-[0-9]{3}')) AS target, 'references' AS relation FROM t
UNION SELECT doc_id, 'ADR-' || lpad((doc_id % 9)::VARCHAR, 4, '0'), 'implements' FROM documents WHERE doc_id % 2 = 0
"""


@query("reference_ids", _REF_SQL)
def q_reference_ids(spark, sf):
    i = F.col("doc_id")

    def padded(n, width):
        return F.lpad((i % n).cast("string"), width, "0")

    plain = F.concat(F.lit("see ADR-"), padded(90, 4), F.lit(", SPEC-"), padded(70, 4), F.lit(" and DISC-"), padded(50, 3), F.lit(" or PLAN-"), padded(30, 3), F.lit("."))
    d = table(spark, sf, "documents").select("doc_id", plain.alias("text"))
    found = TX.extract_refs(d, "doc_id", "text")
    json = table(spark, sf, "documents").where(i % 2 == 0).select("doc_id", F.concat(F.lit('{"implements_adr": ["ADR-'), padded(9, 4), F.lit('"]}')).alias("text"))
    return found.unionByName(TX.extract_refs(json, "doc_id", "text", patterns=["never-[0-9]"]))


def _counts_allow_sql() -> str:
    ctes, _ = _duck_redact_chain("documents", "doc_id", "text", allow=True)
    sel = [f"SELECT doc_id, '{name}' AS type, CAST(len(list_filter(regexp_extract_all(t, '{p}'), lambda m: NOT regexp_matches(m, '{_ALLOW}'))) AS BIGINT) AS count FROM r{i}"
           for i, (name, p, _) in enumerate(TX.DEFAULT_PATTERNS)]
    return "WITH " + ctes + " SELECT * FROM (" + " UNION ALL ".join(sel) + ") WHERE count > 0"


@query("redaction_counts_allowlist", _counts_allow_sql())
def q_redaction_counts_allowlist(spark, sf):
    return TX.redaction_counts(table(spark, sf, "documents"), "doc_id", "text")


# JON-07 / TXT-11 ---------------------------------------------------------------------
_KW_CTE = rf"""kw AS (SELECT DISTINCT doc_id, lang, kw AS token FROM (
  SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+')) AS kw FROM documents)
  WHERE regexp_full_match(kw, '[a-z][a-z0-9_-]{{2,}}') AND length(kw) > 3 AND kw NOT IN ({_STOP_SQL})),
n AS (SELECT doc_id, count(*) AS n FROM kw GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS ov FROM kw a JOIN kw b
      ON a.lang = b.lang AND a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2),
jp AS (SELECT o.a, o.b, o.ov AS overlap, o.ov / (na.n + nb.n - o.ov) AS jaccard
       FROM o JOIN n na ON o.a = na.doc_id JOIN n nb ON o.b = nb.doc_id
       WHERE o.ov * 20 >= 3 * (na.n + nb.n - o.ov))"""


@query("jaccard_pairs", f"WITH {_KW_CTE} SELECT a, b, overlap, round(jaccard, 6) AS jaccard FROM jp")
def q_jaccard_pairs(spark, sf):
    from quarry.operators.similarity import jaccard_pairs, keyword_sets

    toks = keyword_sets(table(spark, sf, "documents"), "doc_id", "text", "lang")
    return rounded(jaccard_pairs(toks, 0.15))


@query("link_audit", f"""
WITH {_KW_CTE},
lk AS (SELECT d.doc_id AS s, d.doc_id + 1 AS t FROM documents d WHERE d.doc_id + 1 IN (SELECT doc_id FROM documents)),
lo AS (SELECT lk.s, lk.t, count(kb.token) AS ov FROM lk LEFT JOIN kw ka ON ka.doc_id = lk.s
       LEFT JOIN kw kb ON kb.doc_id = lk.t AND kb.token = ka.token GROUP BY 1, 2),
ls AS (SELECT lo.s, lo.t, CASE WHEN coalesce(ns.n, 0) + coalesce(nt.n, 0) - lo.ov > 0
                               THEN lo.ov / (coalesce(ns.n, 0) + coalesce(nt.n, 0) - lo.ov) ELSE 0.0 END AS sim
       FROM lo LEFT JOIN n ns ON ns.doc_id = lo.s LEFT JOIN n nt ON nt.doc_id = lo.t)
SELECT s AS source, t AS target, round(sim, 6) AS similarity,
       CASE WHEN sim < 0.05 THEN 'questionable' ELSE 'valid' END AS status FROM ls
UNION ALL
SELECT a, b, round(jaccard, 6), 'missing' FROM jp
WHERE NOT EXISTS (SELECT 1 FROM lk WHERE (lk.s = jp.a AND lk.t = jp.b) OR (lk.s = jp.b AND lk.t = jp.a))
""")
def q_link_audit(spark, sf):
    from quarry.operators.similarity import keyword_sets, link_audit

    d = table(spark, sf, "documents")
    toks = keyword_sets(d, "doc_id", "text", "lang")
    links = d.select(F.col("doc_id").alias("source"), (F.col("doc_id") + 1).alias("target")) \
        .join(d.select(F.col("doc_id").alias("target")), "target", "left_semi")
    return rounded(link_audit(toks, links, 0.15, 0.05))


# TXT-12 ------------------------------------------------------------------------------
_TARGETS = ["Small Ring", "widget", "band"]
_ALIASES = {"band": ["ring"]}


@query("fuzzy_levels", """
SELECT * FROM (SELECT 'Small Ring' AS target, p_name AS best, 1.0 AS confidence, 'exact' AS tier FROM part
               WHERE lower(p_name) = 'small ring' ORDER BY p_partkey LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'widget', p_name, CASE WHEN lower(p_name) = 'widget' THEN 1.0 ELSE 0.85 END,
                      CASE WHEN lower(p_name) = 'widget' THEN 'exact' ELSE 'substring' END FROM part
               WHERE contains(lower(p_name), 'widget')
               ORDER BY (lower(p_name) = 'widget') DESC, p_partkey LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'band', p_name, 0.9, 'alias' FROM part WHERE contains(lower(p_name), 'ring')
               ORDER BY p_partkey LIMIT 1)
""")
def q_fuzzy_levels(spark, sf):
    from quarry.operators.matching import match_names

    return match_names(table(spark, sf, "part"), "p_name", "p_partkey", _TARGETS, _ALIASES)


@query("fuzzy_names", """
SELECT 'Ringqqqq' AS target, p_name AS best, round(8.0 / (8 + length(p_name)), 9) AS confidence, 'fuzzy' AS tier
FROM part WHERE contains(lower(p_name), 'ring') ORDER BY length(p_name), p_partkey LIMIT 1
""")
def q_fuzzy_names(spark, sf):
    """The fuzzy tier wins: only "ring" is shared, so the ratio is twice its length over both lengths."""
    from quarry.operators.matching import match_names

    parts = table(spark, sf, "part").where(F.lower("p_name").contains("ring"))
    return match_names(parts, "p_name", "p_partkey", ["Ringqqqq"], fuzzy_min=0.3).withColumn("confidence", F.round("confidence", 9))


@query("lineage_deep", """
WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey::VARCHAR AS node, CAST(i % 1000 AS INTEGER) AS depth, 'down' AS direction FROM o WHERE i % 1000 > 0
""")
def q_lineage_deep(spark, sf):
    """Chains of a thousand orders each, from all their heads at once."""
    order = table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey")
    from quarry.operators.sorting import running_sum

    i = running_sum(order.withColumn("one", F.lit(1)).withColumn("g", F.lit(0)), ["g"], ["o_orderkey"], "one", "i").select((F.col("i") - 1).alias("i"), F.col("o_orderkey").cast("string").alias("node"))
    edges = i.where("i % 1000 < 999").select("i", F.col("node").alias("parent")).join(i.select((F.col("i") - 1).alias("i"), F.col("node").alias("child")), "i").select("parent", "child")
    return G.lineage(edges, i.where("i % 1000 = 0").select("node"), "down")


@query("expand_queries", """
SELECT doc_id, lang || CASE doc_id % 3 WHEN 0 THEN ' architecture decision alternatives consequences rationale patterns' WHEN 1 THEN ' milestones tasks dependencies verification implementation timeline' ELSE '' END || ' overview' AS query
FROM documents
""")
def q_expand_queries(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "ADR").when(F.col("doc_id") % 3 == 1, "plan").otherwise("other")
    return table(spark, sf, "documents").select("doc_id", S.expand_query(F.col("lang"), kind, "overview").alias("query"))


@query("embed_missing", """
SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0
""")
def q_embed_missing(spark, sf):
    """Only rows without a vector are embedded; run again, nothing is left (SRCH-06)."""
    e = table(spark, sf, "embeddings")
    text = e.select("vec_id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    first = S.embed_missing(text, e.where("vec_id % 4 = 0"), "vec_id", "text", S.hash_embedding(8), 8)
    done = e.where("vec_id % 4 = 0").select("vec_id").unionByName(first.select("vec_id"))
    again = S.embed_missing(text, done, "vec_id", "text", S.hash_embedding(8), 8)
    return first.where(F.size("vector") == 8).select("vec_id").unionByName(again.select("vec_id"))
