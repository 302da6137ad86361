"""Registered queries of the subpackage: one ``opN_<name>`` per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def line_dedup_sql(docs: str) -> str:
    """Statement that returns doc_id, n_lines, n_dropped and kept (text) for a documents relation."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS kept
    FROM (SELECT l.*, coalesce(l.doc_id <> o.owner, false) AS dropped
          FROM (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {space}) AS k
                FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
                      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}))) l
          LEFT JOIN (SELECT k, max(doc_id) AS owner
                     FROM (SELECT doc_id, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {space}) AS k
                           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {docs}))
                     WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5) o ON l.k = o.k)
    GROUP BY doc_id"""


ORACLES["op4_line_dedup"] = f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({line_dedup_sql('documents')})"


@query
def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


#: Target parts of the named sources, and of all others together (shared evenly among them).
MIX_WEIGHTS, MIX_REST = {"src0": 8, "src1": 5, "src2": 4, "src3": 3}, 20


@query
def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS, MIX_REST)


ORACLES["op6_pfair_mixing"] = """
WITH RECURSIVE named AS (SELECT * FROM (VALUES ('src0', 8, 0), ('src1', 5, 1), ('src2', 4, 2), ('src3', 3, 3)) v(source, w, o)),
others AS (SELECT DISTINCT source FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM named)),
raw AS (SELECT source, w * greatest(1, (SELECT count(*) FROM others)) AS c, o FROM named
        UNION ALL SELECT source, 20, 3 + row_number() OVER (ORDER BY source NULLS FIRST) FROM others),
num_ AS (SELECT source, c, row_number() OVER (ORDER BY o) AS s FROM raw),
cfg AS (SELECT list_transform(l, lambda x: (x // g)::BIGINT) AS c, (list_sum(l) // g)::BIGINT AS p, 16 AS bd, len(l) AS m
        FROM (SELECT list(c ORDER BY s) AS l, list_reduce(list(c ORDER BY s), lambda a, b: gcd(a, b)) AS g FROM num_)),
edf(t, k, pick) AS (
  SELECT -1::BIGINT, list_transform(c, lambda x: 0::BIGINT), 0::BIGINT FROM cfg
  UNION ALL
  SELECT t + 1, list_transform(k, lambda x, i: x + (i = pick)::BIGINT), pick
  FROM (SELECT t, k, p, (SELECT i FROM (SELECT unnest(range(1, m + 1)) AS i)
                      WHERE k[i] < c[i] AND k[i] * p < (t + 2) * c[i]
                      ORDER BY ceil((k[i] + 1) * p / c[i]), i LIMIT 1) AS pick
        FROM edf, cfg WHERE t < p - 1)),
slots AS (SELECT t AS slot, pick, k[pick] - 1 AS j FROM edf WHERE t >= 0),
docs AS (SELECT d.doc_id, d.source, n.s FROM documents d JOIN num_ n ON n.source IS NOT DISTINCT FROM d.source),
num AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS n FROM docs),
blk AS (SELECT num.*, n // bd AS block, c[s] AS cs, p FROM num, cfg),
share AS (SELECT min(((coalesce(n, 0) + bd - 1) // bd) * p // cfg.c[s]) AS x FROM num_ LEFT JOIN (SELECT s, count(*) AS n FROM docs GROUP BY s) USING (s), cfg)
SELECT doc_id, source, (s - 1)::INT AS stream, block, (block * p) // cs AS release, ((block + 1) * p + cs - 1) // cs AS deadline,
       (block // cs) * p + slot AS slot,
       row_number() OVER (ORDER BY (block // cs) * p + slot, n) - 1 AS position, (block // cs) * p + slot < (SELECT x FROM share) AS in_share
FROM blk JOIN slots ON pick = s AND j = block % cs"""


@query
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lm.remainder(F.col("doc_id"), 7) == 2
    model = lm.train(docs.where(~held_out), order=3)
    return lm.score(docs, model).withColumn("held_out", held_out)


@query
def op5_byte_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import langid
    from quarry.llm.lm import remainder

    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return langid.identify(docs, langid.train(docs.where(~held_out))).withColumn("held_out", held_out)


@query
def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quarry.llm import quality
    from quarry.llm.lm import remainder

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 3) == 1
    return quality.score(docs, quality.train(docs, labels.where(~held_out))).withColumn("held_out", held_out)


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op8_nn_descent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id"""

ORACLES["op8_nn_descent_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT x.vec_id, coalesce(l.n, 0) AS n_links, m.c AS component_id, x.vec_id = m.c AS kept
FROM embeddings x JOIN m ON m.a = x.vec_id LEFT JOIN l ON l.a = x.vec_id"""


@query
def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.curve_packing import pack_on_curve

    return pack_on_curve(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.conversation_repair import damage, repair, report

    return report(repair(damage(table(spark, sf_dir, "conversations"))))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB: eight steps a byte, marked -1."""
    marks = f"list_transform(string_split({text}, ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1])"
    return (f"xor(list_reduce(flatten({marks}), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, "
            "4294967295::BIGINT), 4294967295::BIGINT)")


#: Costs of the rest by state (0 nothing, 1 s, 2 u, 3 ua), from the last turn to the first; then the least edits from the first turn on.
ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said FROM conversations),
hit AS (SELECT *, {crc32_sql('said')} % 20 AS k FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
               CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE k <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i,
               rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
fault AS (SELECT *, body = '' AS b, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS d, left(role, 1) AS c FROM num),
row_ AS (SELECT conv_id, turn, role, text, i, b, d, NOT b AND NOT d AND right(body, 1) NOT IN ('.', '!', '?') AS t, c, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM fault),
ends AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (b) AS blank, count(*) FILTER (d) AS duplicate, count(*) FILTER (t) AS truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM row_ GROUP BY conv_id),
cost AS (
  SELECT conv_id, n + 1 AS i, 0 AS c0, 4 AS c1, 2 AS c2, 0 AS c3 FROM ends
  UNION ALL
  SELECT conv_id, i, least(b0, 2 + b2, 4 + b3), least(b1, 2 + b2, 4 + b3), least(b2, 2 + b3), least(b3, 2 + b2)
  FROM (SELECT r.conv_id, r.i, CASE WHEN b OR d THEN 3 + c0 ELSE least(3 + c0, t::INT + 2 + c2, t::INT + CASE c WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 999999999 END) END AS b0,
               CASE WHEN b OR d THEN 3 + c1 ELSE least(3 + c1, t::INT + 2 + c2, t::INT + CASE c WHEN 'u' THEN c2 ELSE 999999999 END) END AS b1,
               CASE WHEN b OR d THEN 3 + c2 ELSE least(3 + c2, t::INT + 2 + c3, t::INT + CASE c WHEN 'a' THEN c3 ELSE 999999999 END) END AS b2,
               CASE WHEN b OR d THEN 3 + c3 ELSE least(3 + c3, t::INT + 2 + c2, t::INT + CASE c WHEN 'u' THEN c2 ELSE 999999999 END) END AS b3
        FROM cost JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM cost.conv_id AND r.i = cost.i - 1)),
vec AS (SELECT conv_id, i, [c0, c1, c2, c3] AS v FROM cost),
step AS (SELECT x.conv_id, x.i, x.v, y.v AS after, r.role, r.text, r.c, r.t::INT AS t, r.b OR r.d AS gone
         FROM vec x LEFT JOIN vec y ON y.conv_id IS NOT DISTINCT FROM x.conv_id AND y.i = x.i + 1 LEFT JOIN row_ r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i),
path AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS said, v[1] AS total, false AS done FROM vec WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN e IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
         CASE WHEN e IN ('I', 'R') THEN nq WHEN e = 'K' THEN kq ELSE q END, audit || e,
         CASE WHEN e = 'I' THEN list_append(said, nrole || ':') WHEN e = 'R' THEN list_append(said, nrole || ':' || text) WHEN e = 'K' THEN list_append(said, role || ':' || text) ELSE said END,
         total, e = ''
  FROM (SELECT *, CASE WHEN after IS NULL AND v[q + 1] = 0 THEN '' WHEN v[q + 1] = 3 + after[q + 1] THEN 'D' WHEN v[q + 1] = 2 + v[nq + 1] THEN 'I'
                       WHEN NOT gone AND kq IS NOT NULL AND v[q + 1] = t + after[kq + 1] THEN 'K' ELSE 'R' END AS e
        FROM (SELECT p.*, s.v, s.after, s.role, s.text, s.t, s.gone, CASE WHEN q = 2 THEN 3 ELSE 2 END AS nq, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END AS nrole,
                     CASE WHEN q = 2 AND c = 'a' THEN 3 WHEN q <> 2 AND c = 'u' THEN 2 WHEN q = 0 AND c = 's' THEN 1 END AS kq
              FROM path p JOIN step s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i WHERE NOT p.done)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(total, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM path WHERE done) p ON p.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_conversation_trie"] = f"""
WITH src AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, md5(length(role) || ':' || role || text) AS k, length(text) AS chars,
               row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS at FROM src),
ids AS (SELECT c, c - c % 100 AS base, {crc32_sql('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM src)),
taken AS (SELECT i.c, i.h, count(o.c) AS n FROM ids i LEFT JOIN own o ON o.c = i.base AND o.at < i.h GROUP BY ALL),
turns AS (SELECT i.c, o.at + 1 AS depth, o.k, o.chars FROM ids i JOIN own o ON o.c = i.base AND o.at < i.h
          UNION ALL SELECT t.c, t.n + o.at - t.h + 1, o.k, o.chars FROM taken t JOIN own o ON o.c = t.c AND o.at >= t.h),
path AS (SELECT c, depth, chars, string_agg(k, '') OVER (PARTITION BY c ORDER BY depth) AS node FROM turns
         UNION ALL SELECT c, 0, 0, '' FROM ids),
deepest AS (SELECT c, max(depth) AS d FROM path GROUP BY c),
nodes AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM path GROUP BY ALL),
kids AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
tree AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node)),
sums AS (SELECT p.node, count(*) FILTER (t.n_children = 0) AS n_leaves, sum((t.n_convs - 1) * t.chars) AS saved_tokens
         FROM tree t JOIN path p ON p.c = t.conv_id AND p.depth <= t.depth GROUP BY p.node),
ends AS (SELECT p.node, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM path p JOIN deepest d ON d.c = p.c AND d.d = p.depth GROUP BY p.node)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tree t JOIN sums s USING (node) LEFT JOIN nodes p ON t.depth > 0 AND p.node = left(t.node, length(t.node) - 32) LEFT JOIN ends e ON e.node = t.node"""
