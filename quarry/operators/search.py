"""Keyword / vector / hybrid search and token-budget context (SRCH-01..06).

Searches run for a *batch* of queries of any size, a list or a DataFrame.  Queries are
a table in the shared folder, cut in blocks; a DataFrame of queries never
passes through the driver.  One scan of the corpus meets all blocks: a task takes
a stretch of documents at a time and reads one block after the other.  A keyword block is one
Aho-Corasick automaton (a few words are matched column by column), a vector block one matrix that is
multiplied with the stretch.  Of a stretch at most k rows a query leave the task; no pair of
document and query is ever a row.  Only the merge of those is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.sorting import top_k_per_group
from quarry.operators.text import DEFAULT_ALLOWLIST, DEFAULT_PATTERNS, redact_df
from quarry.session import scratch_path
from quarry.sources.heads import can_open, open_path

QUERY_BLOCK = 4_096
#: Words that are matched one by one; bytes of documents held at a time; vectors of one product.
FEW_WORDS, GROUP_BYTES, PRODUCT_ROWS = 32, 64 * 1024 * 1024, 1_000
RRF_K = 60

# ship this module's mapInPandas code with the task (executors need not have the package)
from pyspark import cloudpickle as _cloudpickle  # noqa: E402
import sys as _sys  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
CONTEXT_HEADER = "## Relevant Context\n\n"
SNIPPET_CHARS = 200


def _write_blocks(spark: SparkSession, queries: DataFrame | Sequence[tuple], value: str) -> tuple[str, int]:
    """Queries (id, text or vector) as a table in the shared folder, cut in blocks by a hash: its folder and how many blocks."""
    kind = f"query_id string, value {value}"
    if isinstance(queries, DataFrame):
        q, v = queries.columns[:2]
        table = queries.select(F.col(q).cast("string").alias("query_id"), F.col(v).cast(value).alias("value"))
    else:
        table = spark.createDataFrame([(str(q), v) for q, v in queries], kind)
    folder = scratch_path(spark, "queries")
    if not can_open(folder):
        raise ValueError(f"searches read their queries from spark.checkpoint.dir, which tasks cannot open: {folder}")
    table = table.where("query_id IS NOT NULL")
    count = -(-table.count() // QUERY_BLOCK)
    if count:
        table.withColumn("block", F.pmod(F.xxhash64("query_id", "value"), F.lit(count)).cast("int")).repartition(count, "block").write.partitionBy("block").parquet(folder)
    return folder, count


def _read_block(folder: str, block: int) -> tuple[list, list]:
    """(ids, values) of one block, read by a task."""
    fs, root = open_path(f"{folder}/block={block}")
    found = [f.path for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=fs, columns=["query_id", "value"], partitioning=None) for f in found]
    return [q for t in tables for q in t.column(0).to_pylist()], [v for t in tables for v in t.column(1).to_pylist()]


def _grid(folder: str, blocks: int, prepare: Callable, search: Callable, one_by_one: bool = False):
    """A task over a corpus partition: stretches of ``GROUP_BYTES`` against one block of queries after the other.

    ``prepare(ids, values)`` makes a block's matcher and ``search(matcher, batches)`` the best rows of a stretch.  A single block
    is prepared once; a search that goes ``one_by_one`` through its batches then gets them as they come, and none is held."""
    def run(batches: Iterator[pa.RecordBatch]):
        if one_by_one and blocks == 1:
            yield from search(prepare(*_read_block(folder, 0)), batches)
            return
        held, size, only = [], 0, None

        def meet():
            nonlocal only
            for k in range(blocks):
                matcher = only if only is not None else prepare(*_read_block(folder, k))
                if blocks == 1:
                    only = matcher
                yield from search(matcher, held)

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > GROUP_BYTES:
                yield from meet()
                held, size = [], 0
        if held:
            yield from meet()

    return run


def _best_of(found: DataFrame, top_k: int) -> DataFrame:
    return top_k_per_group(found, ["query_id"], "score", top_k, ["doc_id"], rank_col="rank")


# SRCH-01 -------------------------------------------------------------------------
def keyword_search(docs: DataFrame, queries: DataFrame | Sequence[tuple[str, str]], id_col: str, content_col: str,
                   title_col: str | None = None, archived_col: str | None = None, top_k: int = 10) -> DataFrame:
    """Case-insensitive substring match in title or content; not archived;
    top_k per query ordered by document id; 200-char snippet; score 1.0."""
    import ahocorasick

    base = docs.filter(F.col(archived_col).isNull()) if archived_col else docs
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    base = base.select(F.col(id_col).alias("doc_id"), title.alias("title"), F.substring(content_col, 1, SNIPPET_CHARS).alias("snippet"),
                       F.lower(F.col(content_col)).alias("__c"), F.lower(title).alias("__t")).where("doc_id IS NOT NULL")
    out = T.StructType([T.StructField("query_id", T.StringType()), *base.select("doc_id", "title", "snippet").schema.fields])

    def prepare(ids: list[str], texts: list[str]):
        by_word: dict[str, list] = {}
        for q, text in zip(ids, texts):
            by_word.setdefault((text or "").lower(), []).append(q)
        everywhere, words = by_word.pop("", []), None
        if len(by_word) > FEW_WORDS:
            words = ahocorasick.Automaton()
            for w, q in by_word.items():
                words.add_word(w, q)
            words.make_automaton()
        return by_word, everywhere, words

    def search(matcher, batches: Iterable[pa.RecordBatch]):
        by_word, everywhere, words = matcher
        best: dict[str, list] = {}
        id_type = None

        def found(queries, rows):
            for q in queries:
                kept = best.setdefault(q, [])
                kept += rows
                if len(kept) >= 4 * top_k:  # now and then back to the k smallest ids
                    kept.sort(key=lambda r: r[0])
                    del kept[top_k:]

        for b in batches:
            head, content, low = b.select(["doc_id", "title", "snippet"]), b.column("__c"), b.column("__t")
            id_type = b.schema.field(0).type

            def rows_of(mask):
                return [tuple(r.values()) for r in head.filter(mask).to_pylist()]

            if everywhere:
                found(everywhere, rows_of(pc.is_valid(content)))
            if words is None:  # a few words: each through the whole column
                for w, queries in by_word.items():
                    hit = [pc.fill_null(pc.match_substring(c, w), False) for c in (content, low)]
                    if rows := rows_of(pc.or_(*hit)):
                        found(queries, rows)
                continue
            for i, (text, title) in enumerate(zip(content.to_pylist(), low.to_pylist())):
                hits = {q for t in (text, title) if t for _, ids in words.iter(t) for q in ids}
                if hits:
                    row = [tuple(head.slice(i, 1).to_pylist()[0].values())]
                    for q in hits:
                        found([q], row)
        rows = [(q, *r) for q, kept in best.items() for r in sorted(kept, key=lambda r: r[0])[:top_k]]
        if rows:
            types = [pa.string(), id_type, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["query_id", "doc_id", "title", "snippet"])

    folder, blocks = _write_blocks(docs.sparkSession, queries, "string")
    return _best_of(base.mapInArrow(_grid(folder, blocks, prepare, search, one_by_one=True), out).withColumn("score", F.lit(1.0)), top_k)


# SRCH-02 -------------------------------------------------------------------------
def collect_query_vectors(queries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """A batch of query vectors for :func:`vector_search`: query_id, vector."""
    return queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("vector"))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row stays zero, so its cosines are 0."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def vector_search(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame | Sequence[tuple],
                  top_k: int = 10) -> DataFrame:
    """Cosine similarity (zero norm -> 0) of every corpus vector with every query
    vector of the same dimension; top_k per query (score desc, id asc)."""
    base = corpus.select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<double>").alias("v")).where("doc_id IS NOT NULL AND v IS NOT NULL")
    out = T.StructType([T.StructField("query_id", T.StringType()), base.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def prepare(ids: list[str], vectors: list[list[float]]):
        by_dim: dict[int, list] = {}
        for q, v in zip(ids, vectors):
            if v is not None:
                by_dim.setdefault(len(v), []).append((q, v))
        return {d: ([q for q, _ in qs], _unit_rows(np.array([v for _, v in qs], np.float64))) for d, qs in by_dim.items()}

    def search(matrices, batches: list[pa.RecordBatch]):
        # of each dimension: query, score and place of the best so far, and the k-th score of each query
        best = {d: (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.full(len(m[0]), -np.inf)) for d, m in matrices.items()}
        ids = pa.chunked_array([b.column(0) for b in batches]).to_numpy()
        at = 0
        for b in batches:
            lists, places = b.column(1), np.arange(at, at + b.num_rows)
            at += b.num_rows
            sizes = pc.list_value_length(lists).to_numpy()
            for d in set(sizes.tolist()) & matrices.keys():
                rows, (_, m) = np.flatnonzero(sizes == d), matrices[d]
                vectors = pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
                for lo in range(0, len(rows), PRODUCT_ROWS):
                    q, s, i, least = best[d]
                    scores = m @ _unit_rows(vectors[lo:lo + PRODUCT_ROWS]).T
                    new_q, new_i = np.nonzero(scores >= least[:, None])
                    if not len(new_q):
                        continue
                    q, s, i = np.concatenate([q, new_q]), np.concatenate([s, scores[new_q, new_i]]), np.concatenate([i, places[rows[lo + new_i]]])
                    order = np.lexsort((ids[i], -s, q))
                    q, s, i = q[order], s[order], i[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    least = least.copy()
                    least[q[rank == top_k - 1]] = s[rank == top_k - 1]
                    best[d] = q[rank < top_k], s[rank < top_k], i[rank < top_k], least
        for d, (q, s, i, _) in best.items():
            if len(q):
                names = np.array(matrices[d][0], object)
                yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.string()), pa.array(ids[i], batches[0].schema.field(0).type), pa.array(s)], names=["query_id", "doc_id", "score"])

    folder, blocks = _write_blocks(corpus.sparkSession, [(q, [float(x) for x in v] if v is not None else None) for q, v in queries] if not isinstance(queries, DataFrame) else queries, "array<double>")
    return _best_of(base.mapInArrow(_grid(folder, blocks, prepare, search), out), top_k)


# SRCH-03 -------------------------------------------------------------------------
def hybrid_search(keyword_hits: DataFrame, vector_hits: DataFrame, top_k: int = 10, fts_weight: float = 0.5,
                  vec_weight: float = 0.5) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (each already 2*top_k long):
    score = sum of w / (60 + rank0 + 1); a document hit several times sums."""
    k = F.lit(RRF_K)
    a = keyword_hits.select("query_id", "doc_id", (F.lit(fts_weight) / (k + F.col("rank"))).alias("rrf"))
    b = vector_hits.select("query_id", "doc_id", (F.lit(vec_weight) / (k + F.col("rank"))).alias("rrf"))
    fused = a.unionByName(b).groupBy("query_id", "doc_id").agg(F.sum("rrf").alias("score"))
    return top_k_per_group(fused, ["query_id"], "score", top_k, ["doc_id"], rank_col="rank")


# SRCH-04 -------------------------------------------------------------------------
# Query expansion terms per artifact type.
EXPANSIONS = {
    "discussion": "requirements design options tradeoffs stakeholders considerations",
    "adr": "architecture decision alternatives consequences rationale patterns",
    "spec": "API endpoints data model schema requirements validation",
    "plan": "milestones tasks dependencies verification implementation timeline",
}


def expand_query(query: Column, artifact_type: Column, general_terms: str = "") -> Column:
    """The query, its artifact type's terms and the caller's general terms, blank-separated."""
    m = F.create_map(*[F.lit(x) for kv in EXPANSIONS.items() for x in kv])
    return F.concat_ws(" ", query, F.try_element_at(m, F.lower(artifact_type)), F.nullif(F.lit(general_terms), F.lit("")))


# SRCH-05 -------------------------------------------------------------------------
def token_budget_context(hits: DataFrame, max_tokens: int = 2000, sanitize: bool = True,
                         patterns=tuple(DEFAULT_PATTERNS), allowlist=tuple(DEFAULT_ALLOWLIST)) -> DataFrame:
    """Per query: header + ``### title\\nsnippet\\n\\n`` blocks in rank order,
    stopping at the first block that would exceed the budget (tokens = len // 4).

    The stop rule is a running sum over (query, rank) -- identical to the loop
    because token counts are non-negative; the window holds one query's hits."""
    header_tokens = len(CONTEXT_HEADER) // 4
    if sanitize:
        hits = redact_df(hits, "snippet", "__clean", patterns, allowlist)
    snippet = F.col("__clean") if sanitize else F.col("snippet")
    block = F.concat(F.lit("### "), F.coalesce(F.col("title"), F.lit("None")), F.lit("\n"), snippet, F.lit("\n\n"))
    blocks = hits.select("query_id", "rank", "doc_id", block.alias("block")) \
        .withColumn("tokens", F.floor(F.length("block") / 4).cast("bigint"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = blocks.withColumn("running", F.sum("tokens").over(w) + header_tokens)
    fits = F.col("running") <= max_tokens
    # a query whose first block does not fit still gets the header-only context
    ordered = F.sort_array(F.collect_list(F.when(fits, F.struct("rank", "block", "doc_id"))))
    used = F.coalesce(F.max(F.when(fits, F.col("running"))), F.lit(header_tokens).cast("bigint"))
    return ranked.groupBy("query_id").agg(ordered.alias("__b"), used.alias("token_count")).select(
        "query_id", F.concat(F.lit(CONTEXT_HEADER), F.array_join(F.transform("__b", lambda x: x["block"]), ""))
        .alias("context"),
        F.array_join(F.transform("__b", lambda x: x["doc_id"].cast("string")), ",").alias("sources"),
        "token_count")


RELATED_MAX, RELATED_CHARS = 3, 150
RELATED_HEADER = "### Related Documents\n"


def related_documents(hits: DataFrame, edges: DataFrame, docs: DataFrame, id_col: str = "doc_id", src: str = "src", dst: str = "dst",
                      most: int = RELATED_MAX) -> DataFrame:
    """Per query at most ``most`` documents one hop from its hits and not among them, by id, with the documents' columns."""
    und = edges.select(F.col(src).alias("doc_id"), F.col(dst).alias("__to")).unionByName(edges.select(F.col(dst).alias("doc_id"), F.col(src).alias("__to")))
    near = hits.select("query_id", "doc_id").join(und, "doc_id").select("query_id", F.col("__to").alias("doc_id")).distinct().join(
        hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    found = near.join(docs.withColumnRenamed(id_col, "doc_id"), "doc_id")  # targets that exist
    return top_k_per_group(found.withColumn("__s", F.lit(1.0)), ["query_id"], "__s", most, ["doc_id"], rank_col="rank").drop("__s")


def add_related(contexts: DataFrame, related: DataFrame, max_tokens: int = 2000, title_col: str = "title", type_col: str = "type",
                text_col: str = "text") -> DataFrame:
    """Contexts of :func:`token_budget_context` with a list of related documents, as long as the budget is not passed."""
    line = F.concat(F.lit("- **"), F.coalesce(F.col(title_col), F.lit("None")), F.lit("** ("), F.col(type_col), F.lit("): "),
                    F.left(F.col(text_col), F.lit(RELATED_CHARS)), F.lit("...\n"))
    lines = related.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("__l"))
    start = F.struct(F.lit("").alias("text"), F.col("token_count").alias("n"))
    grown = F.aggregate("__l", start, lambda a, x: F.when(a["n"] > max_tokens, a).otherwise(F.struct(
        F.concat(a["text"], x["line"]).alias("text"), (a["n"] + F.floor(F.length(x["line"]) / 4)).cast("bigint").alias("n"))))
    out = contexts.join(lines, "query_id", "left").withColumn("__g", F.when(F.size("__l") > 0, grown))
    return out.select("query_id", F.when(F.col("__g").isNull(), F.col("context")).otherwise(F.concat("context", F.lit(RELATED_HEADER), F.col("__g.text"))).alias("context"),
                      "sources", F.coalesce("__g.n", "token_count").alias("token_count"))


# SRCH-06 -------------------------------------------------------------------------
def embed_missing(chunks: DataFrame, embeddings: DataFrame, id_col: str, text_col: str,
                  embed_fn: Callable, dim: int) -> DataFrame:
    """Embed only the chunks that have no vector yet (resumable: run again and
    already embedded chunks are skipped).  ``embed_fn(list[str]) -> list[list[float]]``
    runs in ``mapInPandas`` batches on the executors."""
    import pandas as pd

    todo = chunks.join(embeddings.select(id_col), id_col, "left_anti").select(id_col, text_col)

    def run(batches):
        for pdf in batches:
            vecs = embed_fn(pdf[text_col].fillna("").tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "vector": [list(map(float, v)) for v in vecs]})

    id_type = todo.schema[id_col].dataType.simpleString()
    return todo.mapInPandas(run, schema=f"{id_col} {id_type}, vector array<float>")


def hash_embedding(dim: int = 16) -> Callable:
    """A deterministic embedding (no model files): token hashes folded into ``dim`` buckets."""
    import hashlib

    def fn(texts):
        out = []
        for t in texts:
            v = [0.0] * dim
            for tok in t.lower().split():
                h = int(hashlib.md5(tok.encode()).hexdigest(), 16)
                v[h % dim] += 1.0 if (h >> 8) & 1 else -1.0
            out.append(v)
        return out

    return fn


def threshold(hits: DataFrame, min_score: float) -> DataFrame:
    """OPT-07: similarity threshold on search results."""
    return hits.filter(F.col("score") >= F.lit(min_score))


# OPT-06 ---------------------------------------------------------------------------
def bm25_search(docs: DataFrame, id_col: str, text_col: str, queries: Sequence[tuple[str, str]], top_k: int = 10,
                k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over lower-cased word tokens: score = sum over query terms of
    idf * tf*(k1+1) / (tf + k1*(1 - b + b*dl/avgdl)), idf = ln((N-df+0.5)/(df+0.5) + 1).

    Only the query terms are counted (a literal array filter), so the term table
    is |documents| x |query terms| at most; N and avgdl come from one aggregate."""
    terms = sorted({t.lower() for _q, text in queries for t in text.split()})
    if not terms:
        raise ValueError("empty queries")
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}_]+"), 0)
    base = docs.select(F.col(id_col).alias("doc_id"), toks.alias("__t"))
    stats_row = base.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("__t")).alias("avgdl")).first()
    n_docs, avgdl = stats_row["N"], stats_row["avgdl"] or 0.0
    tarr = F.array(*[F.lit(t) for t in terms])
    tf = (base.select("doc_id", F.size("__t").alias("dl"),
                      F.explode(F.filter("__t", lambda x: F.array_contains(tarr, x))).alias("term"))
          .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = (tf.join(F.broadcast(dfreq), "term")  # one row per query term
            .withColumn("w", idf * F.col("tf") * (k1 + 1)
                        / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))))
    qmap = [(q, sorted({t.lower() for t in text.split()})) for q, text in queries]
    qarr = F.array(*[F.struct(F.lit(q).alias("query_id"), F.array(*[F.lit(t) for t in ts]).alias("ts"))
                     for q, ts in qmap])
    scored = (part.select("doc_id", "term", "w", F.explode(F.filter(qarr, lambda x: F.array_contains(x["ts"],
                                                                                               F.col("term"))))
                          .alias("q"))
              .groupBy(F.col("q.query_id").alias("query_id"), "doc_id").agg(F.sum("w").alias("score")))
    return top_k_per_group(scored, ["query_id"], "score", top_k, ["doc_id"], rank_col="rank")
