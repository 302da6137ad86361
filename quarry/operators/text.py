"""Text and document operators (TXT-01..12).

Everything is a column expression over whole texts (``split``,
``regexp_extract_all``, higher-order ``transform``/``zip_with``/``filter``),
so the work is distributed by document and stays in the JVM.  Chunks and their
offsets are made within the document's row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.arrays import bound, running_totals

# Redaction patterns, in the order they are applied, with their replacement text.
DEFAULT_PATTERNS: list[tuple[str, str, str]] = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    ("api_key", r"sk-[a-zA-Z0-9]{20,}", "[API_KEY]"),
    ("aws_key", r"AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CARD]"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"),
    ("bearer_token", r"Bearer\s+[a-zA-Z0-9._-]+", "[BEARER_TOKEN]"),
]
# Literal that every match of a default pattern contains (a cheap pre-check).
LITERAL_HINTS = {DEFAULT_PATTERNS[0][1]: "@", DEFAULT_PATTERNS[1][1]: "sk-", DEFAULT_PATTERNS[2][1]: "AKIA",
                 DEFAULT_PATTERNS[7][1]: "Bearer"}
# Optional extra pattern from the redaction configuration.
INTERNAL_IP_PATTERN = ("internal_ip", r"\b(?:10|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.[0-9.]+\b", "[INTERNAL_IP]")
# Matches containing one of these (case-insensitive) are kept.
DEFAULT_ALLOWLIST: list[str] = [r"example\.com", r"localhost", r"127\.0\.0\.1", r"test@test\.com"]
CONFIG_ALLOWLIST: list[str] = DEFAULT_ALLOWLIST + [r"0\.0\.0\.0"]

# Keyword stop words.
STOP_WORDS: list[str] = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "dare",
    "this", "that", "these", "those", "and", "or", "but", "if", "then",
    "else", "when", "where", "why", "how", "all", "each", "every", "both",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "just", "for",
    "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "once", "of",
]

# Reference id patterns found in document text.
REFERENCE_PATTERNS: list[str] = [r"ADR-\d{4}", r"SPEC-\d{4}", r"DISC-\d{3}", r"PLAN-\d{3}"]
REFERENCE_JSON_FIELDS: list[str] = ["implements_adr", "resulting_specs", "source_references", "references"]

# Chunk split patterns by strategy.
CHUNK_PATTERNS = {
    "markdown_headers": r"\n(?=## )",
    "python_functions": r"\n(?=(?:def |class |async def ))",
    "paragraphs": r"\n\n+",
}
CHARS_PER_TOKEN = 4

# White space as ``str.strip()`` knows it.
_WS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading/trailing (Unicode) whitespace."""
    return F.btrim(c, F.lit(_WS))


# TXT-01 -------------------------------------------------------------------------
def _allow_regex(allowlist: Sequence[str]) -> str | None:
    return "(?i)(?:" + "|".join(allowlist) + ")" if allowlist else None


def redact_pattern(text: Column, pattern: str, replacement: str, allowlist: Sequence[str] = ()) -> Column:
    """Replace every match not containing an allow-listed value.

    Without an allow-list this is ``regexp_replace``.  With one, the text is
    split at the matches and re-assembled, each match replaced or kept."""
    allow = _allow_regex(allowlist)
    hint = LITERAL_HINTS.get(pattern)
    if allow is None:
        out = F.regexp_replace(text, pattern, replacement)
    else:
        matches = F.regexp_extract_all(text, F.lit(pattern), 0)
        pieces = F.split(text, pattern, -1)
        kept = F.transform(matches, lambda m: F.when(m.rlike(allow), m).otherwise(F.lit(replacement)))
        tail = F.zip_with(kept, F.slice(pieces, 2, F.size(matches)), lambda r, s: F.concat(r, s))
        # cheap paths first: no match -> unchanged; no allow-listed match -> plain replace;
        # only texts holding an allow-listed match pay for split + re-assembly
        out = (F.when(text.isNull() | (F.size(matches) == 0), text)
               .when(~F.exists(matches, lambda m: m.rlike(allow)), F.regexp_replace(text, pattern, replacement))
               .otherwise(F.concat(pieces[0], F.array_join(tail, ""))))
    # a literal every match must contain: texts without it skip the regex entirely
    return F.when(F.contains(text, F.lit(hint)), out).otherwise(text) if hint else out


def redact(text: Column, patterns: Sequence[tuple[str, str, str]] = tuple(DEFAULT_PATTERNS),
           allowlist: Sequence[str] = ()) -> Column:
    """All patterns in order as one expression.  Only for ``allowlist=()``
    (a chain of ``regexp_replace``); with an allow-list use ``redact_df`` which
    materialises each stage so the text expression is not duplicated."""
    if allowlist:
        raise ValueError("use redact_df for allow-listed redaction")
    for _name, pat, rep in patterns:
        text = F.regexp_replace(text, pat, rep)
    return text


def redact_df(df: DataFrame, text_col: str, out_col: str,
              patterns: Sequence[tuple[str, str, str]] = tuple(DEFAULT_PATTERNS),
              allowlist: Sequence[str] = tuple(DEFAULT_ALLOWLIST)) -> DataFrame:
    """All patterns in order, each applied to the text left by the previous ones;
    matches containing an allow-listed value are kept.  One projection per
    pattern (Catalyst keeps them apart because inlining would repeat work)."""
    df = df.withColumn(out_col, F.col(text_col))
    for _name, pat, rep in patterns:
        df = df.withColumn(out_col, redact_pattern(F.col(out_col), pat, rep, allowlist))
    return df


# TXT-02 -------------------------------------------------------------------------
def _staged(df: DataFrame, id_col: str, text_col: str, patterns, allowlist) -> DataFrame:
    """Columns __s0.. = the text before each pattern, one projection per stage."""
    out = df.select(id_col, F.col(text_col).alias("__s0"))
    for i, (_name, pat, rep) in enumerate(patterns[:-1]):
        out = out.withColumn(f"__s{i + 1}", redact_pattern(F.col(f"__s{i}"), pat, rep, allowlist))
    return out


def redaction_counts(df: DataFrame, id_col: str, text_col: str,
                     patterns: Sequence[tuple[str, str, str]] = tuple(DEFAULT_PATTERNS),
                     allowlist: Sequence[str] = tuple(DEFAULT_ALLOWLIST)) -> DataFrame:
    """Per document and pattern: number of redactions (non-allow-listed matches
    in the text as left by earlier patterns); only non-zero rows."""
    allow = _allow_regex(allowlist)
    staged = _staged(df, id_col, text_col, list(patterns), allowlist)
    counts = []
    for i, (name, pat, _rep) in enumerate(patterns):
        ms = F.regexp_extract_all(F.col(f"__s{i}"), F.lit(pat), 0)
        if allow:
            ms = F.filter(ms, lambda m: ~m.rlike(allow))
        counts.append(F.struct(F.lit(name).alias("type"), F.size(ms).cast("bigint").alias("count")))
    return (staged.select(id_col, F.explode(F.array(*counts)).alias("c"))
            .select(id_col, "c.type", "c.count").filter(F.col("count") > 0))


def redaction_log(df: DataFrame, id_col: str, text_col: str,
                  patterns: Sequence[tuple[str, str, str]] = tuple(DEFAULT_PATTERNS),
                  allowlist: Sequence[str] = tuple(DEFAULT_ALLOWLIST)) -> DataFrame:
    """One row per redaction: type, start, end (in the text as left by earlier
    patterns), original length; listed last-to-first within a pattern via ``seq``."""
    allow = _allow_regex(allowlist)
    staged = _staged(df, id_col, text_col, list(patterns), allowlist)
    logs = []
    for i, (name, pat, _rep) in enumerate(patterns):
        t = F.col(f"__s{i}")
        pieces = F.split(t, pat, -1)
        ms = F.regexp_extract_all(t, F.lit(pat), 0)
        lens = F.zip_with(F.slice(pieces, 1, F.size(ms)), ms, lambda p, m: F.struct(F.length(p).cast("bigint").alias("p"), F.length(m).cast("bigint").alias("m"), m.alias("v")))
        # places from running totals of what lies before
        entries = bound(lens, lambda xs: F.zip_with(xs, running_totals(F.transform(xs, lambda x: x["p"] + x["m"])), lambda x, at: F.struct(
            F.lit(name).alias("type"), (at + x["p"]).cast("int").alias("start"), (at + x["p"] + x["m"]).cast("int").alias("end"),
            x["m"].cast("int").alias("original_length"), x["v"].alias("__v"))))
        if allow:
            entries = F.filter(entries, lambda e: ~e["__v"].rlike(allow))
        logs.append(F.transform(F.reverse(entries), lambda e, k: F.struct(
            F.lit(i).alias("pattern_no"), k.alias("seq"), e["type"].alias("type"), e["start"].alias("start"),
            e["end"].alias("end"), e["original_length"].alias("original_length"))))
    return (staged.select(id_col, F.explode_outer(F.flatten(F.array(*logs))).alias("r")).where("r IS NOT NULL")
            .select(id_col, "r.*"))


# TXT-03 -------------------------------------------------------------------------
def chunk_strategy_for(ext: Column) -> Column:
    e = F.lower(ext)
    return (F.when(e.isin(".md", ".markdown"), "markdown_headers").when(e == ".py", "python_functions")
            .when(e == ".json", "json_whole").otherwise("paragraphs"))


#: A document without chunks is one chunk, named so.
WHOLE_STRATEGY = {"markdown_headers": "markdown_whole", "python_functions": "python_whole", "json_whole": "json_whole"}


def chunk_text(df: DataFrame, id_col: str, text_col: str, strategy: str | None = None,
               ext_col: str | None = None, pattern: str | None = None) -> DataFrame:
    """Split each document into chunks with true character offsets, within its row.

    ``strategy`` (or per-row ``ext_col``) selects the split pattern; ``pattern``
    overrides it (e.g. ``\\n`` for line chunks).  Index counts empty pieces;
    blank pieces are dropped; content is stripped; tokens = len(piece) // 4.  A
    document whose pieces are all blank, one without text and a JSON document are
    one chunk, unstripped."""
    if pattern is not None:
        pats, strat = {"custom": pattern}, F.lit("custom")
    elif ext_col is not None:
        pats, strat = CHUNK_PATTERNS, chunk_strategy_for(F.col(ext_col))
    else:
        pats, strat = {k: v for k, v in CHUNK_PATTERNS.items() if k == (strategy or "paragraphs")}, F.lit(strategy or "paragraphs")
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"), strat.alias("strategy"))

    def split_by(pat: str) -> Column:  # (pieces, lengths of the delimiters between them)
        return F.struct(F.split("__t", pat, -1).alias("p"), F.transform(F.regexp_extract_all(F.col("__t"), F.lit(pat), 0), F.length).alias("d"))

    parts = F.lit(None).cast("struct<p:array<string>,d:array<int>>")
    for name, pat in pats.items():
        parts = F.when(F.col("strategy") == name, split_by(pat)).otherwise(parts)
    chunk = "array<struct<chunk_index:int,content:string,start_char:bigint,end_char:bigint,token_count:bigint,strategy:string>>"

    def made(index: Column, content: Column, start: Column, n: Column, strategy: Column) -> Column:
        return F.struct(index.cast("int").alias("chunk_index"), content.alias("content"), start.cast("bigint").alias("start_char"),
                        (start + n).cast("bigint").alias("end_char"), F.floor(n / CHARS_PER_TOKEN).cast("bigint").alias("token_count"), strategy.alias("strategy"))

    def chunks_of(x: Column) -> Column:
        lengths = F.transform(x["p"], lambda p: F.length(p).cast("bigint"))
        starts = running_totals(F.zip_with(lengths, x["d"], lambda n, d: F.coalesce(n, F.lit(0).cast("bigint")) + F.coalesce(d, F.lit(0))))
        # the piece, its start and its number; what is blank goes
        placed = F.transform(F.zip_with(x["p"], starts, lambda p, at: F.struct(p.alias("p"), at.alias("at"), py_strip(p).alias("content"))),
                             lambda y, i: F.struct(i.alias("i"), y["p"].alias("p"), y["at"].alias("at"), y["content"].alias("content")))
        return F.transform(F.filter(placed, lambda y: y["p"].isNotNull() & (F.length(y["content"]) > 0)), lambda y: made(y["i"], y["content"], y["at"], F.length(y["p"]), F.col("strategy")))

    names = F.create_map(*[F.lit(x) for kv in WHOLE_STRATEGY.items() for x in kv])
    whole = F.array(made(F.lit(0), F.col("__t"), F.lit(0), F.length("__t"), F.coalesce(F.try_element_at(names, F.col("strategy")), F.lit("single"))))
    found = base.withColumn("__c", F.coalesce(bound(parts, chunks_of), F.array().cast(chunk)))
    chunks = F.when(F.size("__c") > 0, F.col("__c")).otherwise(whole)
    # an outer explode: an inner one brings a filter on the array's size, which would make all chunks once more
    return found.select("doc_id", F.explode_outer(chunks).alias("c")).select("doc_id", "c.*")


# TXT-04 -------------------------------------------------------------------------
# Folders that name a document's type, the first that the path has.
TYPE_FOLDERS = {".sessions": "session", ".plans": "plan", ".discussions": "discussion", ".adrs": "adr", "specs": "spec", "contracts": "contract"}
DEFAULT_TYPE = "session"
# Ids at the start of a file's name.
FILE_ID = r"(?i)^(ADR-\d{4}|SPEC-\d{4}|DISC-\d{3}|PLAN-\d{3}|SESSION[-_]\d{3})"
_HEADING = r"(?m)(?d)^#\s+(.+)$"


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def document_meta(df: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """content_hash (first 16 hex of SHA-256), n_chars and title; with a path also artifact_id and type.

    Type: by the folders in the path.  Id: a JSON document's ``id``, else the id at
    the start of the file's name, else type and hash of the path.  Title: a JSON
    document's ``title`` or ``name``, else the first ``# `` heading, else (with a path) the
    file's stem, in title case unless the document is JSON."""
    text = F.col(text_col)
    heading = F.nullif(F.trim(F.regexp_extract(text, _HEADING, 1)), F.lit(""))
    cols = [F.col(id_col), short_hash(text).alias("content_hash"), F.length(text).cast("bigint").alias("n_chars")]
    if path_col is None:
        return df.select(*cols, heading.alias("title"))
    path = F.col(path_col)
    lower = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    kind = F.coalesce(*(F.when(F.contains(lower, F.lit(f"{folder}/")), F.lit(name)) for folder, name in TYPE_FOLDERS.items()), F.lit(DEFAULT_TYPE))
    stem = F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    json = F.when(F.lower(path).endswith(".json"), F.try_parse_json(text))
    named = F.nullif(F.regexp_extract(stem, FILE_ID, 1), F.lit(""))

    def member(key: str) -> Column:
        return F.try_variant_get(json, f"$.{key}", "string")

    artifact = F.coalesce(member("id"), F.replace(F.upper(named), F.lit("_"), F.lit("-")), F.concat(kind, F.lit("_"), short_hash(path)))
    fallback = F.when(json.isNotNull(), stem).otherwise(F.initcap(F.regexp_replace(stem, "[-_]", " ")))
    title = F.coalesce(member("title"), member("name"), F.when(json.isNull(), heading), fallback)
    return df.select(*cols, artifact.alias("artifact_id"), title.alias("title"), kind.alias("type"))


# TXT-05 / 06 / 07 -----------------------------------------------------------------
def hash_upsert(old: DataFrame, new: DataFrame, id_col: str, hash_col: str = "content_hash",
                archived_col: str = "archived_at") -> DataFrame:
    """Full outer join old/new snapshots on id: action = inserted / updated /
    unchanged / revived (same hash but archived: re-activated) / kept (only old).
    New rows win; an update or revival clears ``archived_at``."""
    o = old.select(F.col(id_col), F.col(hash_col).alias("__oh"), F.col(archived_col).alias("__oa"))
    j = new.join(o, id_col, "full")
    action = (F.when(F.col("__oh").isNull(), "inserted")
              .when(F.col(hash_col).isNull(), "kept")
              .when(F.col(hash_col) != F.col("__oh"), "updated")
              .when(F.col("__oa").isNotNull(), "revived")
              .otherwise("unchanged"))
    return (j.withColumn("action", action)
            .withColumn(archived_col, F.when(F.col("action") == "kept", F.col("__oa")).otherwise(F.lit(None)))
            .drop("__oh", "__oa"))


def soft_delete(df: DataFrame, ids: DataFrame, id_col: str, ts, archived_col: str = "archived_at") -> DataFrame:
    """Set ``archived_at`` once for the given ids (an existing value is kept)."""
    marked = ids.select(F.col(id_col).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    j = df.join(marked, df[id_col] == marked["__id"], "left")
    return j.withColumn(archived_col, F.when(F.col("__hit") & F.col(archived_col).isNull(), F.lit(ts))
                        .otherwise(F.col(archived_col))).drop("__id", "__hit")


def visible(df: DataFrame, archived_col: str = "archived_at") -> DataFrame:
    return df.filter(F.col(archived_col).isNull())


def rechunk_changed(old_chunks: DataFrame, changed_docs: DataFrame, id_col: str, text_col: str,
                    **chunk_kw) -> DataFrame:
    """Drop the old chunks of changed documents and chunk only those again."""
    keep = old_chunks.join(changed_docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_anti")
    return keep.unionByName(chunk_text(changed_docs, id_col, text_col, **chunk_kw))


# TXT-08 / 09 --------------------------------------------------------------------
def extract_refs(df: DataFrame, id_col: str, text_col: str, patterns: Sequence[str] = tuple(REFERENCE_PATTERNS),
                 json_fields: Sequence[str] = tuple(REFERENCE_JSON_FIELDS)) -> DataFrame:
    """Distinct (source, target, relation) pairs from text ids and JSON fields; no self reference."""
    text = F.col(text_col)
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 0) for p in patterns]))
    parts = [F.transform(found, lambda x: F.struct(x.alias("target"), F.lit("references").alias("relation")))]
    if json_fields:
        doc = F.try_parse_json(text)
        rel = {"implements_adr": "implements", "resulting_specs": "creates"}
        for fld in json_fields:
            arr = F.try_variant_get(doc, f"$.{fld}", "array<variant>")
            ids = F.transform(arr, lambda v: F.coalesce(F.try_variant_get(v, "$.id", "string"),
                                                        F.try_variant_get(v, "$", "string")))
            parts.append(F.transform(F.coalesce(ids, F.array().cast("array<string>")),
                                     lambda x: F.struct(x.alias("target"), F.lit(rel.get(fld, "references")).alias("relation"))))
    allrefs = F.flatten(F.array(*parts))
    return (df.select(F.col(id_col).alias("source"), F.explode(allrefs).alias("r"))
            .select("source", "r.target", "r.relation")
            .filter(F.col("target").isNotNull() & (F.col("target") != F.col("source").cast("string")))
            .distinct())


def keep_existing_targets(edges: DataFrame, nodes: DataFrame, node_col: str) -> DataFrame:
    """TXT-09: keep references whose target exists (left semi join)."""
    return edges.join(nodes.select(F.col(node_col).alias("target")), "target", "left_semi")


# TXT-10 -------------------------------------------------------------------------
def keyword_array(text: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Distinct keywords: lower-cased word tokens fully matching
    ``[a-z][a-z0-9_-]{2,}``, longer than 3, not stop words."""
    # One regex pass: a maximal run of word characters ([\p{L}\p{N}_-]) that is
    # entirely [a-z][a-z0-9_-] and at least 4 long -- the look-arounds pin the
    # match to the run's boundaries, so no per-token filter is needed.
    good = F.regexp_extract_all(F.lower(text), F.lit(KEYWORD_RUN), 0)
    stop = F.array(*[F.lit(s) for s in stop_words])
    return F.array_except(F.array_distinct(good), stop)


KEYWORD_RUN = r"(?<![\p{L}\p{N}_-])[a-z][a-z0-9_-]{3,}(?![\p{L}\p{N}_-])"


def keywords(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col), F.explode(keyword_array(F.col(text_col))).alias("keyword"))

