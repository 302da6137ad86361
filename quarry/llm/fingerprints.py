"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A section ends at a blank line, a paragraph at a line break, a piece after
``PIECE`` characters.  A piece's digest is its MD5; a paragraph's, a section's
and the root are the SHA-256 of their children's digests.  The fingerprint is the
root in hex, a colon, and the pieces' short digests: sections separated by
``|``, paragraphs by ``/``.  Equal roots mean equal texts; the short digests give a
likeness and, branch by branch, the places of edits.  All of it is SQL functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE, SHORT = 32, 6


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))

    def digests(children, short, join):
        return F.struct(F.sha2(F.array_join(children, ""), 256).alias("digest"), F.array_join(short, join).alias("short"))

    def paragraph(p):
        return F.transform(F.array(F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda x: F.md5(x))),
                           lambda d: digests(d, F.transform(d, lambda x: F.left(x, F.lit(SHORT))), ""))[0]

    def inner(children, join):  # ``children``: array of (digest, short)
        return F.transform(F.array(children), lambda c: digests(c["digest"], c["short"], join))[0]

    sections = F.transform(F.split(text, "\n\n", -1), lambda s: inner(F.transform(F.split(s, "\n", -1), paragraph), "/"))
    return F.transform(F.array(inner(sections, "|")), lambda r: F.concat(r["digest"], F.lit(":"), r["short"]))[0]


def root(fp: Column) -> Column:
    return F.left(fp, F.lit(64))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints: 1 if the roots are equal, else twice the shared pieces over all pieces and one."""
    def pieces(fp):
        return F.array_distinct(F.regexp_extract_all(F.substr(fp, F.lit(66)), F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0)))

    both = F.transform(F.array(F.struct(pieces(a).alias("a"), pieces(b).alias("b"))),
                       lambda x: 2.0 * F.size(F.array_intersect(x["a"], x["b"])) / (F.size(x["a"]) + F.size(x["b"]) + 1))[0]
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(both)


def locate_edits(a: Column, b: Column) -> Column:
    """Array of (section, paragraph), from 0, at which two fingerprints' branches differ; only differing sections are opened."""
    def parts(fp, sep):
        return F.split(fp, sep, -1)

    def differing(x, y):  # positions at which two arrays of branches differ
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))

    sa, sb = parts(F.substr(a, F.lit(66)), r"\|"), parts(F.substr(b, F.lit(66)), r"\|")
    found = F.flatten(F.transform(differing(sa, sb), lambda i: F.transform(
        differing(parts(F.coalesce(F.get(sa, i), F.lit("")), "/"), parts(F.coalesce(F.get(sb, i), F.lit("")), "/")),
        lambda j: F.struct(i.alias("section"), j.alias("paragraph")))))
    return F.when(root(a) == root(b), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(found)


def with_next(docs: DataFrame, columns: list[str], order: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """``docs`` and, as next_<column>, the columns of the next row by descending ``order`` (after the last: the first).

    Rows are dealt by range to buckets whose upper ends are ids of the data; the
    row at a bucket's upper end is also sent to the bucket that precedes it in
    the order, so one exchange serves.  A null id counts as the smallest; rows of
    one id follow each other in any order.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(2 ** 63)))
    ends = docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)] + [1.0], 100 * n).alias("q"), F.max(key).alias("m")).first()
    if ends["m"] is None:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    ends = sorted({*ends["q"], ends["m"]})
    array = F.from_json(F.lit(json.dumps(ends)), "array<bigint>")  # folded to one literal
    steps = F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(ends) - 1).alias("hi"))  # the first end that is not below the key

    def halve(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(array, mid) < F.col("__k")
        return F.struct(F.when((s["lo"] < s["hi"]) & below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when((s["lo"] < s["hi"]) & ~below, mid).otherwise(s["hi"]).alias("hi"))

    at = docs.withColumn("__k", key).withColumn("__b", F.aggregate(steps, start, halve, lambda s: s["lo"]))
    at_end = F.get(array, F.col("__b")) == F.col("__k")
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("copy"))
    ahead = F.struct(((F.col("__b") + 1) % len(ends)).alias("b"), F.lit(1).alias("copy"))
    dealt = at.withColumn("__to", F.explode(F.when(at_end, F.array(own, ahead)).otherwise(F.array(own))))
    w = Window.partitionBy("__to.b").orderBy("__to.copy", F.desc("__k"))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("__to.copy = 0").drop("__k", "__b", "__to")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text's fingerprint, that of an edited text, and their likenesses.

    Edited text: the last third (rounded down) of the code points replaced by as
    many first ones, or all, of the next document by descending id.  Per row:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is empty; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(base.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.left(F.col("text"), n - third), F.left(F.col("next_text"), third))})
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    a, b, c = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
