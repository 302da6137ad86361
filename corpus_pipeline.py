"""A training corpus from raw documents, in five stages of the ``llm`` operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.  Rows of a null text pass as empty ones; an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_broadcast, write_table
from quarry.llm.jaccard import jaccard_groups, with_class
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.mixing import in_order, mix
from quarry.llm.packing import pack_documents
from quarry.llm.quality import keep_good, train
from quarry.llm.queries import MIX_REST, MIX_WEIGHTS, table, word_tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, learned from all of ``labels``: documents that it rejects go; the rest stay as they are."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines of 40 characters or more that five documents hold stay in the largest id; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 on five-word shingles at 0.8: of each group of linked texts one row stays, of the smallest id.

    A row goes by its own text, whatever other rows of its id hold.  Rows of a null id and texts
    without words link with nothing and stay."""
    found = write_table(jaccard_groups(docs, words=5, num=80, den=100), "near")
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("lowest") < F.col("doc_id")).alias("gone"))
    kept = docs.join(bounded_broadcast(ids.where("n = 1 AND gone").select("doc_id")), "doc_id", "left_anti")
    several = write_table(ids.where("n > 1").select("doc_id"), "several")
    if several.isEmpty():
        return kept.select(*docs.columns)
    # ids of several rows: each row by its text's class
    several = bounded_broadcast(several)
    rows = with_class(docs.join(several, "doc_id", "left_semi").withColumnsRenamed({"class": "__own_class"}), words=5)
    groups = found.where("group IS NOT NULL").select(F.col("class").alias("__class"), "group", F.col("lowest")).distinct()
    rows = rows.join(groups, F.col("class") == F.col("__class"), "left").where("group IS NULL OR lowest = doc_id")
    first = rows.where("group IS NOT NULL").dropDuplicates(["group"]).unionByName(rows.where("group IS NULL"))
    once = first.drop("class", "__class", "group", "lowest").withColumnsRenamed({"__own_class": "class"})
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: all documents, written in the order of the mixture (each file a stretch of it)."""
    return in_order(mix(docs, MIX_WEIGHTS, MIX_REST, ties=("text",))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of all documents, each with its sequence and place there.

    The mixture's positions, computed again from ids and sources, say which of the
    pieces of one length comes first, and in which order sequences are numbered."""
    mixed = mix(docs.select("doc_id", "text", "source"), MIX_WEIGHTS, MIX_REST, ties=("text",))
    return pack_documents(mixed, word_tokenizer(), position_col="position").drop("position")


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``: the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
