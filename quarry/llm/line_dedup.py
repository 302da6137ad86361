"""Line dedup over levelled sorted runs of line hashes.

The store is a list of immutable runs, each a table bucketed and sorted by the
line's 128-bit hash with one row per hash: the documents counted, and the owner
(the document that keeps the line) where the run was the first to see the hash.
A batch of documents is aggregated by hash, merge-joined against every run to
find which of its hashes are new (an anti-join that also keeps the counts of the
others), and added as a run of level 0.  When a level holds ``fan_in`` runs they
are merged into one run of the next level, so a batch meets
``fan_in * log(batches)`` runs at most.  Batches arrive by descending document
id: who sees a line first is the largest id that holds it.

Everything is DataFrame operations.  A line that most documents share is
counted map-side; texts move once, to meet the positions to drop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, ascii_lower, shared_folder, write_table

MIN_CHARS, MIN_DOCS, BATCHES, FAN_IN = 40, 5, 4, 3


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: stripped of white space at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


class LineRuns:
    """The levelled runs: h1, h2, n_docs, owner (null where an older run has the owner)."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.folder = shared_folder(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_in:  # compaction
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            self._forget(old)

    def _forget(self, names: list[str]) -> None:
        for name in names:  # from the catalog; the files stay for jobs that still read them
            self.spark.sql(f"DROP TABLE {name}")

    def _merged(self, names: list[str]) -> DataFrame:
        # read as plain files: a union of bucketed scans claims a partitioning by hash that it does not have
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*(f"{self.folder}/{name}" for name in names))
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def add(self, batch: DataFrame) -> None:
        """Add one batch of (h1, h2, n_docs, owner), a row for each hash."""
        new = F.lit(True)
        for k, name in enumerate(name for level in self.levels for name in level):
            owned = self.spark.table(name).where("owner IS NOT NULL").select("h1", "h2", F.lit(True).alias(f"run{k}"))
            batch = batch.join(owned.hint("merge"), ["h1", "h2"], "left")
            new = new & F.col(f"run{k}").isNull()
        self._write(batch.select("h1", "h2", "n_docs", F.when(new, F.col("owner")).alias("owner")), 0)

    def totals(self) -> DataFrame:
        """h1, h2, n_docs, owner over all runs."""
        return write_table(self._merged([name for level in self.levels for name in level]), "line-totals")

    def close(self) -> None:
        """The runs leave the catalog, also those of a job that failed."""
        self._forget([name for level in self.levels for name in level])
        self.levels = []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text.

    Lines whose key has at least ``min_chars`` code points and occurs in at least
    ``min_docs`` documents (distinct ids) stay only in the largest id that holds
    it, with all their repetitions there; other lines stay, joined by newlines.
    A null or empty text is one empty line (kept_text is then empty).  Rows with
    a null id are neither counted nor changed.  Repeated rows share one id and
    one fate.  Other columns are passed on; columns named n_lines, n_dropped,
    kept_text are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*({"n_lines", "n_dropped", "kept_text", "__t", "__drop"} & set(docs.columns)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the text's hash is taken before its lines are rows: else each of them would carry the whole text
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), line_keys(text).alias("keys")).select("doc_id", "t", F.posexplode("keys").alias("pos", "key"))
    lines = lines.where(F.char_length("key") >= min_chars).select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    bounds = docs.agg(F.percentile_approx(id_col, [k / batches for k in range(1, batches)], 10_000).alias("q")).first()["q"] if batches > 1 else None
    batch = sum((F.col("doc_id") <= F.lit(b)).cast("int") for b in sorted(set(bounds))) if bounds else F.lit(0)  # 0 holds the largest ids
    lines = write_table(lines.withColumn("batch", batch), "lines")

    runs = LineRuns(spark, fan_in)
    try:
        for k in range(len(set(bounds or ())) + 1):
            once = lines.where(F.col("batch") == k).groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("c"))
            runs.add(once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner")))
        totals = runs.totals()
    finally:
        runs.close()
    often = totals.where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner")
    drop = lines.join(often, ["h1", "h2"]).where("doc_id <> owner").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("__drop"))

    joined = docs.withColumn("__t", F.xxhash64(text)).join(
        drop.withColumnsRenamed({"doc_id": "__id", "t": "__h"}), (F.col(id_col) == F.col("__id")) & (F.col("__t") == F.col("__h")), "left")
    split = F.split(text, "\n", -1)
    # text and places are bound once, as a lambda's variable: what a lambda encloses is evaluated for each element
    kept = F.get(F.transform(F.array(F.struct(split.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__drop")).alias("stay"))),
                             lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n")), 0)
    return joined.select(
        *docs.columns, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__drop").isNull(), text).otherwise(kept).alias("kept_text"))
