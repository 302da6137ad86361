"""Keyword-set similarity join and link audit (JON-07, TXT-11).

All pairs with Jaccard >= t are found exactly, and no candidate pair is ever a row: at a
threshold like 0.15 nearly every two documents share a frequent token, so candidates written to disk
grow with the square of the documents.

* sets -- a row a document: its tokens as 64-bit hashes (checked to be one to one, else hashed
  anew) and how often each occurs;
* blocks -- each group's sets are cut in blocks of bounded documents and tokens that follow the sets'
  sizes, written once to the shared folder; small groups share blocks;
* cells -- each two blocks of a group whose sizes allow a pair meet in one task at a time, which reads both and
  counts overlaps a bounded stretch at a time: tokens that many documents of both hold are columns of a matrix
  product, the others' hits come from inverted lists.  Only pairs that reach the
  threshold are kept, compared in integers (``overlap*den >= num*union``).

Disk grows with the documents and the pairs found, memory is two blocks a task; time grows with
the pairs of documents whose sizes allow a pair, which cells spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.text import keyword_array
from quarry.session import scratch_path
from quarry.sources.heads import can_open, open_path

# ship this module's mapInArrow code with the task (executors need not have the package)
from pyspark import cloudpickle as _cloudpickle  # noqa: E402
import sys as _sys  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

#: Documents and tokens of a block, and pairs or hits a task holds at a time while it counts.
BLOCK_DOCS, BLOCK_TOKENS, HELD = 4_000, 1_000_000, 2_000_000
#: Numbers a block's frequent tokens take as columns at most; one hit's time in that of a column for one pair.
DENSE, HIT_COST = 8_000_000, 600


def keyword_sets(df: DataFrame, id_col: str, text_col: str, group_col: str | None = None) -> DataFrame:
    """(doc, group, token) with distinct keywords per document."""
    g = F.col(group_col) if group_col else F.lit("")
    return df.select(F.col(id_col).alias("doc"), g.alias("grp"),
                     F.explode(keyword_array(F.col(text_col))).alias("token"))


def token_sets(tokens: DataFrame) -> DataFrame:
    """(doc, n, g, t) in the shared folder: a row a document with its count of tokens, its groups and its tokens as
    hashes (a token of several rows as often).  Different tokens have different hashes."""
    spark, folder = tokens.sparkSession, scratch_path(tokens.sparkSession, "token-sets")
    tokens.where("doc IS NOT NULL AND token IS NOT NULL").select("doc", "grp", "token").write.option("compression", "zstd").parquet(f"{folder}/tokens")
    rows = spark.read.parquet(f"{folder}/tokens")
    for seed in range(10):
        h = F.xxhash64(F.lit(seed), "token")
        if rows.groupBy(h.alias("h")).agg(F.min("token").alias("lo"), F.max("token").alias("hi")).where("lo <> hi").isEmpty():
            break
    else:
        raise ValueError("no seed gives each token a hash of its own")
    sets = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.collect_set("grp").alias("g"), F.collect_list(h).alias("t"))
    sets.write.option("compression", "zstd").parquet(f"{folder}/sets")
    return spark.read.parquet(f"{folder}/sets")


def overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with na, nb and the exact overlap |a ∩ b|; 0 for a document without tokens."""
    side = lambda doc, n, t: sets.select(F.col("doc").alias(doc), F.col("n").alias(n), F.col("t").alias(t))
    once = (F.size(F.array_distinct("ta")) == F.col("na")) & (F.size(F.array_distinct("tb")) == F.col("nb"))
    each = F.aggregate("ta", F.lit(0).cast("bigint"), lambda s, x: s + F.size(F.filter("tb", lambda y: y == x)))
    both = pairs.join(side("a", "na", "ta"), "a", "left").join(side("b", "nb", "tb"), "b", "left")
    overlap = F.when(once, F.size(F.array_intersect("ta", "tb"))).otherwise(each)
    return both.select("a", "b", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("na", "nb")), F.coalesce(overlap, F.lit(0)).cast("bigint").alias("overlap"))


#: Documents of one list that meet in one task at a time.
STRETCH = 2_000


def in_cells(rows: DataFrame, keys: list[str], member: str, stretch: int = STRETCH) -> DataFrame:
    """Rows with the cells (i, j) in which a list's members meet, and each member's own ``stretch``.

    A list (the rows of one key) of more than ``stretch`` members is cut in stretches by a hash; a member goes to
    the cells of its stretch with every other, so each two meet in one cell, which holds two stretches
    at most, however long the list is.  Short lists are one cell."""
    long = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > stretch).select(*keys, F.ceil(F.col("__n") / stretch).cast("int").alias("__parts"))
    cut = rows.join(long, keys, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).withColumn("stretch", F.pmod(F.xxhash64(member), F.col("__parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda k: F.struct(F.least(k, "stretch").alias("i"), F.greatest(k, "stretch").alias("j")))
    return cut.withColumn("__cell", F.explode_outer(cells)).select(*rows.columns, "stretch", "__cell.i", "__cell.j")


def _write_blocks(sets: DataFrame, folder: str, num: int, den: int) -> DataFrame:
    """The sets cut in blocks under ``folder``; the cells: names (x, y) of each two blocks that meet.

    A long group's blocks follow the documents' sizes, so blocks with sizes too far apart for num/den don't meet."""
    rows = sets.select("doc", "n", "t", F.explode("g").alias("grp"))
    # a document fills 1 / BLOCK_DOCS or n / BLOCK_TOKENS of a block, in whole numbers of which FULL is a block
    full, fills = BLOCK_DOCS * BLOCK_TOKENS, F.greatest(F.lit(BLOCK_TOKENS).cast("bigint"), F.col("n") * BLOCK_DOCS)
    sizes = rows.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("docs")).withColumn("fills", fills)
    group, filled = Window.partitionBy("grp"), F.col("docs") * F.col("fills")  # a row a size, not a row a document
    sizes = sizes.withColumns({"before": F.sum(filled).over(group.orderBy("n")) - filled, "all": F.sum(filled).over(group)})
    long = sizes.where(F.col("all") > full).drop("all")
    short = sizes.where(F.col("all") <= full).agg(F.ceil(F.sum(filled) / full).cast("int").alias("k")).first()["k"] or 1
    name = lambda k: F.concat(F.hex(F.xxhash64("grp")), F.lit("-"), k.cast("string"))
    nth = lambda rank: F.floor((F.col("before") + rank * F.col("fills")) / full)
    shared = F.concat(F.lit("short-"), F.pmod(F.xxhash64("grp"), F.lit(short)).cast("string"))
    placed = rows.join(long, ["grp", "n"], "left").withColumn("block", F.when(F.col("docs").isNull(), shared).otherwise(name(nth(F.pmod(F.xxhash64("doc"), "docs")))))
    placed.select("doc", "grp", "n", "t", "block").repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(folder)
    blocks = long.withColumn("k", F.explode(F.sequence(nth(F.lit(0)), nth(F.col("docs") - 1)))).groupBy("grp", "k").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = blocks.select("grp", F.col("k").alias("i"), "most"), blocks.select("grp", F.col("k").alias("j"), "least")
    met = left.join(right, "grp").where((F.col("i") <= F.col("j")) & (F.col("most") * den >= F.col("least") * num)).select(name(F.col("i")).alias("x"), name(F.col("j")).alias("y"))
    return met.unionByName(sets.sparkSession.range(short).select(F.concat(F.lit("short-"), F.col("id").cast("string")).alias("x")).withColumn("y", F.col("x")))


def _order(tokens: np.ndarray) -> np.ndarray:
    """As a stable argsort; faster, as long as hashes differ above the bits that places take."""
    low = np.int64((1 << max(1, len(tokens).bit_length())) - 1)
    order = np.sort((tokens & ~low) | np.arange(len(tokens))) & low
    ranked = tokens[order]
    return order if (ranked[1:] >= ranked[:-1]).all() else np.argsort(tokens, kind="stable")


class _Block:
    """One block read by a task: its documents, their groups and sizes, and who holds each token."""

    def __init__(self, doc: pa.Array, grp: pa.Array, sizes: np.ndarray, tokens: np.ndarray):
        self.doc, self.grp, self.sizes = doc, grp, sizes
        order = _order(tokens)
        ranked = tokens[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[:len(ranked)]
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)  # of each token, document by document
        self.code = np.empty(len(tokens), np.int32)  # the token's place in ``distinct``
        self.code[order] = np.cumsum(new) - 1
        self.distinct, self.begin, self.holder = ranked[new], np.flatnonzero(new), self.owner[order]
        self.count = np.diff(self.begin, append=len(ranked))
        once = np.flatnonzero(new | (np.diff(self.holder, prepend=-1) != 0))
        self.repeats = int(np.diff(once, append=len(ranked)).max(initial=0))  # how often a document holds a token at most

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """How often each document holds each of the tokens ``codes``."""
        place = np.full(len(self.distinct), -1, np.int32)
        place[codes] = np.arange(len(codes), dtype=np.int32)
        column = place[self.code]
        at, out = np.flatnonzero(column >= 0), np.zeros((len(self.sizes), len(codes)), np.float32)
        np.add.at(out.reshape(-1), self.owner[at].astype(np.int64) * len(codes) + column[at], np.float32(1))
        return out


def _read_block(folder: str, block: str) -> _Block | None:
    fs, root = open_path(f"{folder}/block={block}")
    found = sorted(f.path for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet"))
    if not found:
        return None
    rows = pa.concat_tables([pq.read_table(f, filesystem=fs, columns=["doc", "grp", "n", "t"], partitioning=None) for f in found]).combine_chunks()
    return _Block(rows["doc"].combine_chunks(), rows["grp"].combine_chunks(), rows["n"].to_numpy().astype(np.int64), rows["t"].combine_chunks().flatten().to_numpy())


def _meet(left: _Block, right: _Block, same: bool, num: int, den: int) -> Iterator[tuple]:
    """(places left, places right, overlaps) of the pairs of two blocks that reach num/den, a bounded stretch at a time."""
    groups = pa.concat_arrays([left.grp, right.grp]).dictionary_encode().indices.to_numpy()
    ln, rn, width = left.sizes, right.sizes, len(right.sizes)
    lg, rg = groups[:len(ln)], groups[len(ln):]
    at = np.minimum(np.searchsorted(right.distinct, left.distinct), len(right.distinct) - 1)
    lists = np.where(right.distinct[at] == left.distinct, right.count[at], 0)
    # a token with many hits is a column of a matrix product, as long as its sums are exact
    hits = left.count * lists
    dense = np.flatnonzero(hits * HIT_COST > len(ln) * width) if left.repeats * int(rn.max()) < 1 << 24 else np.empty(0, np.int64)
    dense = dense[np.argsort(-hits[dense], kind="stable")[:DENSE // max(len(ln), width)]]
    mine, theirs = left.columns(dense), right.columns(at[dense]).T
    # the others' hits are counted one by one
    lists[dense] = 0
    entry = np.flatnonzero(lists[left.code])
    code, owner = left.code[entry], left.owner[entry].astype(np.int64)
    n, first = lists[code], right.begin[at][code]
    met = np.concatenate([[0], np.cumsum(n)])  # hits before each entry
    starts = np.searchsorted(owner, np.arange(len(ln) + 1))
    enough = lambda sizes: (sizes * (num / (num + den) * (1 - 1e-5))).astype(np.float32)
    la, lb = enough(ln), enough(rn)  # a little less than each side's share of the overlap needed
    stretch = max(1, HELD // width)
    for lo in range(0, len(ln), stretch):
        hi = min(len(ln), lo + stretch)
        counts = mine[lo:hi] @ theirs if len(dense) else np.zeros((hi - lo, width), np.int64)
        for top in range(lo, hi, max(1, stretch // 8)):  # few enough to stay in a core's cache
            rows, p, stop = counts[top - lo:min(hi, top + max(1, stretch // 8)) - lo], starts[top], starts[min(hi, top + max(1, stretch // 8))]
            while p < stop:
                q = min(stop, max(p + 1, int(np.searchsorted(met, met[p] + HELD // 8, "right")) - 1))
                k = n[p:q]
                lists_at = np.arange(met[q] - met[p]) + np.repeat(first[p:q] - (met[p:q] - met[p]), k)
                rows += np.bincount(np.repeat((owner[p:q] - top) * width, k) + right.holder[lists_at], minlength=rows.size).reshape(rows.shape)
                p = q
        a, b = np.divmod(np.flatnonzero(counts >= la[lo:hi, None] + lb), width)
        overlap, a = counts[a, b].astype(np.int64), a + lo
        na, nb = ln[a], rn[b]
        # sizes too far apart tell only where a token has several rows
        keep = (overlap * (num + den) >= (na + nb) * num) & (lg[a] == rg[b]) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & ((b > a) if same else True)
        if keep.any():
            yield a[keep], b[keep], overlap[keep]


def jaccard_pairs(tokens: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Pairs (a < b, same group) with Jaccard(keywords) >= threshold.

    ``tokens`` has columns doc, grp, token (distinct per doc)."""
    return _pairs(token_sets(tokens), threshold)


def _pairs(sets: DataFrame, threshold: float) -> DataFrame:
    t = Fraction(str(threshold)).limit_denominator(10_000)
    if t <= 0:
        raise ValueError("threshold must be > 0 (t = 0 would pair everything)")
    spark, num, den = sets.sparkSession, t.numerator, t.denominator
    folder = scratch_path(spark, "token-blocks")
    if not can_open(folder):
        raise ValueError(f"the similarity join reads its blocks from spark.checkpoint.dir, which tasks cannot open: {folder}")
    cells = _write_blocks(sets, folder, num, den)

    def run(batches: Iterator[pa.RecordBatch]):
        held: tuple = (None, None)
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if held[0] != x:
                    held = x, _read_block(folder, x)
                left = held[1]
                right = left if x == y else _read_block(folder, y)
                if left is None or right is None:
                    continue
                for a, b, overlap in _meet(left, right, x == y, num, den):
                    union = left.sizes[a] + right.sizes[b] - overlap
                    yield pa.RecordBatch.from_arrays([left.doc.take(pa.array(a)), right.doc.take(pa.array(b)), pa.array(overlap), pa.array(union)], names=["l", "r", "overlap", "size"])

    doc = sets.schema["doc"].dataType.simpleString()
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartitionByRange(tasks, "x", "y").sortWithinPartitions("x", "y").mapInArrow(run, f"l {doc}, r {doc}, overlap long, size long")
    # a document of several groups may meet another in each
    return (found.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "overlap", (F.col("overlap") / F.col("size")).alias("jaccard"))
            .where("a <> b").dropDuplicates(["a", "b"]))


def link_audit(tokens: DataFrame, links: DataFrame, suggest_threshold: float = 0.15,
               weak_threshold: float = 0.05) -> DataFrame:
    """Linked pairs: ``questionable`` below ``weak_threshold`` else ``valid``;
    unlinked pairs at or above ``suggest_threshold``: ``missing``.
    ``links`` has columns source, target (document ids)."""
    sets = token_sets(tokens)
    lk = links.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    union = F.col("na") + F.col("nb") - F.col("overlap")
    sim = F.when(union > 0, F.col("overlap") / union).otherwise(F.lit(0.0))
    linked = overlaps(sets, lk).select(F.col("a").alias("source"), F.col("b").alias("target"), sim.alias("similarity")) \
        .withColumn("status", F.when(F.col("similarity") < weak_threshold, "questionable").otherwise("valid"))
    either = lk.unionByName(lk.select(F.col("b").alias("a"), F.col("a").alias("b")))
    missing = (_pairs(sets, suggest_threshold).join(either, ["a", "b"], "left_anti")
               .select(F.col("a").alias("source"), F.col("b").alias("target"),
                       F.col("jaccard").alias("similarity"), F.lit("missing").alias("status")))
    return linked.unionByName(missing)
