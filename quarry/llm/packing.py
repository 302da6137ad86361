"""Best-fit packing of token sequences by linear grouping.

Only a histogram of piece lengths (at most ``capacity`` rows) reaches the
driver; documents of one length are interchangeable there.  The plan:

1. lengths above ``capacity * large`` are dealt, longest first, into ``groups``
   groups of equal cardinality and rounded up to the longest of their group;
2. the few rounded sizes are packed by a configuration linear program (column
   generation, priced by a knapsack table) and its whole parts are used;
3. actual lengths take the slots of the configurations; what rounding left
   free, and the bins of step 2's fractional rest, take the other lengths,
   longest first, by best fit; new bins are opened only when nothing fits.

Bins with equal content are kept as one run, so the plan has a size bounded by
the capacity whatever the number of documents.  Tasks then map the rank of a
piece within its length to its place by binary search in the plan.  Ranks come
from hashed buckets, so a length that most documents share is split.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import worker_state, write_table

CAPACITY, END_ID = 4096, 1
RANK_BUCKETS = 256
#: Text whose lower case, normal form and split are plain: visible ASCII, blanks and Latin-1 letters.
_PLAIN = re.compile(r"[ \t\n\r!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: The tokenizer's own split of such text.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t\n\ra-z0-9\xdf-\xf6\xf8-\xff]+")
_BLANK = str.maketrans("\t\n\r", "   ")
_CACHE_PARTS, _CACHE_WORDS, _CACHE_LEN = 250_000, 50_000, 40


# ---------------------------------------------------------------- token ids
def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 character where that is visible, others as the characters from 256 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(visible)))}


class WordTokenizer:
    """Ids of a tokenizer that drops white space, with a bounded cache by word.

    Plain texts are split here as the tokenizer splits them, and only unseen
    parts go to its model.  Such a tokenizer treats blank-separated words on
    their own, so other texts go word by word; words that are not plain, or
    could hold a special token, take the whole tokenizer.  The caches keep what came first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.byte = _byte_characters()

    def part(self, p: str) -> bytes:
        chars = p if p.isascii() else "".join([self.byte[b] for b in p.encode()])
        ids = array("I", [t.id for t in self.tok.model.tokenize(chars)]).tobytes()
        if len(p) <= _CACHE_LEN and len(self.parts) < _CACHE_PARTS:
            self.parts[p] = ids
        return ids

    def plain(self, text: str) -> bytes:
        get, part = self.parts.get, self.part
        return b"".join([ids if (ids := get(p)) is not None else part(p) for p in _PARTS.findall(text.lower())])

    def word(self, w: str) -> bytes:
        if "<|" not in w and _PLAIN.fullmatch(w):
            return self.plain(w)
        ids = np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(w) <= _CACHE_LEN and len(self.words) < _CACHE_WORDS:
            self.words[w] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if "<|" not in text and _PLAIN.fullmatch(text):
            return self.plain(text)
        get, word = self.words.get, self.word
        return b"".join([ids if (ids := get(w)) is not None else word(w) for w in text.translate(_BLANK).split(" ") if w])


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", position_col: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids (binary, little-endian uint32).

    Every whole text, its ids followed by one end id; a null text is empty (one
    piece, the end id alone).  Repeated rows give repeated pieces; a null id
    stays null; ``position_col`` is passed on as position, other columns are not read.  The tokenizer file is read by each worker from ``tokenizer_path``.
    """
    end = np.array([END_ID], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), *([("position", pa.int64())] if position_col else [])])

    def run(batches: Iterator[pa.RecordBatch]):
        tok = worker_state(f"tokenizer {tokenizer_path}", lambda: WordTokenizer(tokenizer_path))
        size = 4 * capacity
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part, rows = b.slice(lo, 1000), []
                for doc_id, text, *position in zip(*(c.to_pylist() for c in part.columns)):
                    ids = tok.ids(text or "") + end
                    for k in range(0, len(ids), size):
                        cut = ids[k:k + size]
                        rows.append((doc_id, k // size, k // 4, len(cut) // 4, cut, *position))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    position = [docs[position_col].cast("long").alias("position")] if position_col else []
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *position).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary" + ", position long" * len(position))


# ---------------------------------------------------------------- the plan
def _configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, unit: int = 8, rounds: int = 400):
    """Whole parts of the configuration LP: [(bins, slots by size)]; Gilmore-Gomory column generation."""
    k = len(sizes)
    w = -(-sizes // unit)
    cap = capacity // unit
    basis = np.diag(np.maximum(1, cap // w)).astype(float)  # columns are configurations
    inv = np.linalg.inv(basis)
    x = inv @ need
    for _ in range(rounds):
        y = inv.sum(axis=0)  # duals: every configuration costs one bin
        best, take = np.zeros(cap + 1), np.full(cap + 1, -1)
        for c in range(int(w.min()), cap + 1):
            v = np.where(w <= c, best[np.maximum(0, c - w)] + y, -1.0)
            j = int(v.argmax())
            if v[j] > best[c - 1] + 1e-12:
                best[c], take[c] = v[j], j
            else:
                best[c] = best[c - 1]
        if best[cap] <= 1 + 1e-7:
            break
        col, c = np.zeros(k), cap
        while c > 0:
            if take[c] < 0 or best[c] == best[c - 1]:
                c -= 1
                continue
            col[take[c]] += 1
            c -= int(w[take[c]])
        d = inv @ col
        ratio = np.where(d > 1e-9, x / np.maximum(d, 1e-9), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = col
        inv = np.linalg.inv(basis)
        x = np.maximum(inv @ need, 0)
    return [(int(np.floor(x[j] + 1e-6)), basis[:, j].astype(int)) for j in range(k)]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, large: float = 0.3):
    """Rows (length, rank, bins, each, sequence, offset), by length and rank, and the number of sequences.

    A row places pieces ``rank .. rank + bins * each - 1`` of ``length``: the
    r-th of them goes to sequence ``sequence + r // each`` at ``offset + r % each * length``.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be within 1..capacity")
    ranks = dict.fromkeys(left, 0)
    # a run: [bins, free, [(length, first rank, each, offset)]]; runs by free space
    runs: dict[int, list] = {}
    frees: list[int] = []

    def put(run):
        if run[0]:
            if run[1] not in runs:
                runs[run[1]] = []
                bisect.insort(frees, run[1])
            runs[run[1]].append(run)

    def fill(run, n, each, bins):
        """The first ``bins`` bins of a run, with ``each`` pieces of length n more; the rest of the run."""
        head = [bins, run[1] - each * n, run[2] + [(n, ranks[n], each, capacity - run[1])]]
        rest = [run[0] - bins, run[1], [(m, r + bins * e, e, o) for m, r, e, o in run[2]]]
        ranks[n] += bins * each
        left[n] -= bins * each
        return head, rest

    big = sorted((n for n in left if n > capacity * large), reverse=True)
    total = sum(left[n] for n in big)
    if total:
        # linear grouping: equal cardinality, rounded up to the group's longest
        group, seen, share = [], 0, -(-total // min(groups, total))
        for n in big:
            c = left[n]
            while c:
                g = seen // share
                if g == len(group):
                    group.append([])
                t = min(c, (g + 1) * share - seen)
                group[g].append([n, t])
                seen += t
                c -= t
        sizes = np.array([g[0][0] for g in group])
        need = np.array([float(sum(t for _, t in g)) for g in group])
        keep, index = np.unique(sizes, return_inverse=True)  # groups of one size are one
        merged = [[] for _ in keep]
        for g, i in zip(group, index):
            merged[i] += g
        need = np.bincount(index, weights=need)
        for bins, slots in _configurations(keep, need, capacity):
            order = [i for i in np.argsort(-keep) for _ in range(slots[i])]
            while bins:
                # as many bins at a time as every slot can fill with one actual length
                want: dict[int, int] = {}
                chosen = []
                for i in order:
                    chosen.append(next((m for m in merged[i] if m[1] > want.get(id(m), 0)), None))
                    if chosen[-1] is not None:
                        want[id(chosen[-1])] = want.get(id(chosen[-1]), 0) + 1
                chosen = [m for m in chosen if m is not None]
                if not chosen:
                    break
                now = min([bins, *(m[1] // want[id(m)] for m in chosen)])
                run = [now, capacity, []]
                for m in chosen:
                    run, _ = fill(run, m[0], 1, now)
                    m[1] -= now
                put(run)
                bins -= now
    # best fit, longest first
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect.bisect_left(frees, n)
            if at == len(frees):
                put([-(-left[n] // (capacity // n)), capacity, []])
                continue
            free = frees[at]
            run = runs[free].pop()
            if not runs[free]:
                del runs[free]
                frees.pop(at)
            each = min(free // n, left[n])
            head, rest = fill(run, n, each, min(run[0], left[n] // each))
            put(head)
            put(rest)
    rows, sequence = [], 0
    for free in frees:
        for bins, _, content in runs[free]:
            rows += [(n, r, bins, e, sequence, o) for n, r, e, o in content]
            sequence += bins
    return sorted(rows), sequence


# ---------------------------------------------------------------- the operator
def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = 64, order: tuple[str, ...] = ("doc_id", "piece"), buckets: int = RANK_BUCKETS,
         position_col: str | None = None) -> DataFrame:
    """``pieces`` (with a ``length`` of 1..capacity) and for each its sequence_id and offset.

    Gapless: a sequence's pieces follow each other from 0.  All other columns
    are passed on.  Pieces that tie on ``order`` take places of their length in
    any order.  With ``position_col`` (0, 1, ... over the documents) the pieces of a length
    take their places in that order, and sequences are numbered by their first piece
    in it.  An empty table packs into nothing.  ``pieces`` is read three times, and once
    more with positions: pass a written table.
    """
    clash = {"sequence_id", "offset", "__b", "__rank", "__before", "__c"} & set(pieces.columns)
    pieces = pieces.drop(*clash)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan_bins(histogram, capacity, groups)
    plan = np.array(rows, np.int64).reshape(-1, 6)
    keys = (plan[:, 0] << 40) + plan[:, 1]

    if position_col:  # buckets are stretches of positions, so ranks follow them
        order = (position_col, *(c for c in order if c != position_col))
        last = pieces.agg(F.max(position_col)).first()[0] or 0
        stretch = F.floor(F.col(position_col) / (last // buckets + 1))
    bucketed = pieces.withColumn("__b", stretch if position_col else F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = bucketed.groupBy("length", "__b").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    ranked = bucketed.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__b").orderBy(*order))).join(before, ["length", "__b"]).withColumn(
        "__rank", F.col("__before") + F.col("__rank") - 1).select(*pieces.columns, F.col("__rank").cast("long").alias("__rank"))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(keys, (n << 40) + rank, side="right") - 1
            _, first, _, each, sequence, offset = (plan[at, j] for j in range(6))
            r = rank - first
            kept = b.select([c for c in b.schema.names if c != "__rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence + r // each), pa.array(offset + r % each * n)], names=[*kept.schema.names, "sequence_id", "offset"])

    packed = ranked.mapInArrow(run, out)
    if not position_col:
        return packed
    packed = write_table(packed, "packed")
    first = packed.groupBy("sequence_id").agg(F.min(F.struct(*order)).alias("__first")).withColumn("__b", F.floor(F.col(f"__first.{position_col}") / (last // buckets + 1)))
    first = write_table(first, "sequences")  # a row a sequence
    before = first.groupBy("__b").agg(F.count("*").alias("__c")).withColumn("__before", F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).drop("__c")  # ``buckets`` rows at most
    number = first.join(before, "__b").select("sequence_id", (F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__first", "sequence_id")) - 1).cast("long").alias("__rank"))
    return packed.join(number, "sequence_id").withColumn("sequence_id", F.col("__rank")).select(*out.names)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = 64, keep_ids: bool = False, position_col: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32 (and ids, if kept), position (if given), sequence_id, offset."""
    pieces = tokenize_pieces(docs, tokenizer_path, capacity, position_col=position_col).withColumn("ids_crc32", F.crc32("ids"))
    pieces = write_table(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return pack(pieces, capacity, groups, ("doc_id", "piece", "ids_crc32"), position_col="position" if position_col else None)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``pack_documents(keep_ids=True)``: sequence_id, length, ids.  A sequence is at most ``capacity`` pieces."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", "length", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
