"""Packing along a space-filling curve.

Documents are ordered so that like texts are neighbours, and the one stream of
their tokens is cut into sequences:

1. a document's token ids are hashed into ``BUCKETS`` counts, their square roots
   are projected on ``DIMS`` fixed random directions, and the unit vector's place in
   that small cube becomes its Hilbert key;
2. rows are range-sorted by (key, doc_id, row), so a group of copies with one key is split;
3. each range adds up its own tokens; the totals of the ranges (one number a
   partition) give every row its place in the stream;
4. the stream is cut every ``capacity`` tokens.  What is left at its end is cut
   into sequences whose lengths are powers of two, which need no padding.

Ids travel in two bytes each where the vocabulary allows it.
Rows hold at most ``CHUNK`` tokens, so a very long document is several rows that
follow each other; a piece ends where such a row ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import buckets_for, worker_state, write_table
from quarry.llm.packing import WordTokenizer

CAPACITY, END_ID = 4096, 2
CHUNK = 16_384
BUCKETS, DIMS, BITS = 1024, 4, 15


# ---------------------------------------------------------------- the curve
def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of grid cells (n x dims, each 0 .. 2**bits - 1), as int64.

    Gray-code form of the curve: undo the rotations of every level, from the coarsest
    on, then interleave the bits.  ``dims * bits`` is at most 62."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            inside = (x[i] & top) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _directions() -> np.ndarray:
    return np.random.default_rng(0).standard_normal((BUCKETS, DIMS))


def document_keys(ids: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """Hilbert key of each token array; an array without tokens lies in the middle of the cube."""
    n = len(ids)
    sizes = np.array([len(a) for a in ids])
    flat = np.concatenate(ids).astype(np.uint64) if n else np.zeros(0, np.uint64)
    bucket = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)  # the product's top ten bits
    counts = np.bincount(np.repeat(np.arange(n) * BUCKETS, sizes) + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    v = np.sqrt(counts) @ directions
    v /= np.sqrt(np.maximum(sizes, 1))[:, None]  # the roots' norm is the root of the size
    cells = np.clip((v + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64), BITS)


# ---------------------------------------------------------------- the stream
def id_type(tokenizer_path: str) -> str:
    """The narrowest type that holds all ids of a vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize_on_curve(docs: DataFrame, tokenizer_path: str, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of at most ``CHUNK`` tokens: key, doc_id, row (number of the input row), start, doc_tokens, ids (of type ``kind``)."""
    width = int(kind[-1])
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        tok = worker_state(f"tokenizer {tokenizer_path}", lambda: WordTokenizer(tokenizer_path))
        directions = worker_state("tokenizer directions", _directions)
        end, row = np.array([END_ID], kind).tobytes(), TaskContext.get().partitionId() << 33
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                doc_ids, texts = (c.to_pylist() for c in b.slice(lo, 100).columns)
                ids = [np.frombuffer(tok.ids(t or ""), "<u4") for t in texts]
                rows = []
                for doc_id, i, key in zip(doc_ids, ids, document_keys(ids, directions)):
                    n, i = len(i) + 1, i.astype(kind).tobytes() + end
                    rows += [(key, doc_id, row, k, n, i[width * k:width * (k + CHUNK)]) for k in range(0, n, CHUNK)]
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, "key long, doc_id long, row long, start long, doc_tokens long, ids binary")


def in_stream(rows: DataFrame, kind: str) -> tuple[DataFrame, int]:
    """``rows`` (of :func:`tokenize_on_curve`, written) range-sorted, each with its ``place`` in the one stream, and the stream's length."""
    order, width = ("key", "doc_id", "row", "start"), int(kind[-1])
    ranged = rows.repartitionByRange(buckets_for(rows), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.array([len(i) // width for i in b.column("ids").to_pylist()], np.int64)
            place = seen + np.cumsum(n) - n
            seen += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(place)],
                                             names=[*b.schema.names, "length", "part", "place"])

    placed = write_table(ranged.drop("row").mapInArrow(run, "key long, doc_id long, start long, doc_tokens long, ids binary, length long, part int, place long"), "curve", "zstd")
    totals = dict(placed.groupBy("part").agg(F.sum("length")).collect())  # a number a partition
    starts = dict(zip(sorted(totals), accumulate([0, *(totals[p] for p in sorted(totals))])))
    if not starts:
        return placed.drop("part"), 0
    known = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)])
    return placed.withColumn("place", F.col("place") + known[F.col("part")]).drop("part"), sum(totals.values())


def tail_lengths(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def cut_stream(stream: DataFrame, total: int, kind: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of a stream of ``total`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as uint32, if kept)."""
    full = total // capacity
    tail = list(accumulate([full * capacity, *tail_lengths(total % capacity)]))  # where the last sequences begin and end
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = []
                for doc_id, start, doc_tokens, ids, place in zip(*(c.to_pylist() for c in b.slice(lo, 500).columns)):
                    ids = np.frombuffer(ids, kind).astype("<u4").tobytes()
                    at, last = place, place + len(ids) // 4
                    while at < last:
                        if at < tail[0]:
                            sequence = at // capacity
                            first, stop = sequence * capacity, (sequence + 1) * capacity
                        else:
                            k = next(k for k, t in enumerate(tail[1:]) if at < t)
                            sequence, first, stop = full + k, tail[k], tail[k + 1]
                        stop = min(stop, last)
                        cut = ids[4 * (at - place):4 * (stop - place)]
                        rows.append((doc_id, start + at - place, stop - at, zlib.crc32(cut), doc_tokens, sequence, at - first, *[cut] * keep_ids))
                        at = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return stream.select("doc_id", "start", "doc_tokens", "ids", "place").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids)


def pack_on_curve(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every token of every document in one piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if kept).

    A null or empty text is its end id alone.  Repeated rows give their pieces each;
    a null id stays null.  Ties of the key go by doc_id, then in the order of the
    input's rows.  Other columns are not read.  An empty table packs into nothing."""
    kind = id_type(tokenizer_path)
    rows = write_table(tokenize_on_curve(docs, tokenizer_path, kind, id_col, text_col), "curve-rows", "zstd")
    stream, total = in_stream(rows, kind)
    return cut_stream(stream, total, kind, capacity, keep_ids)
