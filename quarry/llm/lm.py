"""Interpolated modified Kneser-Ney language model, counted in Spark and scored
from sorted hash arrays that workers map into memory.

Two jobs.  The first counts words; a bucket of word hashes ranks its words by count and
writes them as a sorted hash array, so a word's number is small where it is frequent.  The
second counts n-grams as columns of these numbers: tasks add them up over bounded chunks,
sort them, and send what remains as differences, compressed by byte planes (some three bytes
a trigram).  Packets travel to buckets of the n-gram's 64-bit hash.  A bucket's task merges them, writes
its part of the level's store and sends on what the level below needs: for each distinct
n-gram its suffix (whose continuation count it is), for each context the counts that make
up its total and its interpolation weight.  The hash of a whole n-gram spreads a very
frequent word or context over all buckets.

Store: one file a level and bucket in the shared folder, written under another name
and renamed, so a repeated task replaces its own file.  It holds the keys sorted
by (prefix, low 32 bits) with a table of where each prefix begins, and four bits for
each count, larger counts aside.  Nothing is pruned, so the store grows with the
corpus; a lookup takes a binary search among the few keys of a prefix.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import buckets_for, mounted, shared_folder, worker_state

CHUNK_TOKENS = 2_000_000
GROUP_CHARS = 2_000_000
U = np.uint64
#: Fields of a store: the level's count; as a context how many successors have count 1, 2, 3 or more, and what the total is above n1 + 2 n2 + 3 n3.
FIELDS = ("c", "n1", "n2", "n3", "more")
#: The vocabulary's number of a text's begin.
BEGIN = 0
#: Unseen words are numbered by their hash from here on.
UNSEEN = 1 << 62


# ---------------------------------------------------------------- hashes
def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U(0x9E3779B97F4A7C15) ^ (b + U(0x632BE59BD9B4E019)) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def store_key(level: int, gram: np.ndarray) -> np.ndarray:
    return mix(gram, np.zeros(1, U)) if level == 1 else gram


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets)) >> U(32)


WORD_BITS = 48
_CACHE_WORDS = 200_000


class WordHashes(dict):
    """48-bit hashes of words; keeps the first ones seen."""

    def __missing__(self, w):
        h = xxhash.xxh64_intdigest(w) & ((1 << WORD_BITS) - 1)
        if len(self) < _CACHE_WORDS:
            self[w] = h
        return h


_POWER = U(0xD1342543DE82EF95)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words in order, A-Z lower-cased, and each text's number of words.

    White space is ASCII, so words are runs of bytes of UTF-8: a polynomial over a word's bytes, mixed with its length."""
    blobs = [t.encode() if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    space = (data == 32) | (data - np.uint8(9) <= 4)
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    stops = np.cumsum([len(b) + 1 for b in blobs])
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    if not len(starts):
        return np.zeros(0, U), counts
    sizes = ends - starts
    chars = data[~space]
    chars = chars + ((chars - np.uint8(65) <= 25) * np.uint8(32))
    first = np.cumsum(sizes) - sizes
    powers = np.full(int(sizes.max()), _POWER, U)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=U)
    place = np.arange(len(chars)) - np.repeat(first, sizes)
    return mix(np.add.reduceat((chars.astype(U) + U(1)) * powers[place], first), sizes.astype(U)), counts


#: The hash of a text's end: no word has length 0.
END = mix(np.zeros(1, U), np.zeros(1, U))


def in_groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of ``GROUP_CHARS`` characters or one more text together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "") + 10
        if size > GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def numbered(texts: list[str | None], order: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and training counts (0 for begins) of the distinct tokens; all texts' tokens as places among these, each text after
    ``order - 1`` begins and closed by an end; the texts' numbers of tokens (with the end)."""
    hashes, sizes = word_hashes(texts)
    sizes = sizes + 1
    number, count, place = vocabulary.find(np.concatenate([END, hashes]))
    # a text: begins, words, the end
    codes = np.zeros(int(sizes.sum()) + len(texts) * (order - 1), np.int64)
    ends = np.cumsum(sizes + order - 1) - 1
    words = np.ones(len(codes), bool)
    words[ends] = False
    for j in range(order - 1):
        words[ends - sizes - j] = False
    codes[words] = place[1:] + 1
    codes[ends] = place[0] + 1
    return np.concatenate([np.array([BEGIN], U), number]), np.concatenate([[0.0], count]), codes, sizes


def endings(tokens: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The predicted tokens' places, and for k = 1 ... order the hash of the k-gram that ends at each place of ``tokens``."""
    predicted = np.ones(len(tokens), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]]).astype(np.int64)
    for j in range(order - 1):
        predicted[starts + j] = False
    out = [tokens]
    for _ in range(order - 1):
        out.append(np.concatenate([out[-1][:1], mix(out[-1][:-1], tokens[1:])]))
    return np.flatnonzero(predicted), out


def grams(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each predicted token: columns of the numbers of the words before it, and its own."""
    predicted = np.ones(len(tokens), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]]).astype(np.int64)
    for j in range(order - 1):
        predicted[starts + j] = False
    at = np.flatnonzero(predicted)
    return [tokens[at - j] for j in range(order - 1, -1, -1)]


def gram_of(cols: list[np.ndarray]) -> np.ndarray:
    out = cols[0]
    for c in cols[1:]:
        out = mix(out, c)
    return out


# ---------------------------------------------------------------- packed columns
def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's rank among the distinct ones, and these in order."""
    codes, distinct = pd.factorize(values)
    order = np.argsort(distinct)
    rank = np.empty(len(order), U)
    rank[order] = np.arange(len(order), dtype=U)
    return rank[codes], distinct[order]


def _order(cols: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns: by as many bits as 64 hold, then what ties by the rest of the last column."""
    bits = [int(c.max()).bit_length() for c in cols]
    cut = max(0, sum(bits) - 64)
    if cut > bits[-1]:
        return np.lexsort(cols[::-1])
    key = np.zeros(len(cols[0]), U)
    for c, n in zip(cols[:-1], bits[:-1]):
        key = (key << U(n)) | c
    key = (key << U(bits[-1] - cut)) | (cols[-1] >> U(cut))
    order = np.argsort(key)
    if cut:
        sorted_ = key[order]
        tie = np.zeros(len(key) + 1, bool)
        tie[1:-1] = sorted_[1:] == sorted_[:-1]
        at = np.flatnonzero(tie[1:] | tie[:-1])
        rows = order[at]
        order[at] = rows[np.lexsort((cols[-1][rows], sorted_[at]))]
    return order


def _begins(cols: list[np.ndarray]) -> np.ndarray:
    """Places at which rows (sorted by the columns) differ from the one before."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(cols: list[np.ndarray], add: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One row for each distinct row of ``cols``, in order; ``add`` summed."""
    if not len(cols[0]):
        return cols, add
    order = _order(cols)
    cols = [c[order] for c in cols]
    first = _begins(cols)
    return [c[first] for c in cols], [np.add.reduceat(c[order], first) for c in add]


def _pack(cols: list[np.ndarray], add: list[np.ndarray]) -> bytes:
    """Sorted columns as differences to the row before where all columns before agree, in byte planes, compressed."""
    out, same = [], np.ones(len(cols[0]) - 1, bool)
    for c in cols:
        d = c.copy()
        d[1:] = np.where(same, c[1:] - c[:-1], c[1:])
        same &= c[1:] == c[:-1]
        out.append(d)
    out += add
    widths = [max(1, (int(c.max()).bit_length() + 7) // 8) for c in out]
    planes = [np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(out, widths)]
    return bytes(widths) + zstandard.compress(b"".join(planes), 1)


def _unpack(blob: bytes, n: int, columns: int, more: int) -> list[np.ndarray]:
    k = columns + more
    data, out, at = zstandard.decompress(blob[k:]), [], 0
    for w in blob[:k]:
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T
        out.append(full.reshape(-1).view("<u8"))
        at += n * w
    new = np.zeros(n, bool)
    new[:1] = True
    for j in range(columns):
        d = out[j]
        total, first = np.cumsum(d, dtype=U), np.flatnonzero(new)
        out[j] = total - np.repeat(total[first] - d[first], np.diff(np.append(first, n)))
        new[1:] |= out[j][1:] != out[j][:-1]
    return out


_PACKED = pa.schema([("bucket", pa.int32()), ("context", pa.bool_()), ("n", pa.int64()), ("blob", pa.binary())])
_PACKED_DDL = "bucket int, context boolean, n long, blob binary"


def _send(level: int, cols: list[np.ndarray], add: list[np.ndarray], context: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows by the bucket of their gram at ``level`` (0: words by hash)."""
    to = bucket_of(store_key(level, gram_of(cols)) if level else cols[0], buckets).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        i = order[ends[b]:ends[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([context]), pa.array([len(i)], pa.int64()), pa.array([_pack([c[i] for c in cols], [c[i] for c in add])], pa.binary())], schema=_PACKED)


# ---------------------------------------------------------------- the store
def _write_store(path: str, key: np.ndarray, fields: list[np.ndarray], header: list[int], buckets: int, wide: list[np.ndarray] = ()) -> None:
    """``fields`` of a key stand together, in four bits each (15: the value stands aside), a single one in eight (255); ``wide`` ones take eight bytes."""
    n = len(key)
    bits = max(0, int(n).bit_length() - 3)
    prefix = (((key >> U(32)) * U(buckets)) & U(0xFFFFFFFF)) >> U(32 - bits) if bits else np.zeros(n, U)
    order = np.argsort((prefix << U(32)) | (key & U(0xFFFFFFFF)))
    starts = np.searchsorted(prefix[order], np.arange((1 << bits) + 1, dtype=U)).astype("<u4")
    low = (key[order] & U(0xFFFFFFFF)).astype("<u4")
    fields = [f[order] for f in fields]
    most = 254 if len(fields) == 1 else 14
    over = [np.flatnonzero(f > most) for f in fields]
    head = np.array([n, bits, len(fields), len(wide), *map(len, over), *header], "<u8")
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        out.write(np.array([len(head)], "<u8").tobytes() + head.tobytes())
        for w in wide:
            out.write(w[order].astype("<u8").tobytes())
        for i, f in zip(over, fields):
            out.write(i.astype("<u8").tobytes() + f[i].astype("<u8").tobytes())
        out.write(starts.tobytes() + low.tobytes())
        record = np.zeros((n, (len(fields) + 1) // 2), np.uint8)
        for j, f in enumerate(fields):
            record[:, j // 2] |= np.minimum(f, U(most + 1)).astype(np.uint8) << (j % 2 * 4)
        out.write(record.tobytes())
    os.replace(draft, path)


def _header(path: str) -> np.ndarray:
    n = int(np.fromfile(path, "<u8", 1)[0])
    return np.fromfile(path, "<u8", n, offset=8)


class Store:
    """One level's part for one bucket, mapped into memory."""

    def __init__(self, path: str):
        head = _header(path)
        self.n, self.bits, k, wide = map(int, head[:4])
        over = [int(x) for x in head[4:4 + k]]
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        at = 8 * (1 + len(head))

        def take(dtype, count):
            nonlocal at
            a = raw[at:at + np.dtype(dtype).itemsize * count].view(dtype)
            at += a.nbytes
            return a

        self.wide = [take("<u8", self.n) for _ in range(wide)]
        self.over = [(take("<u8", m), take("<u8", m)) for m in over]
        self.starts = take("<u4", (1 << self.bits) + 1)
        self.low = take("<u4", self.n)
        self.fields, self.record = k, take("u1", self.n * ((k + 1) // 2)).reshape(self.n, (k + 1) // 2)

    def find(self, key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(found, index) by binary search among the keys of one prefix."""
        prefix = ((((key >> U(32)) * U(buckets)) & U(0xFFFFFFFF)) >> U(32 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)
        low = (key & U(0xFFFFFFFF)).astype(np.uint32)
        lo, hi = self.starts[prefix].astype(np.int64), self.starts[prefix + 1].astype(np.int64)
        end = hi.copy()
        while len(hi) and (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            below = (self.low[np.minimum(mid, self.n - 1)] < low) & open_
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
        found = (lo < end) & (self.low[np.minimum(lo, max(self.n - 1, 0))] == low) if self.n else np.zeros(len(key), bool)
        return found, lo

    def get(self, found: np.ndarray, index: np.ndarray, fields: int) -> list[np.ndarray]:
        """The first fields of the keys found, 0 elsewhere: one access a key."""
        i, out = index[found], []
        record, bits = self.record[i], 255 if self.fields == 1 else 15
        for f in range(fields):
            small = record[:, f // 2] >> (f % 2 * 4) & bits
            v = small.astype(np.float64)
            if (big := small == bits).any():
                places, values = self.over[f]
                v[big] = values[np.searchsorted(places, i[big])]
            all_ = np.zeros(len(found))
            all_[found] = v
            out.append(all_)
        return out


def _store_path(folder: str, level: int, bucket: int) -> str:
    return f"{folder}/level{level}-{bucket:06d}"


class Stores:
    """One level's files; each is mapped when first looked up."""

    def __init__(self, folder: str, level: int, buckets: int):
        self.folder, self.level, self.buckets, self.open = folder, level, buckets, {}

    def look(self, key: np.ndarray, fields: int, wide: int = 0) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The distinct keys, their fields (wide ones first, then whether the key is there), and each key's place among these.

        Keys are looked up in order, so a bucket's file is walked from front to end."""
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.ones(len(key), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        distinct = sorted_[new]
        out = [np.zeros(len(distinct), U) for _ in range(wide)] + [np.zeros(len(distinct), bool)] + [np.zeros(len(distinct)) for _ in range(fields)]
        ends = np.searchsorted(bucket_of(distinct, self.buckets), np.arange(self.buckets + 1, dtype=U))
        for b in np.flatnonzero(np.diff(ends)):
            i = slice(ends[b], ends[b + 1])
            if b not in self.open:
                path = _store_path(self.folder, self.level, b)
                self.open[b] = Store(path) if os.path.exists(path) else None
            if (s := self.open[b]) is not None:
                found, index = s.find(distinct[i], self.buckets)
                for w in range(wide):
                    out[w][i][found] = s.wide[w][index[found]]
                out[wide][i] = found
                for f, values in enumerate(s.get(found, index, fields)):
                    out[wide + 1 + f][i] = values
        return distinct, out, place

    def headers(self, columns: int) -> list[int]:
        heads = [_header(p) for b in range(self.buckets) if os.path.exists(p := _store_path(self.folder, self.level, b))]
        return [sum(int(h[-columns + j]) for h in heads) for j in range(columns)]


class Vocabulary(Stores):
    """The words, as level 0: a number (small where a word is frequent) and a count for each hash."""

    def __init__(self, folder: str, buckets: int):
        super().__init__(folder, 0, buckets)
        self.types, self.tokens = self.headers(2)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and training counts of the distinct hashes, and each one's place among these; unseen words are numbered apart and have count 0."""
        distinct, (number, found, count), place = self.look(hashes, 1, 1)
        return np.where(found, number, (distinct >> U(2)) | U(UNSEEN)), count, place


class Model:
    """All levels."""

    def __init__(self, folder: str, order: int, buckets: int):
        self.order, self.vocabulary = order, Vocabulary(folder, buckets)
        self.types, self.tokens = self.vocabulary.types, self.vocabulary.tokens
        self.levels, self.discounts, self.empty = {}, {}, None
        for level in range(1, order + 1):
            self.levels[level] = Stores(folder, level, buckets)
            total, n1, n2, n3, n4, tail = self.levels[level].headers(6)
            self.discounts[level] = discounts(n1, n2, n3, n4)
            if level == 1:
                self.empty = (total, n1, n2, tail)

    def lookup(self, level: int, gram: np.ndarray, context: bool) -> list[np.ndarray]:
        """Counts of grams, and with ``context`` their total and numbers of successors."""
        _, (_, c, *stats), place = self.levels[level].look(store_key(level, gram), 5 if context else 1)
        if context:
            n1, n2, n3, more = stats
            stats = [more + n1 + 2 * n2 + 3 * n3, n1, n2, n3]
        return [f[place] for f in (c, *stats)]

    def interpolate(self, level: int, c, total, n1, n2, n3, lower):
        d = self.discounts[level]
        weight = (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(total, 1)
        return np.where(total > 0, np.maximum(c - np.array(d)[np.minimum(c, 3).astype(np.int64)], 0) / np.maximum(total, 1) + weight * lower, lower)

    def score(self, texts: list[str | None]):
        """(tokens, known tokens, base log10, model log10) of each text."""
        number, count, codes, sizes = numbered(texts, self.order, self.vocabulary)
        at, ending = endings(number[codes], sizes, self.order)
        known = count[codes[at]]
        p, context = np.full(len(at), 1.0 / (self.types + 1)), [np.full(len(at), float(v)) for v in self.empty]
        for level, gram in enumerate(ending, 1):
            if level == self.order > 1:
                (c,) = self.lookup(level, gram[at], False)
                p = self.interpolate(level, c, *context, p)
                break
            # a gram is looked up for its count and as the next level's context; words once each
            c, *stats = self.lookup(level, gram, level < self.order) if level > 1 else (f[codes] for f in self.lookup(1, number, self.order > 1))
            p = self.interpolate(level, c[at], *context, p)
            context = [f[at - 1] for f in stats]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        add = lambda x: np.add.reduceat(x, first) if len(first) else x
        base = np.log10((known + 1) / (self.tokens + (self.types + 1)))
        return sizes, add((known > 0).astype(np.int64)), add(base), add(np.log10(p))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Discounts of counts 0, 1, 2, 3 and more from the numbers of grams with count 1 to 4; plain ones where these are too few."""
    out, y = [0.0], n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a and n2 else 0.5 * k)
    return tuple(out)


# ---------------------------------------------------------------- counting
def _buckets(one):
    """A task over rows sorted by bucket: ``one(bucket, grams, contexts)`` for each, with lists of (n, blob)."""
    def run(batches: Iterator[pa.RecordBatch]):
        now, rows = None, ([], [])
        for b in batches:
            for i, (bucket, context, n) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)))):
                if bucket != now and now is not None:
                    yield from one(now, *rows)
                    rows = ([], [])
                now = bucket
                rows[context].append((n, b.column(3)[i].as_py()))
        if now is not None:
            yield from one(now, *rows)

    return run


def _joined(rows: list, columns: int, more: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = [_unpack(blob, n, columns, more) for n, blob in rows]
    cols = [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, U) for j in range(columns + more)]
    return cols[:columns], cols[columns:]


def count_words(texts: DataFrame, folder: str, buckets: int) -> None:
    """Level 0 of the stores from a table of one column: words by hash, numbered from 1 on, by count within a bucket."""
    def count(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0

        def flush():
            yield from _send(0, *_summed([np.concatenate(held)], [np.ones(sum(map(len, held)), U)]), False, buckets)

        for b in batches:
            for texts in in_groups(b.column(0).to_pylist()):
                held += (word_hashes(texts)[0], np.repeat(END, len(texts)))
                n += len(held[-2]) + len(texts)
                if n > CHUNK_TOKENS:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def write(bucket: int, rows: list, _):
        (key,), (n,) = _summed(*_joined(rows, 1, 1))
        number = np.empty(len(key), U)
        number[np.lexsort((key, ~n))] = np.arange(len(key), dtype=U) * U(buckets) + U(bucket + 1)
        _write_store(_store_path(folder, 0, bucket), key, [n], [len(key), int(n.sum())], buckets, [number])
        yield from ()

    texts.mapInArrow(count, _PACKED_DDL).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(write), _PACKED_DDL).write.format("noop").mode("overwrite").save()


def count_grams(texts: DataFrame, folder: str, order: int, buckets: int) -> None:
    """Levels ``order`` to 1 of the stores, over the words of level 0."""
    def count(batches: Iterator[pa.RecordBatch]):
        vocabulary = worker_state(f"lm words {folder}", lambda: Vocabulary(folder, buckets))
        held, n = [], 0

        def flush():
            ranks, words = _ranked(np.concatenate([t for t, _ in held]))
            cols, bits = grams(ranks, np.concatenate([s for _, s in held]), order), (len(words) - 1).bit_length()
            if bits * order <= 64:  # one number a gram: sorted as such
                key = cols[0]
                for c in cols[1:]:
                    key = (key << U(bits)) | c
                key.sort()
                first = _begins([key])
                key, add = key[first], [np.diff(np.append(first, len(key))).astype(U)]
                cols = [(key >> U(bits * j)) & U((1 << bits) - 1) for j in range(order - 1, -1, -1)]
            else:
                cols, add = _summed(cols, [np.ones(len(cols[0]), U)])
            yield from _send(order, [words[c] for c in cols], add, False, buckets)

        for b in batches:
            for texts in in_groups(b.column(0).to_pylist()):
                number, _, codes, sizes = numbered(texts, order, vocabulary)
                held.append((number[codes], sizes))
                n += len(codes)
                if n > CHUNK_TOKENS:
                    yield from flush()
                    held.clear()
                    n = 0
        if n:
            yield from flush()

    def merge(level: int):
        def one(bucket: int, gram_rows: list, context_rows: list):
            cols, (c,) = _summed(*_joined(gram_rows, level, 1))
            header = [int(c.sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4)), int((c >= 3).sum())]
            key, fields = store_key(level, gram_of(cols)), [c]
            if level < order:
                context, stats = _summed(*_joined(context_rows, level, 4))
                none, more = np.zeros(len(context[0]), U), np.zeros(len(key), U)
                (key,), fields = _summed([np.concatenate([key, store_key(level, gram_of(context))])], [np.concatenate([c, none]), *(np.concatenate([more, x]) for x in stats)])
            _write_store(_store_path(folder, level, bucket), key, fields, header, buckets)
            if level > 1 and len(c):
                first = _begins(cols[:-1])
                add = lambda x: np.add.reduceat(x.astype(U), first)
                yield from _send(level - 1, [x[first] for x in cols[:-1]], [add(c == 1), add(c == 2), add(c >= 3), add(np.where(c >= 3, c - U(3), U(0)))], True, buckets)
                yield from _send(level - 1, *_summed(cols[1:], [np.ones(len(c), U)]), False, buckets)

        return _buckets(one)

    packed = texts.mapInArrow(count, _PACKED_DDL)
    for level in range(order, 0, -1):
        packed = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge(level), _PACKED_DDL)
    packed.write.format("noop").mode("overwrite").save()


def train(docs: DataFrame, order: int = 3, text_col: str = "text", buckets: int | None = None) -> dict:
    """Count all texts of ``docs`` and write the stores; returns what :func:`score` needs (folder, order, buckets).

    The folder must be on a mount that all machines share (``spark.checkpoint.dir``
    as a path or file: URI); a ValueError says so otherwise.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    texts = docs.select(docs[text_col].alias("text"))
    buckets = buckets or buckets_for(texts)
    folder = mounted(shared_folder(spark, "lm"))
    os.makedirs(folder)
    count_words(texts, folder, buckets)
    count_grams(texts, folder, order, buckets)
    return {"folder": folder, "order": order, "buckets": buckets}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text scored: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A null or empty text is its end token alone; repeated rows give repeated rows;
    with an empty training set every token has probability 1.  Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]):
        m = worker_state(f"lm {model['folder']}", lambda: Model(model["folder"], model["order"], model["buckets"]))
        for b in batches:
            at = 0
            for texts in in_groups(b.column(1).to_pylist()):
                n, known, base, own = m.score(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(base), pa.array(own)], schema=schema)
                at += len(texts)

    out = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % modulus
