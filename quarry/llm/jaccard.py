"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches a threshold; the result is every document's connected component.

1. Equal sets are one class, so copies are never compared.
2. Candidates: the hash range is cut into segments, a class's shingles in one segment
   make one key.  A pair at the threshold differs in at most d shingles, so with
   d + t segments it agrees in t of them or more; e of a class's own are empty, so it
   shares t - e keys or more with each partner.  (A class with t or more empty segments
   sends keys of those too.)  That is a T-occurrence problem on lists of classes by
   key: lists of at most ``SHORT`` classes are merged, which counts the keys that a
   pair shares; a pair is tied if what it lacks could be in its long lists.  Classes
   with so many long lists that all their shared keys could be long are tied to the
   smallest of each of those.  So no pair is missed, no long list is paired out, and
   a passage that many documents share ties next to nothing.  Segment numbers go by size
   bands; a class takes part in its own band and, as the smaller one, in the next.
3. Components of these ties are clusters.  A cluster's sets meet once, in blocks of
   bounded total size (all pairs of blocks where one is not enough).
4. In a block: documents that are near a member of a large group join it at once; for
   the others, inverted lists are searched for documents with the required
   overlap T.  The L longest lists are set aside, the short ones are merged by a
   heap (by counting, where they are long themselves), and what occurs often enough
   there is probed in the long ones by binary search, all candidates at a time.
   Exact overlaps decide.  Pairs known to be connected are skipped, and a block
   returns a spanning forest.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bounded_broadcast, buckets_for, components, text_ascii_lower, worker_state, write_table
from quarry.llm.lm import WordHashes, bucket_of, mix

WORDS, NUM, DEN = 3, 90, 100
BLOCK_SHINGLES = 4_000_000
CHUNK_KEYS = 1_000_000
SHORT = 8
HEAP_ENTRIES = 500
U = np.uint64
_WORDS = re.compile("[^ \t-\r]+")
_NODE = U((1 << 48) - 1)


# ---------------------------------------------------------------- sets
def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than one shingle make one, no words none."""
    found = _WORDS.findall(text_ascii_lower(text)) if text else []
    if not found:
        return np.zeros(0, U)
    w = np.frombuffer(array("Q", [hashes[x] for x in found]), U)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, U)
    for j in range(k):
        h = mix(h, w[j:len(w) - k + 1 + j])
    return np.unique(h)


def class_of(s: np.ndarray) -> int:
    """Hash of a whole set."""
    return int(mix(mix(s, np.ones(1, U)).sum(dtype=U, keepdims=True), np.array([len(s)], U)).view(np.int64)[0])


# ---------------------------------------------------------------- candidate keys
class Bands:
    """Size bands and their numbers of segments, for a threshold num/den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.num, self.den = num, den
        self.lower = [0, 1]  # band i: sizes lower[i] .. lower[i + 1] - 1; a partner's band is the same or the one before
        self.segments: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        while self.lower[-1] <= size:
            self.lower.append(self.lower[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.lower, size, side="right")) - 1

    def of(self, band: int) -> tuple[int, int]:
        """(segments m, agreeing ones t) of a band: m - t differing shingles at most between two sets that join here."""
        if band not in self.segments:
            self.band(self.lower[-1])
            while len(self.lower) < band + 2:
                self.band(self.lower[-1])
            d = 2 * (self.lower[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            least = max(1, -(-self.lower[band] * self.num // self.den))  # smallest set that takes part
            m = d + 1
            while m < 4 * least:  # until t is above the usual number of empty segments
                empty = m * math.exp(-least / m)
                if m - d > empty + 3 * math.sqrt(empty):
                    break
                m += 1
            self.segments[band] = (m, m - d)
        return self.segments[band]

    def keys(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(band, keys shared with any partner there at least, keys) of each band in which a set takes part.  A key's low byte is its band's."""
        own = self.band(len(s))
        out = [self._keys(s, own)]
        if len(s) * self.den >= self.lower[own + 1] * self.num:  # large enough for a partner in the next band
            out.append(self._keys(s, own + 1))
        return out

    def _keys(self, s: np.ndarray, band: int) -> tuple[int, int, np.ndarray]:
        m, t = self.of(band)
        at = ((s >> U(32)) * U(m)) >> U(32)  # ascending, as the set is
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums, where = np.add.reduceat(mix(s, np.ones(1, U)), first), at[first]
        need = t - (m - len(first))
        if need < 1:
            need, empty = 1, np.setdiff1d(np.arange(m, dtype=U), where)
            sums, where = np.concatenate([sums, np.zeros(len(empty), U)]), np.concatenate([where, empty])
        return band, need, (mix(sums, where + U(band << 32)) & ~U(255)) | U(band & 255)


def _runs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node), sorted; for each its place in the key's run, and the run's length."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else np.zeros(0, bool)
    key, node = key[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    return key, node, np.arange(len(key)) - np.repeat(first, size), np.repeat(size, size)


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a (n, 3) array and how often each occurs."""
    rows = rows[np.lexsort(rows.T)]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.diff(np.append(first, len(rows)))


_KEYS, _LONG, _HUBS = range(3)  # kinds of packed rows
_PACKED = "bucket int, kind int, n long, blob binary"
_META = "doc_id long, n_shingles long, class long, band int, need int, need_next int"


def shingled_and_listed(docs: DataFrame, words: int, num: int, den: int, buckets: int) -> DataFrame:
    """One pass over (doc_id, text), then one exchange of the keys; written, in one table with three kinds of rows:

    - doc_id, n_shingles, class, band, need, need_next: each row's set, and how many keys it shares with a partner (need_next is null where it takes no part);
    - a, b, band, shared: pairs of 48-bit class hashes in short lists, with a count of shared keys (several rows a pair);
    - node, center, band, long: classes in long lists, by the list's smallest class as known where it was
      counted, with a count of such lists (several rows each); where long is null, two such smallest ones of one list.
    """
    meta = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("band", pa.int32()), ("need", pa.int32()), ("need_next", pa.int32())]
    packed = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary()), *meta])
    out = pa.schema([*meta, ("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("node", pa.int64()), ("center", pa.int64()), ("long", pa.int64())])

    def rows(schema, size, **cols):
        return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(size, f.type) for f in schema], schema=schema)

    def pack(bucket, kind, *columns):
        """Columns of 64 bits; the last one of _KEYS, a class, as 48."""
        blob = b"".join(c.tobytes() for c in columns[:-1])
        last = np.ascontiguousarray(columns[-1]).view(np.uint8).reshape(-1, 8)
        blob += (last[:, :6] if kind == _KEYS else last).tobytes()
        return rows(packed, 1, bucket=pa.array([bucket], pa.int32()), kind=pa.array([kind], pa.int32()), n=pa.array([len(columns[0])], pa.int64()), blob=pa.array([blob], pa.binary()))

    def unpack(kind, n, blob):
        if kind != _KEYS:
            return np.frombuffer(blob, U).reshape(-1, n)
        node = np.zeros((n, 8), np.uint8)
        node[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 8 * n).reshape(n, 6)
        return np.frombuffer(blob, U, n), node.reshape(-1).view(U)

    def spread(batches: Iterator[pa.RecordBatch]):
        hashes, bands = worker_state("lm words", WordHashes), Bands(num, den)
        keys, nodes, held, row = [], [], 0, TaskContext.get().partitionId()

        def flush():
            key, node, place, _ = _runs(np.concatenate(keys), np.concatenate(nodes))
            # so many show already that the list is long; the rest need not meet there, but are
            # counted here, and the smallest one (a hub) will be tied to the whole list's
            rest = np.flatnonzero(place > SHORT)
            if len(rest):
                low = node[rest - place[rest]]
                long, times = _counted(np.stack([node[rest], low, key[rest] & U(255)], axis=1))
                yield pack(int(node[rest[0]] % U(buckets)), _LONG, *long.T, times.astype(U))
                hub = rest[place[rest] == SHORT + 1]
                hub_key, hub_node = key[hub], node[hub - place[hub]]
                ends = np.searchsorted(bucket_of(hub_key, buckets), np.arange(buckets + 1, dtype=U))
                for k in np.flatnonzero(np.diff(ends)):
                    yield pack(int(k), _HUBS, hub_key[ends[k]:ends[k + 1]], hub_node[ends[k]:ends[k + 1]])
                key, node = np.delete(key, rest), np.delete(node, rest)
            ends = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1, dtype=U))
            for k in np.flatnonzero(np.diff(ends)):
                yield pack(int(k), _KEYS, key[ends[k]:ends[k + 1]], node[ends[k]:ends[k + 1]])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, found = batch.slice(lo, 500), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingle_set(text, words, hashes)
                    if not len(s):
                        found.append((0, None, None, None, None))
                        continue
                    c, parts = class_of(s), bands.keys(s)
                    found.append((len(s), c, parts[0][0], parts[0][1], parts[1][1] if len(parts) > 1 else None))
                    if doc_id is not None:
                        for _, _, k in parts:
                            keys.append(k)
                            nodes.append(np.full(len(k), U(c & int(_NODE)), U))
                            held += len(k)
                if part.num_rows:
                    cols = [pa.array(c, f.type) for c, f in zip(zip(*found), list(packed)[5:])]
                    yield rows(packed, part.num_rows, bucket=pa.array((row + np.arange(part.num_rows)) % buckets, pa.int32()), doc_id=part.column(0), **dict(zip(packed.names[5:], cols)))
                    row += part.num_rows  # dealt in turn: copies do not meet
                if held > CHUNK_KEYS:
                    yield from flush()
                    keys, nodes, held = [], [], 0
        if held:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]):
        def ints(a):
            return pa.array(a.astype(np.int64))

        def in_long(node, center, band, times):
            return rows(out, len(node), node=ints(node), center=ints(center), band=pa.array(band.astype(np.int32)), long=ints(times))

        def one(blobs):
            parts = [unpack(*b) for b in blobs if b[0] == _KEYS]
            key, node, place, size = _runs(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
            long = np.flatnonzero(size > SHORT)
            if len(long):
                center = node[long - place[long]]
                found, times = _counted(np.stack([node[long], center, key[long] & U(255)], axis=1))
                yield in_long(*found.T, times)
                hubs = [unpack(*b) for b in blobs if b[0] == _HUBS]
                if hubs:
                    hub_key, hub = np.concatenate([h[0] for h in hubs]), np.concatenate([h[1] for h in hubs])
                    first = long[place[long] == 0]
                    center = node[first][np.searchsorted(key[first], hub_key)]
                    tied, _ = _counted(np.stack([hub, center, center], axis=1)[hub != center])
                    if len(tied):
                        yield rows(out, len(tied), node=ints(tied[:, 0]), center=ints(tied[:, 1]))
            few = (size <= SHORT) & (size > 1)
            key, node, place, size = key[few], node[few], place[few], size[few]
            pairs = [np.zeros((0, 3), U)]
            for k in range(1, SHORT):  # each with the one k places further in its run
                i = np.flatnonzero(place + k < size)
                pairs.append(np.stack([node[i], node[i + k], key[i] & U(255)], axis=1))
            pairs, shared = _counted(np.concatenate(pairs))
            if len(pairs):
                yield rows(out, len(pairs), a=ints(pairs[:, 0]), b=ints(pairs[:, 1]), band=pa.array(pairs[:, 2].astype(np.int32)), shared=ints(shared))

        worker_state("lm words", WordHashes)  # what another operator has left goes
        now, blobs = None, []
        for batch in batches:  # by bucket
            mine = batch.filter(batch.column(packed.get_field_index("blob")).is_valid())
            plain = batch.filter(batch.column(packed.get_field_index("n_shingles")).is_valid())
            if plain.num_rows:
                yield rows(out, plain.num_rows, **{n: plain.column(packed.get_field_index(n)) for n, _ in meta})
            for i, (bucket, kind, n) in enumerate(zip(*(mine.column(j).to_pylist() for j in range(3)))):
                packed_row = (kind, n, mine.column(3)[i].as_buffer())  # no copy
                if packed_row[0] == _LONG:
                    yield in_long(*unpack(*packed_row))
                    continue
                if bucket != now and blobs:
                    yield from one(blobs)
                    blobs = []
                now = bucket
                blobs.append(packed_row)
        if blobs:
            yield from one(blobs)

    return write_table(docs.mapInArrow(spread, f"{_PACKED}, {_META}").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        gather, f"{_META}, a long, b long, shared long, node long, center long, long long"), "shingled")


def candidate_ties(listed: DataFrame) -> DataFrame:
    """Ties (a, b) between 48-bit class hashes; every pair at the threshold is connected by ties."""
    low = F.lit(int(_NODE))
    own = listed.where("class IS NOT NULL AND doc_id IS NOT NULL").select(F.col("class").bitwiseAND(low).alias("node"), F.explode(F.array(
        F.struct(F.col("band").bitwiseAND(F.lit(255)).alias("band"), F.col("need").alias("need")),
        F.struct((F.col("band") + 1).bitwiseAND(F.lit(255)).alias("band"), F.col("need_next").alias("need")))).alias("n")).where("n.need IS NOT NULL")
    need = own.groupBy("node", "n.band").agg(F.min("n.need").alias("need"))
    lists = listed.where("long IS NOT NULL").groupBy("node", "center", "band").agg(F.sum("long").alias("long"))
    long = lists.groupBy("node", "band").agg(F.sum("long").alias("long"))

    # pairs of short lists: the shared keys that are missing would have to be in long lists of both
    pairs = listed.where("a IS NOT NULL").groupBy("a", "b", "band").agg(F.sum("shared").alias("shared"))
    for side in "ab":
        both = need.join(long, ["node", "band"], "left").select(F.col("node").alias(side), "band", F.col("need").alias(f"need_{side}"), F.coalesce("long", F.lit(0)).alias(f"long_{side}"))
        pairs = pairs.join(both, [side, "band"])
    short = pairs.where(F.col("shared") >= F.greatest("need_a", "need_b") - F.least("long_a", "long_b")).select("a", "b")

    # classes whose shared keys could all be long
    only_long = long.join(need, ["node", "band"]).where("long >= need").select("node", "band")
    along = lists.join(only_long, ["node", "band"]).where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"))
    hubs = listed.where("center IS NOT NULL AND long IS NULL").select(F.col("node").alias("a"), F.col("center").alias("b"))
    return short.unionByName(along).unionByName(hubs).distinct()


# ---------------------------------------------------------------- search in a block
def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


class InvertedLists:
    """Lists of document numbers by shingle, for T-occurrence queries by DivideSkip."""

    MU = 0.01  # weight of a binary probe against a heap step in the choice of L

    def __init__(self, sets: list[np.ndarray]):
        self.docs = len(sets)
        shingle = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(shingle, kind="stable")  # lists stay sorted by document
        shingle, self.doc = shingle[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        self.shingle, self.start = shingle[first], np.append(first, len(shingle))

    def query(self, s: np.ndarray, t: int, other: np.ndarray | None = None) -> np.ndarray:
        """Documents (of those marked in ``other``) that occur in at least ``t`` of the lists of ``s``."""
        at = np.searchsorted(self.shingle, s)
        size = self.start[at + 1] - self.start[at]
        order = np.argsort(size, kind="stable")
        order = order[np.searchsorted(size[order], 1, side="right"):]  # without lists that hold only the query itself
        if len(order) < t:
            return np.zeros(0, np.int64)
        long = min(t - 1, int(t / (self.MU * math.log2(int(size[order[-1]]) + 1) + 1)))
        lists = [self.doc[self.start[k]:self.start[k + 1]] for k in at[order]]
        short, rest = lists[:len(lists) - long], lists[len(lists) - long:]
        if sum(map(len, short)) <= HEAP_ENTRIES:
            runs = [(doc, sum(1 for _ in run)) for doc, run in groupby(heapq.merge(*(x.tolist() for x in short)))]
            doc, count = np.array(runs, np.int64).reshape(-1, 2).T
        else:
            count = np.bincount(np.concatenate(short), minlength=self.docs)
            doc = np.flatnonzero(count)
            count = count[doc]
        if other is not None:
            doc, count = doc[other[doc]], count[other[doc]]
        for probed, x in enumerate(rest):
            alive = count + (len(rest) - probed) >= t
            doc, count = doc[alive], count[alive]
            if not len(doc):
                break
            count = count + (x[np.minimum(np.searchsorted(x, doc), len(x) - 1)] == doc)
        return doc[count >= t]


def linked(sets: list[np.ndarray], num: int, den: int, groups: int = 4, members: int = 6) -> list[tuple[int, int]]:
    """A spanning forest of the links between non-empty sets."""
    parent = list(range(len(sets)))
    forest, group = [], {i: [i] for i in parent}

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(i, j):
        a, b = find(i), find(j)
        if len(group[a]) < len(group[b]):
            a, b = b, a
        parent[b] = a
        group[a] += group.pop(b)
        forest.append((i, j))

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    large: list[int] = []
    for i in order:  # near a late member (of a like size) of a large group: no search needed
        large = sorted({find(j) for j in large}, key=lambda j: -len(group[j]))[:groups]
        for j in large:
            near = next((m for m in reversed(group[j][-members:]) if similar(sets[i], sets[m], num, den)), None)
            if near is not None:
                if find(near) != find(i):
                    join(i, near)
                break
        if find(i) not in large:
            large.append(find(i))
    if len(group) == 1:
        return forest
    main = max(group, key=lambda j: len(group[j]))
    lists = InvertedLists(sets)
    label = np.array([find(i) for i in range(len(sets))])
    for i in order:
        if find(i) == find(main):
            continue  # its pairs outside the largest group are searched from the other side
        n = len(sets[i])
        least = -(-n * num // den)
        t = -(-num * (n + least) // (num + den))
        for j in lists.query(sets[i], t, label != label[i]).tolist():
            if find(j) != find(i) and similar(sets[i], sets[j], num, den):
                join(i, j)
                label[group[find(i)]] = find(i)
    return forest


# ---------------------------------------------------------------- the operator
def _with_sets(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` with class (null for an empty set) and shingles, in place of text."""
    names = [c for c in rows.columns if c != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text") + ", class long, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = worker_state("lm words", WordHashes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                sets = [shingle_set(t, words, hashes) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                cols = [b.column(b.schema.get_field_index(c)) for c in names]
                cols += [pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "class", "shingles"])

    return rows.mapInArrow(run, ddl)


def jaccard_groups(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text",
                   block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (distinct), class (a number that equal sets share), group and lowest.

    Links: ``den * |intersection| >= num * |union|`` of the sets of ``words``-word
    shingles; a group holds the classes that links connect, ``lowest`` is its smallest id.
    Rows of one id may lie in several groups.  Texts without words (null, empty, blank) have no class and rows
    of a null id no group: they link with nothing.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = buckets_for(docs)
    listed = shingled_and_listed(docs, words, num, den, buckets)
    meta = listed.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "class")
    own = meta.where("doc_id IS NOT NULL AND class IS NOT NULL")
    classes = own.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"))

    clusters = components(candidate_ties(listed))
    members = write_table(classes.join(clusters, F.col("class").bitwiseAND(F.lit(int(_NODE))) == F.col("node")).select("class", "rep", "size", F.col("component").alias("cluster")), "members")
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum("size") / block_shingles).cast("int").alias("blocks"), F.count("*").alias("of")).where("of > 1").drop("of")
    members = members.join(blocks, "cluster").select(F.col("class").alias("want"), F.col("rep").alias("doc_id"), "cluster", "blocks")
    sets = _with_sets(docs.join(bounded_broadcast(members), "doc_id"), words).where(F.col("class") == F.col("want"))
    part = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    # one block of a cluster, or each pair of its blocks
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, part).alias("i"), F.greatest(j, part).alias("j")))
    sets = sets.dropDuplicates(["class"]).select("cluster", F.explode(F.when(F.col("blocks") == 1, F.slice(pairs, 1, 1)).otherwise(
        F.filter(pairs, lambda p: (p["i"] < p["j"]) | (F.col("blocks") == 1)))).alias("p"), "class", "shingles").select("cluster", "p.i", "p.j", "class", "shingles")

    def search(batches: Iterator[pa.RecordBatch]):
        def one(rows):
            forest = linked([np.frombuffer(s, U) for _, s in rows], num, den)
            if forest:
                ids = np.array([c for c, _ in rows], np.int64)
                a, b = np.array(forest).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

        now, rows = None, []
        for batch in batches:  # by block
            for *block, c, s in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if block != now and rows:
                    yield from one(rows)
                    rows = []
                now = block
                rows.append((c, s))
        if rows:
            yield from one(rows)

    links = sets.repartition(buckets, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(search, "a long, b long")
    joined = components(links).withColumnsRenamed({"node": "class", "component": "group"})
    classes = classes.join(joined, "class", "left").withColumn("group", F.coalesce("group", "class"))
    lowest = classes.groupBy("group").agg(F.min("rep").alias("lowest"))
    groups = classes.select("class", "group").join(lowest, "group").withColumnRenamed("class", "__class")
    return meta.join(groups, (F.col("class") == F.col("__class")) & F.col("doc_id").isNotNull(), "left").drop("__class")


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text",
                       block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (distinct), component_id (smallest id reachable by links, itself included).

    Links are those of :func:`jaccard_groups`.  Rows of a null id have a null component.  Rows that share
    an id share a component."""
    rows = write_table(jaccard_groups(docs, words, num, den, id_col, text_col, block_shingles), "groups")
    # an id of several rows has the least of its groups
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("lowest").alias("least")).where("n > 1").select("doc_id", "least")
    return rows.join(bounded_broadcast(several), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "lowest", "doc_id").alias("component_id"))


def with_class(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``rows`` (with text) and the ``class`` of :func:`jaccard_groups`, null for a text without words."""
    hashed = T.StructType([*rows.schema.fields, T.StructField("class", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        hashes = worker_state("lm words", WordHashes)
        for b in batches:
            sets = (shingle_set(t, words, hashes) for t in b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], names=hashed.names)

    return rows.mapInArrow(run, hashed)
