"""Turns in order: range-sorted conversations, of which a hot one spans several partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import buckets_for

#: Bytes of a blob that travels to a digest.
BLOB = 16_384


def turn_key(role, text):
    """16 bytes that stand for a turn's content; rows of one turn number are ordered by them."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def range_sorted(rows: DataFrame, keys: tuple[str, ...], then: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of ``keys`` (equal keys stay together) and sorted by ``keys`` and ``then``, nulls first.

    ``parts`` is to be given where the planner cannot know the size of ``rows`` (behind joins)."""
    return rows.repartitionByRange(parts or buckets_for(rows), *keys).sortWithinPartitions(*keys, *then)


def digest_in_order(blobs: DataFrame, key: str, order: tuple[str, ...], separator: bytes) -> DataFrame:
    """SHA-256 of each key's blobs, joined in order: key, sha256.

    ``blobs`` holds key, ``order``, slice and blob: blobs of one place in the order are its
    slices, and the separator stands before each slice 0 but the first.  A digest is one pass
    over its bytes, so a key's blobs meet in one task; it streams them and holds one Arrow batch,
    whatever the key's length.  Callers pass few blobs of ``BLOB`` bytes a key, not a row a member."""
    kind = blobs.schema[key].dataType.simpleString()
    dealt = blobs.select(key, *order, "slice", "blob").repartition(buckets_for(blobs), key).sortWithinPartitions(key, *order, "slice").select(key, "slice", "blob")

    def run(batches: Iterator[pa.RecordBatch]):
        digest, at, kept = None, None, None

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kept), pa.array([d for _, d in done])], names=[key, "sha256"])

        for b in batches:
            done, kept = [], b.schema.field(0).type
            for k, slice_, blob in zip(*(c.to_pylist() for c in b.columns)):
                if digest is None or k != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = k, hashlib.sha256()
                elif slice_ == 0:
                    digest.update(separator)
                digest.update(blob)
            if done:
                yield batch(done)
        if digest is not None:
            yield batch([(at, digest.hexdigest())])

    return dealt.mapInArrow(run, f"{key} {kind}, sha256 string")
