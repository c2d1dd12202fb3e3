"""Exact deduplication on a sharded cuckoo-filter index.

A digest of each normalised text (A-Z lower-cased, null as empty) goes to the shard that its first
bytes name.  A shard is a cuckoo filter of live digests plus the bucketed content: the full digests
with the id that stays and the number of rows.  A digest that the filter does not know is new; a hit is
verified against the content of its bucket, so a false positive of the filter never merges two texts.
A filter supports deletion; when an insertion overflows its kicks, the filter doubles and is rebuilt
from the stored keys.

Copies are combined before the shuffle (each map task sends a digest once per Arrow batch), so a text that
makes up a third of all rows reaches its shard as a few rows.

Defined results: null text equals empty text; ``keep_id`` is the largest ``doc_id`` of the group, nulls
being smaller than any id; repeated rows with the same ``doc_id`` and text cannot be told apart and all
count as kept; a group of null ids only has a null ``keep_id`` and counts as kept; :func:`drop_exact_duplicates` leaves one of such
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._base import files_for, written

SLOTS = 4
MAX_KICKS = 200
#: Rows that a shard is meant for: the number of shards grows with the table, so that a task's index does not.
SHARD_ROWS = 50_000


class CuckooFilter:
    """Fingerprints of digests in buckets of four slots; two candidate buckets each.

    ``np.uint16`` fingerprints, 0 meaning an empty slot.  The number of buckets is a power of two and the
    second bucket is the first one xor a hash of the fingerprint, so either is found from the other.
    """

    def __init__(self, buckets: int = 1024):
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.mask = buckets - 1
        self.turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & self.mask
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995 >> 3)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        fingerprint, first, second = self._places(digest)
        return fingerprint in self.table[first].tolist() or fingerprint in self.table[second].tolist()

    def insert(self, digest: bytes) -> bool:
        """False on overflow: the fingerprint that was kicked out last has no place, and the filter has to be rebuilt."""
        fingerprint, first, second = self._places(digest)
        for bucket in (first, second):
            row = self.table[bucket].tolist()
            if 0 in row:
                self.table[bucket, row.index(0)] = fingerprint
                return True
        bucket = second
        for _ in range(MAX_KICKS):
            self.turn = (self.turn + 1) % SLOTS
            fingerprint, self.table[bucket, self.turn] = int(self.table[bucket, self.turn]), fingerprint
            bucket = self._other(bucket, fingerprint)
            row = self.table[bucket].tolist()
            if 0 in row:
                self.table[bucket, row.index(0)] = fingerprint
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Remove one fingerprint; only digests that were inserted may be deleted."""
        fingerprint, first, second = self._places(digest)
        for bucket in (first, second):
            row = self.table[bucket].tolist()
            if fingerprint in row:
                self.table[bucket, row.index(fingerprint)] = 0
                return True
        return False


class CuckooIndex:
    """Live digests of one shard: the filter and the bucketed content that verifies its hits."""

    def __init__(self, buckets: int = 1024):
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, dict[bytes, list]] = {}  # bucket of stored keys -> digest -> [largest id, rows]
        self.resized = self.false_hits = self.size = 0

    def _bucket(self, digest: bytes) -> dict[bytes, list]:
        return self.content.setdefault(int.from_bytes(digest[18:21], "little"), {})

    def add(self, digest: bytes, doc_id: int | None, rows: int = 1) -> None:
        """Count ``rows`` more copies of a digest, the largest id among them being ``doc_id``."""
        bucket = self._bucket(digest)
        if digest in self.filter:
            entry = bucket.get(digest)
            if entry is not None:
                entry[1] += rows
                if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                    entry[0] = doc_id
                return
            self.false_hits += 1
        bucket[digest] = [doc_id, rows]
        self.size += 1
        if not self.filter.insert(digest):
            self._resize()

    def remove(self, digest: bytes) -> bool:
        """Delete a live digest from filter and content; False if it is not live."""
        bucket = self._bucket(digest)
        if digest not in self.filter or digest not in bucket:
            return False
        del bucket[digest]
        self.size -= 1
        return self.filter.delete(digest)

    def _resize(self) -> None:
        buckets, full = self.filter.mask + 1, True
        while full:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            full = not all(self.filter.insert(d) for bucket in self.content.values() for d in bucket)
        self.resized += 1

    def items(self):
        for bucket in self.content.values():
            for digest, (doc_id, rows) in bucket.items():
                yield digest, doc_id, rows


def text_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` (SHA-256, binary) of each row's normalised text; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            digests = [hashlib.sha256((t or b"").lower()).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["doc_id", "digest"])

    # bytes.lower() changes A-Z only
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text")
    return rows.mapInArrow(run, "doc_id long, digest binary")


def _shards(rows: int) -> int:
    return max(1, -(-rows // SHARD_ROWS))


def build_index(digests: DataFrame) -> DataFrame:
    """The index over ``doc_id, digest`` rows (a written table, since its rows are counted first): ``digest, keep_id, group_size``, built shard by shard."""

    def combine(batches):
        for batch in batches:
            seen: dict[bytes, list] = {}
            for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entry = seen.setdefault(digest, [doc_id, 0])
                entry[1] += 1
                if doc_id is not None and (entry[0] is None or doc_id > entry[0]):
                    entry[0] = doc_id
            yield _rows([(d, i, n) for d, (i, n) in seen.items()])

    def shard(batches):
        index = CuckooIndex()
        for batch in batches:
            for digest, doc_id, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                index.add(digest, doc_id, rows)
        found, items = [], index.items()
        for item in items:
            found.append(item)
            if len(found) == 10_000:
                yield _rows(found)
                found = []
        yield _rows(found)

    schema = "digest binary, keep_id long, group_size long"
    return digests.select("doc_id", "digest").mapInArrow(combine, schema).repartition(_shards(digests.count()), "digest").mapInArrow(shard, schema)


def update_index(index: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Apply deletions (``digest``), then additions (``doc_id, digest``), to an index (written tables); returns the new index."""

    def shard(batches):
        live = CuckooIndex()
        for batch in batches:  # an index row comes before changes to it: rows are sorted by step
            for step, digest, doc_id, rows in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if step == 1:
                    live.remove(digest)
                else:
                    live.add(digest, doc_id, rows)
        later = list(live.items())
        for i in range(0, len(later) or 1, 10_000):
            yield _rows(later[i : i + 10_000])

    steps = (
        index.select(F.lit(0).alias("step"), "digest", F.col("keep_id").alias("doc_id"), F.col("group_size").alias("n"))
        .unionByName(deleted.select(F.lit(1).alias("step"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n")))
        .unionByName(added.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")).withColumn("step", F.lit(2)))
        .select("step", "digest", "doc_id", "n")
    )
    return steps.repartition(_shards(index.count() + added.count()), "digest").sortWithinPartitions("digest", "step").mapInArrow(shard, "digest binary, keep_id long, group_size long")


def _rows(items: list[tuple]) -> pa.RecordBatch:
    digests, ids, counts = zip(*items) if items else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["digest", "keep_id", "group_size"]
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Digests are written once to the shared folder (72 bytes a row), so texts are read and hashed once;
    the join back carries ids and digests only, and Spark splits a hot digest's rows.
    """
    digests = written(text_digests(docs), "digests")
    return digests.join(build_index(digests), "digest").coalesce(files_for(digests)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, that stay (see :func:`exact_duplicates`), one for each text.

    The anti-join is on ``doc_id`` and the row's digest, so a repeated ``doc_id`` with another text is another row.  Rows that
    repeat both (or have null ids only) are looked for among ids and digests; texts are shuffled for them only if there are any.
    """
    found = written(exact_duplicates(docs).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "found")
    marked = docs.withColumn("_own_sha", F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    same = lambda other: F.col("doc_id").eqNullSafe(other["_id"]) & (F.col("_own_sha") == other["_sha"])
    gone = found.where("not kept").select("_id", "_sha")
    rest = marked.join(gone, same(gone), "left_anti")
    repeated = written(found.where("kept").groupBy("_id", "_sha").count().where(F.col("count") > 1).select("_id", "_sha"), "repeated", files_for(found))
    if not repeated.isEmpty():
        once = rest.join(repeated, same(repeated), "left_semi").dropDuplicates(["_own_sha"])
        rest = rest.join(repeated, same(repeated), "left_anti").unionByName(once)
    return rest.select(*docs.columns)


def ascii_lower(column):
    """Lower case of A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())
