"""MinHash near-duplicate detection.

A document's set holds the hashes of its distinct five-word shingles.  Documents with equal sets form a
class at once.  Many universal hash functions give minima; bands of them name buckets, and signatures
verify candidates before the sets themselves are compared exactly: set sizes, a two-bit sketch of the
minima, and a parity sketch of the whole set, whose differing bits are never more than differing shingles.

Within a bucket, classes are compared with pivots only.  The first round pairs each class with the first
pivot of each of its buckets, each pair once, so its rows are in proportion to the classes.  Then links
are confirmed and components found (by alternating large-star and small-star), and only buckets that
still hold several components go on, with few pivots at first and more from round to round, until every
class of an open bucket has been a pivot.  So each candidate pair is tested unless its two ends are
already connected, and a large group of copies costs a few rows per class.  What stays quadratic is the
cheap test of those classes of one bucket that are never connected: each could be linked with any other.

Words are runs of bytes other than ASCII white space; A-Z are lower-cased.  Shingles and sets are held
as 64-bit hashes (a chance of about 1e-11 per pair of long documents that one of them collides).

Defined results: null, empty or blank text has an empty set and is linked with nothing; a text of
fewer than five words is one shingle; rows sharing a ``doc_id`` are one node, linked by any of their
texts; a null ``doc_id`` is linked with nothing, has a null ``component_id`` and is kept; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._base import discard, files_for, worker_state, written
from eventloom.llm.components import oriented, spread, stars

WORDS = 5
SKETCHED = 128
#: Distinct words whose hashes a worker remembers before it starts afresh.
MEMO_WORDS = 200_000
PARITY_BITS = 256
#: Cheap tests per row of open buckets in the round after the first, and in each later one.
FIRST_TESTS = 16
PER_ROUND = 1024
#: Sets that a task remembers to skip repeated rows.
MEMO_SETS = 50_000
SKETCH = ("s0", "s1", "s2", "s3", "o0", "o1", "o2", "o3")
_BLOCK = 1024


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and minima per band so that fewer than one in a million pairs at the threshold share no bucket."""
    similarity = percent / 100
    rows = 5 if similarity >= 0.84 else 4 if similarity >= 0.78 else 3
    return math.ceil(math.log(1e-6) / math.log(1 - similarity**rows)), rows


def sketch_limit(percent: int) -> int:
    """Differing two-bit cells allowed among 128: six standard deviations above what the threshold expects."""
    differ = (1 - percent / 100) * 0.75
    return math.ceil(SKETCHED * differ + 6 * math.sqrt(SKETCHED * differ * (1 - differ)))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets, minima, bands and sketches of texts."""

    def __init__(self, percent: int):
        bands, rows = bands_for(percent)
        rng = np.random.default_rng(20240501)
        draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
        self.hashes = _Words()
        self.powers = draw(WORDS) | np.uint64(1)
        self.bands, self.rows = bands, rows
        count = max(bands * rows, SKETCHED)
        self.a, self.b = draw(count) | np.uint64(1), draw(count)
        self.weights, self.salt = draw(rows) | np.uint64(1), draw(bands)

    def set_of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = len(h)
        if n == 0:
            return h
        if n < WORDS:
            return _mix((_mix(h + np.uint64(n)) * self.powers[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        total = h[: n - WORDS + 1] * self.powers[0]
        for i in range(1, WORDS):
            total += h[i : n - WORDS + 1 + i] * self.powers[i]
        return np.unique(_mix(total))

    def features(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket names (one per band, as int64) and the signature (eight int64, see ``SKETCH``)."""
        least = np.full(len(self.a), 2**64 - 1, np.uint64)
        for i in range(0, len(values), _BLOCK):
            table = np.multiply.outer(self.a, values[i : i + _BLOCK])
            table += self.b[:, None]
            np.minimum(least, table.min(axis=1), out=least)
        banded = least[: self.bands * self.rows].reshape(self.bands, self.rows)
        buckets = _mix((_mix(banded) * self.weights).sum(axis=1, dtype=np.uint64) + self.salt)
        two = (_mix(least[:SKETCHED]) >> np.uint64(62)).astype(np.uint8)
        planes = np.packbits(np.stack([two & 1, two >> 1]), axis=1)
        odd = np.packbits((np.bincount((values & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8))
        return buckets.view(np.int64), np.concatenate([planes.view(np.int64).ravel(), odd.view(np.int64)])


def _shingler(percent: int) -> Shingler:
    return worker_state(("near_dedup", percent), lambda: Shingler(percent))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text")


def shingle_features(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, digest, h, n, again, buckets`` and the signature per row, in one pass; an empty set has null digest and no buckets.

    ``h``, the first half of the digest, names the class of documents with this set; ``again`` marks most of the
    rows that repeat an id and its set, so that a row repeated without end is not shuffled again and again.
    """

    def run(batches):
        shingler, seen = _shingler(percent), set()
        for batch in batches:
            digests, sizes, buckets, sketches, again = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = shingler.set_of(text)
                sizes.append(len(values))
                if len(values):
                    bands, sketch = shingler.features(values)
                    digests.append(_digest(values))
                    buckets.append(bands)
                    sketches.append(sketch)
                else:
                    digests.append(None)
                    buckets.append(np.zeros(0, np.int64))
                    sketches.append(np.zeros(len(SKETCH), np.int64))
                if len(seen) >= MEMO_SETS:
                    seen.clear()
                again.append((doc_id, digests[-1]) in seen)
                seen.add((doc_id, digests[-1]))
            cells = np.array(sketches, np.int64).reshape(-1, len(SKETCH)).T
            names = pa.array([d and _name(d) for d in digests], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), names, pa.array(sizes, pa.int64()), pa.array(again, pa.bool_()), pa.array(buckets, pa.list_(pa.int64())), *(pa.array(c) for c in cells)],
                ["doc_id", "digest", "h", "n", "again", "buckets", *SKETCH],
            )

    schema = "doc_id long, digest binary, h long, n long, again boolean, buckets array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    return _rows(docs).mapInArrow(run, schema)


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _name(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def shingle_sets(docs: DataFrame, percent: int) -> DataFrame:
    """``h, node, values``: class, id and whole set, packed, of each row; neighbouring rows with the same id and set give one."""

    def run(batches):
        shingler = _shingler(percent)
        before, seen = None, set()
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_id != before or len(seen) >= MEMO_SETS:
                    before, seen = doc_id, set()
                values = shingler.set_of(text)
                name = _name(_digest(values))
                if len(values) and name not in seen:
                    seen.add(name)
                    out.append((name, doc_id, values.tobytes()))
            names, nodes, packed = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["h", "node", "values"])

    return _rows(docs).mapInArrow(run, "h long, node long, values binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between nodes, of those pairs of classes ``a, b`` whose whole sets reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("h").alias("a"), F.col("node").alias("u"), F.col("values").alias("x"))
    right = sets.select(F.col("h").alias("b"), F.col("node").alias("v"), F.col("values").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("u", "v", "x", "y").mapInArrow(run, "a long, b long")


def _alike(percent: int) -> str:
    """The test on sizes and signatures that every pair at the threshold passes (but for six standard deviations)."""
    differing = "bit_count((s0 ^ p_s0) | (s2 ^ p_s2)) + bit_count((s1 ^ p_s1) | (s3 ^ p_s3))"
    odd = " + ".join(f"bit_count(o{i} ^ p_o{i})" for i in range(4))
    return (
        f"100 * least(n, p_n) >= {percent} * greatest(n, p_n)"
        f" and {100 + percent} * ({odd}) <= {100 - percent} * (n + p_n) and {differing} <= {sketch_limit(percent)}"
    )


def _pivot(frame: DataFrame, *names: str) -> DataFrame:
    return frame.select(*(F.col(c).alias(f"p_{c}") for c in (*names, "n", *SKETCH)))


def _crowded(own: DataFrame, files: int) -> DataFrame:
    """``bucket, size, least, h, rep`` of each class in a bucket with two classes at least; ``least`` is the bucket's first pivot."""
    dealt = own.select(F.explode("buckets").alias("bucket"), "h", "rep")
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size"), F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").drop("most")
    return written(dealt.join(spread(sizes, "bucket"), "bucket"), "crowded", files)


def _first_pairs(crowded: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of a class and the first pivot of one of its buckets, each once, that sizes and signatures allow."""
    pairs = crowded.where("h <> least").select("h", F.col("least").alias("p_h")).distinct()
    joined = spread(pairs, "h").join(own.select("h", "n", *SKETCH), "h").join(_pivot(own, "h"), "p_h")
    return joined.where(_alike(percent)).select(F.col("h").alias("a"), F.col("p_h").alias("b"))


def _open(rows: DataFrame, labels: DataFrame, own: DataFrame, files: int) -> DataFrame:
    """Rows of the buckets that still hold several components, with ``level, component, n`` and the signature.

    Level 0 is the class with the smallest name; the others follow in levels of about 1, 2, 4, ... pivots.
    """
    labelled = rows.select("bucket", "size", "least", "h", "rep").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other")
    level = F.when(F.col("h") == F.col("least"), 0).otherwise(1 + F.floor(F.log2(1 + (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("size"))))
    still = labelled.join(spread(mixed, "bucket"), "bucket", "left_semi").withColumn("level", level.cast("int"))
    return written(still.join(own.select("h", "n", *SKETCH), "h"), "open", files)


def _pairs(rows: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes of different components, one of them a pivot of levels low to high, that sizes and signatures allow."""
    pivot = _pivot(rows.where(F.col("level").between(low, high)), "bucket", "level", "h", "component")
    allowed = F.expr(f"component <> p_component and (level > p_level or (level = p_level and h < p_h)) and {_alike(percent)}")
    joined = rows.where(F.col("level") >= low).join(pivot, (F.col("bucket") == F.col("p_bucket")) & allowed)
    return joined.select(F.col("h").alias("a"), F.col("p_h").alias("b")).distinct()


def _next_levels(rows: DataFrame, low: int, tests: int) -> tuple[int, bool] | None:
    """The last level of the next round, which has as many levels as ``tests`` cheap tests per row allow, but one at least, and whether none is left after it; None if none is left now."""
    work = {r["level"]: r for r in rows.groupBy("level").agg(F.sum("size").alias("work"), F.count("*").alias("rows")).collect()}  # one row per level, at most 65
    left = sorted(level for level in work if level >= low)
    if not left:
        return None
    budget = tests * sum(r["rows"] for r in work.values())
    high = left[0]
    for level in left:
        budget -= work[level]["work"]
        if budget < 0:
            break
        high = level
    return high, high == left[-1]


def _labels(links: DataFrame) -> DataFrame:
    """``rep, component``: the smallest node that each linked node points at."""
    return spread(links.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("component")), "rep")


def _repeated_ids(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` that make rows with one ``doc_id`` and different sets one node."""
    sets = F.coalesce("digest", F.lit(b""))
    several = features.where("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("one"), F.max(sets).alias("other")).where("one <> other")
    rows = features.select("doc_id", "digest").where("digest is not null").join(spread(several.select("doc_id"), "doc_id"), "doc_id", "left_semi")
    return rows.join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets;
    ``component_id`` is the smallest id reachable.  Only band names, sketches and ids are shuffled for all
    documents; texts only once, to collect the sets of those that share a bucket.
    """
    features = written(shingle_features(docs, percent), "features")
    files = files_for(features)
    classes = written(features.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps", files)
    once = features.where("not again")
    first = once.join(classes, (once["doc_id"] == classes["rep"]) & (once["digest"] == classes["digest"]), "left_semi").dropDuplicates(["doc_id", "digest"])
    own = written(first.select(F.col("doc_id").alias("rep"), "h", "n", *SKETCH, "buckets"), "classes", files)
    crowded = _crowded(own, files)
    # always a merge join: the ids grow with the documents, and the plan should be the same at every size
    shared = crowded.select("rep").distinct()
    needed = docs.join(shared.hint("merge"), docs["doc_id"] == shared["rep"], "left_semi")
    sets = written(shingle_sets(needed, percent), "sets")  # not gathered: its tasks read texts
    links, current, low, tests, done = oriented(_repeated_ids(features, classes)), crowded, 1, FIRST_TESTS, False
    pairs = _first_pairs(crowded, own, percent)
    while True:
        before, links = links, stars(written(oriented(confirmed(pairs, sets, percent).union(links.select("u", "v"))), "links", files), files)
        discard(before)
        if done:
            break
        before, current = current, _open(current, _labels(links), own, files)
        discard(before)
        following = _next_levels(current, low, tests)
        if following is None:
            break
        high, done = following
        pairs = _pairs(current, low, high, percent)
        low, tests = high + 1, PER_ROUND
    discard(own, sets, current)
    rows = features.select("doc_id", "digest", F.col("n").alias("n_shingles")).join(classes, "digest", "left")
    rows = rows.withColumn("rep", F.coalesce("rep", "doc_id")).join(_labels(links), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return rows.coalesce(files).select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose document is the smallest id of its component."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
