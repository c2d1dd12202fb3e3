"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names become typed placeholders, everything else a lower-case literal.
Windows of ``WINDOW`` such tokens (with enough literals) of the benchmark are joined, by hash, with those of
the documents.  In an occurrence of an item in a document, every slot value of the item must map to one value in the
document; if so, all matched windows count, and otherwise only those with the benchmark's own values.
Occurrences are judged one by one, and all hits as one.
Windows with fewer literals, and all windows with placeholders, are joined verbatim (lower case, all words) as well.
Numbers with their unit ('5km') and names after a sentence that are names elsewhere in the text too are read both ways.
An item is found in a document if the counting windows of an occurrence together cover ``MIN_TOKENS`` tokens of it, or all
tokens of a shorter item; if its windows with enough literals cover fewer tokens than that, all of these suffice.

Defined results: null or empty texts and items match nothing; an item with fewer tokens than a window is
one window of its own length, and documents are read in windows of that length too; repeated rows are reported once per ``doc_id`` and text; a null
``doc_id`` is reported as null; extra columns are ignored by :func:`find_items`.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm._base import worker_state, written

WINDOW = 8
MIN_LITERALS = 5
MIN_TOKENS = 13
#: Benchmark windows up to which their hashes are broadcast (8 bytes each); beyond, all windows of the documents are joined.
BROADCAST_WINDOWS = 2_000_000
MEMO_WORDS = 200_000

# Units that become placeholders when they follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec ms min h hr hrs day days week weeks month months year years"
    " second seconds minute minutes hour hours meter meters metre metres kilometer kilometers mile miles foot feet inch inches"
    " gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros"
    " percent degrees mph kmh usd eur gbp".split()
)
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3

_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_QUANTITY = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*([^\W\d_]+)")
_EDGES = "\"'()[]{}<>.,;:!?*_`~“”‘’«»…-"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.array([0, *(xxhash.xxh64_intdigest(f"<{k}>") for k in ("number", "unit", "name"))], np.uint64)


class _Words(dict):
    """Numbers of distinct words, and what is known of each, by number: hash of the bare lower-case word, flags, hash that tells signs apart.

    Flags: 1 number, 2 unit, 4 capitalised, 8 ends a sentence, 16 number and unit in one.
    """

    def __init__(self):
        super().__init__()
        self.folded, self.exact, self.flags = (np.zeros(MEMO_WORDS, t) for t in (np.uint64, np.uint64, np.uint8))

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        if number == len(self.flags):  # a text of very many distinct words
            for name in ("folded", "exact", "flags"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        bare = word.strip(_EDGES)
        lower = bare.lower()
        flags = 8 * word.endswith((".", "!", "?", ":"))
        if bare != lower:
            flags |= 4 * (len(bare) > 1 and bare[0].isupper() and bare[1:].islower())
        if lower in UNITS:
            flags |= 2
        elif not bare.isalpha():
            if _NUMBER.fullmatch(bare):
                flags |= 1
            elif (m := _QUANTITY.fullmatch(bare)) and m[1].lower() in UNITS:
                flags |= 16
        folded = xxhash.xxh64_intdigest(lower)
        self.folded[number], self.flags[number] = folded, flags
        self.exact[number] = folded if bare else xxhash.xxh64_intdigest(word)
        return number


class Canoniser:
    """Canonical tokens of texts; remembers a bounded number of words, and those of one text."""

    def __init__(self, window: int = WINDOW):
        self.memo = _Words()
        rng = np.random.default_rng(7)
        self.powers = rng.integers(0, 2**63, window, dtype=np.uint64) | np.uint64(1)
        self.window = window

    def tokens(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Raw words, classes, wider classes, literal hashes, and hashes of all words for verbatim windows.

        In the wider classes, a number with its unit is a number, and a name that is one elsewhere is one after a sentence too.
        """
        if len(self.memo) >= MEMO_WORDS:
            self.memo = _Words()
        words = text.split()
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        hashes, flags, exact = self.memo.folded[at], self.memo.flags[at], self.memo.exact[at]
        before = np.concatenate([[8], flags[:-1]]) if len(words) else flags
        kinds = np.where((flags & 4 > 0) & (before & 8 == 0), NAME, LITERAL)
        kinds = np.where((flags & 2 > 0) & (before & 1 > 0), UNIT, kinds)
        kinds = np.where(flags & 1 > 0, NUMBER, kinds)
        wider = np.where(flags & 16 > 0, NUMBER, kinds)
        first = np.flatnonzero((kinds == LITERAL) & (flags & 4 > 0))
        if len(first):
            wider[first[np.isin(hashes[first], hashes[kinds == NAME])]] = NAME
        return words, kinds, wider, hashes, exact

    def windows(self, kinds: np.ndarray, wider: np.ndarray, hashes: np.ndarray, exact: np.ndarray, size: int) -> list[tuple]:
        """Starts and hashes of the windows of ``size`` tokens, whether they hold enough literals, and their classes if they are templates.

        Templates hold enough literals; where the wider classes differ, there is a template of these, too.  Any window whose words are not all literals is verbatim, too.
        """
        n = len(kinds)
        if not 0 < size <= n:
            return []
        literal = kinds == LITERAL
        rich = _within(literal, size) >= min(MIN_LITERALS, size)
        found = [(np.flatnonzero(rich), self._hashes(np.where(literal, hashes, _CLASS[kinds]), size)[rich], rich[rich], kinds)]
        changed = wider != kinds
        if changed.any():
            own = (_within(changed, size) > 0) & (_within(wider == LITERAL, size) >= min(MIN_LITERALS, size))
            found.append((np.flatnonzero(own), self._hashes(np.where(wider == LITERAL, hashes, _CLASS[wider]), size)[own], rich[own], wider))
        other = ~literal | (exact != hashes)
        if other.any():
            own = _within(other, size) > 0
            found.append((np.flatnonzero(own), self._hashes(exact, size)[own], rich[own], None))
        return found

    def _hashes(self, values: np.ndarray, size: int) -> np.ndarray:
        n = len(values)
        total = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            total += values[i : n - size + 1 + i] * self.powers[i]
        return (total ^ (total >> np.uint64(29))) * _MIX


def _within(flags: np.ndarray, size: int) -> np.ndarray:
    """How many flags are set in each window."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[size:] - sums[: len(flags) - size + 1]


def _slots(words: list[str], kinds: np.ndarray, start: int, size: int) -> list[str]:
    return [words[start + i].strip(_EDGES).lower() for i in np.flatnonzero(kinds[start : start + size]).tolist()]


_HITS = "key1 long, key2 long, start int, window long, slots array<string>, size int, rich boolean, wider boolean"


def _windows(rows: DataFrame, known=None, sizes: list[int] | None = None) -> DataFrame:
    """Windows of ``key1, key2, text`` rows, those in the broadcast sorted array ``known`` only if it is given.

    They have ``sizes`` tokens; by default ``WINDOW``, or as many as a shorter text has.
    """

    def run(batches):
        canoniser = worker_state("decontaminate", Canoniser)
        wanted = known.value if known else None
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key1, key2, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, *tokens = canoniser.tokens(text or "")
                for size in sizes or [min(WINDOW, len(words))]:
                    for starts, found, rich, classes in canoniser.windows(*tokens, size):
                        if wanted is not None:
                            if len(wanted):
                                at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                                hit = np.flatnonzero(wanted[at] == found)
                            else:
                                hit = np.zeros(0, np.int64)
                            starts, found, rich = starts[hit], found[hit], rich[hit]
                        for start, window, literals in zip(starts.tolist(), found.view(np.int64).tolist(), rich.tolist()):
                            slots = _slots(words, classes, start, size) if classes is not None else []
                            for column, value in zip(out, (key1, key2, start, window, slots, size, literals, classes is tokens[1])):
                                column.append(value)
                            if len(out[0]) >= 10_000:
                                yield _hits(out)
                                out = [[] for _ in range(8)]
            yield _hits(out)

    return rows.mapInArrow(run, _HITS)


def _hits(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key1", "key2", "start", "window", "slots", "size", "rich", "wider"])


def _counting(hits: list[dict]) -> tuple[int, int, bool]:
    """Tokens of the item that the counting windows cover, those that windows with enough literals cover, and whether some slot has another value."""
    values: dict[str, str] = {}
    clash = any(values.setdefault(a, b) != b for h in hits for a, b in zip(h["item_slots"], h["slots"]))
    counting = [h for h in hits if not clash or h["slots"] == h["item_slots"]]
    return _cover(counting), _cover(h for h in counting if h["rich"]), any(h["slots"] != h["item_slots"] for h in counting)


def _cover(hits) -> int:
    """Tokens of the item in the union of the hits' windows."""
    covered = upto = 0
    for first, size in sorted({(h["item_start"], h["size"]) for h in hits}):
        covered += max(0, first + size - max(first, upto))
        upto = max(upto, first + size)
    return covered


def _occurrences(hits: list[dict]):
    """The hits as one occurrence, and as several: of equal offset, in the item's order, and at near places.

    An occurrence may have words more or less than the item, and there may be chance hits between its own;
    so an item is found if it is found in any of these.
    """
    hits = sorted(hits, key=lambda h: (h["start"], h["item_start"]))
    if not hits:
        return
    yield hits
    offsets = sorted({h["start"] - h["item_start"] for h in hits})
    if len(offsets) == 1:
        return
    by_offset: dict[int, list[dict]] = {}
    for h in hits:
        by_offset.setdefault(h["start"] - h["item_start"], []).append(h)
    yield from by_offset.values()
    near: list[list[dict]] = []
    for before, offset in zip([None, *offsets], offsets):
        if before is None or offset - before > WINDOW:
            near.append([])
        near[-1].extend(by_offset[offset])
    yield from near
    run = hits[:1]
    for before, h in zip(hits, hits[1:]):
        if h["item_start"] < before["item_start"]:
            yield run
            run = []
        run.append(h)
    yield run


def _counted(found: DataFrame) -> DataFrame:
    """``covered`` and ``reparameterised`` of the occurrence that covers most, of items that are found."""

    def run(batches):
        for batch in batches:
            kept, covered, other = [], [], []
            for i, (tokens, hits, rich_tokens) in enumerate(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))):
                least, least_rich = min(MIN_TOKENS, tokens), min(MIN_TOKENS, rich_tokens or tokens)
                narrow = [h for h in hits if not h["wider"]]
                narrow = narrow if len(narrow) < len(hits) else []
                enough = [(n, not changed) for n, rich, changed in map(_counting, chain(_occurrences(hits), _occurrences(narrow))) if n >= least or rich >= least_rich]
                if enough:
                    most, unchanged = max(enough)
                    kept.append(i)
                    covered.append(most)
                    other.append(not unchanged)
            rows = batch.select([0, 1, 2, 3]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(covered, pa.int64()), pa.array(other, pa.bool_())], [*rows.schema.names, "covered", "reparameterised"])

    return found.mapInArrow(run, "doc_id long, text_key long, item_id long, tokens long, covered long, reparameterised boolean")


def _covers(windows: DataFrame) -> DataFrame:
    """``item_id, tokens, rich_tokens``: tokens that the windows of each item cover, and those that windows with enough literals cover."""
    each = windows.groupBy("item_id", "item_start").agg(F.max("size").alias("size"), F.max("rich").alias("rich"))
    at = Window.partitionBy("item_id").orderBy("item_start")
    gap = F.least("size", F.coalesce(F.lead("item_start").over(at) - F.col("item_start"), F.col("size")))
    rich = each.where("rich").withColumn("gap", gap).groupBy("item_id").agg(F.sum("gap").alias("rich_tokens"))
    return each.withColumn("gap", gap).groupBy("item_id").agg(F.sum("gap").alias("tokens")).join(rich, "item_id", "left").fillna(0, ["rich_tokens"])


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items found in documents: ``doc_id, text_key, item_id, covered, tokens, reparameterised``.

    ``covered`` of the item's ``tokens`` count; ``reparameterised`` tells that some slot has another value.
    One pass over the texts; only hits are shuffled, and as many rows as there are windows of items with the hash of a document's window.
    """
    spark = docs.sparkSession
    items = benchmark.selectExpr("cast(item_id as bigint) key1", "xxhash64(text) key2", "text").distinct()
    known = written(_windows(items).withColumnsRenamed({"key1": "item_id", "start": "item_start", "slots": "item_slots", "wider": "item_wider"}).drop("key2"), "benchmark")
    count = known.count()
    sizes = sorted({WINDOW, *(r["size"] for r in known.select("size").distinct().collect())})  # at most WINDOW of them
    texts = docs.selectExpr("cast(doc_id as bigint) key1", "xxhash64(text) key2", "text")
    if count <= BROADCAST_WINDOWS:
        sorted_windows = np.unique(np.array([r["window"] for r in known.select("window").distinct().toLocalIterator()], np.int64).view(np.uint64))
        hits = _windows(texts, spark.sparkContext.broadcast(sorted_windows), sizes)
    else:
        hits = _windows(texts, sizes=sizes)
    keys = ["doc_id", "text_key", "item_id"]
    hits = hits.drop("rich", "size").join(known, "window").withColumnsRenamed({"key1": "doc_id", "key2": "text_key"})
    hit = F.struct("start", "item_start", "size", "slots", "item_slots", "rich", F.expr("wider or item_wider").alias("wider"))
    found = hits.groupBy(*keys).agg(F.collect_set(hit).alias("hits")).join(_covers(known), "item_id")
    return _counted(found.select(*keys, "tokens", "hits", "rich_tokens")).select(*keys, "covered", "tokens", "reparameterised")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, in which no item of the benchmark is found."""
    gone = find_items(docs, benchmark).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    own = F.xxhash64(docs["text"])
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (own == gone["_gone_key"]), "left_anti")
