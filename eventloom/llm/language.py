"""Language identification of mixed-language texts.

Words are scored by trigram log-probabilities per language.  The script of a word's letters narrows the
candidates to the languages that use it.  Viterbi with a switching penalty labels each word, so that a
text falls into spans; the language with the most letters is the prediction and its share of the letters
the score.  Texts in which no run of words gains half a penalty against the overall best language cannot
hold a switch, and need no trellis; the trellises of the others in a batch are filled side by side.

The model is learnt from a bounded sample: about ``sample`` documents per language, chosen by a hash of
their id.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any learnt
language every text is ``und``; ties go to the language that sorts first; repeated rows are labelled
alike; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._base import worker_state

#: Documents per language that the model is learnt from, in expectation.
SAMPLE = 1000
#: Hash buckets of trigrams.
BUCKETS = 1 << 14
#: Cost, in nats, of a change of language between two words.
SWITCH = 24.0
#: A language uses a script if at least this share of its sample's letters is in it.
SCRIPT_SHARE = 0.001
UNLIKELY = -1000.0
#: Distinct words whose scores a worker remembers, and words scored at a time.
MEMO_WORDS = 300_000
BLOCK = 50_000
#: Words of texts whose trellises are filled side by side.
TRELLIS_WORDS = 200_000

# First and last code point of scripts' main ranges.
SCRIPT_RANGES = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF),
    ("tibetan", 0xF00, 0xFFF), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


SCRIPTS = sorted({name for name, _, _ in SCRIPT_RANGES} | {"other"})
_RANGES = sorted(SCRIPT_RANGES, key=lambda r: r[1])
_FIRSTS, _LASTS = (np.array([r[k] for r in _RANGES], np.uint32) for k in (1, 2))
_PLACES = np.array([SCRIPTS.index(r[0]) for r in _RANGES])


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Numbers in ``SCRIPTS`` of the scripts of code points; ``other`` outside the listed ranges."""
    at = np.maximum(np.searchsorted(_FIRSTS, points, "right") - 1, 0)
    return np.where((points >= _FIRSTS[at]) & (points <= _LASTS[at]), _PLACES[at], SCRIPTS.index("other"))


def letters_of(word: str) -> str:
    """The word's letters in lower case."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of the trigrams of words (letters only, none empty) with their ends marked, the place of each word's first, and the scripts of the first letters.

    Two places after each word's trigrams hold ``BUCKETS``, which stands for none.
    """
    points = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    x = points.astype(np.uint64)
    mixed = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)) ^ (x[1:-1] << np.uint64(17))
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    buckets = np.full(len(points), BUCKETS)
    buckets[:-2] = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
    for k in range(2):
        buckets[starts + sizes + k] = BUCKETS
    return buckets, starts, scripts_of(points[starts + 1])


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of trigram buckets (rows) per language (columns), and the scripts of each language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    scripts: dict[str, np.ndarray]  # of SCRIPTS: script -> True for each language that uses it


def learn(docs: DataFrame, usable, sample: int = SAMPLE) -> LanguageModel:
    """Learn from rows of ``docs`` (``doc_id, text, lang``) for which the Column ``usable`` holds.

    The driver gets one row per language and at most ``BUCKETS`` counts for each.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0)), {})
    share = F.create_map(*(x for name in languages for x in (F.lit(name), F.lit(sample / sizes[name]))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches):
        grams: Counter = Counter()
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(text.split())
            for lang, counted in words.items():
                lettered = [(x, n) for word, n in counted.items() if (x := letters_of(word))]
                if not lettered:
                    continue
                spelt, times = [x for x, _ in lettered], np.array([n for _, n in lettered])
                buckets, _, scripts = trigrams(spelt)
                sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
                found = np.bincount(buckets, np.repeat(times, sizes + 2), BUCKETS + 1)[:BUCKETS]
                for bucket in np.flatnonzero(found).tolist():
                    grams[lang, "", bucket] += int(found[bucket])
                spread = np.bincount(scripts, sizes * times, len(SCRIPTS))
                for i in np.flatnonzero(spread).tolist():
                    grams[lang, SCRIPTS[i], -1] += int(spread[i])
        keys = list(grams)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))), pa.array([grams[k] for k in keys], pa.int64())],
            ["lang", "script", "bucket", "n"],
        )

    counted = drawn.select("lang", "text").mapInArrow(count, "lang string, script string, bucket long, n long")
    counts = np.full((BUCKETS, len(languages)), 0.5)
    letters: dict[str, np.ndarray] = {}
    place = {name: i for i, name in enumerate(languages)}
    for r in counted.groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] >= 0:
            counts[r["bucket"], place[r["lang"]]] += r["n"]
        else:
            letters.setdefault(r["script"], np.zeros(len(languages)))[place[r["lang"]]] += r["n"]
    total = sum(letters.values(), np.zeros(len(languages))) + 1e-9
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)), {s: n / total >= SCRIPT_SHARE for s, n in letters.items()})


class Labeller:
    """Labels words of texts under a model."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.weights = np.vstack([model.weights, np.zeros((1, len(model.languages)))])  # the last row is for no trigram
        #: What a script adds to a word's scores: languages that do not use it are out, unless none does.
        self.narrowed = np.zeros((len(SCRIPTS), len(model.languages)))
        for i, script in enumerate(SCRIPTS):
            uses = model.scripts.get(script)
            if uses is not None and uses.any():
                self.narrowed[i, ~uses] = UNLIKELY
        self._fresh()

    def _fresh(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((MEMO_WORDS, len(self.model.languages)))
        self.letters = np.zeros(MEMO_WORDS, np.int64)

    def _learn_words(self, words: list[str]) -> None:
        if len(self.place) + len(words) > MEMO_WORDS:
            self._fresh()
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if not new:
            return
        first, spelt = len(self.place), list(map(letters_of, new))
        there = np.array([i for i, x in enumerate(spelt) if x], np.int64)
        self.scores[first : first + len(new)] = 0
        if len(there):
            buckets, starts, scripts = trigrams([spelt[i] for i in there])
            self.scores[first + there] = np.add.reduceat(self.weights[buckets], starts, axis=0) + self.narrowed[scripts]
        self.letters[first : first + len(new)] = np.fromiter(map(len, spelt), np.int64, len(new))
        self.place.update(zip(new, range(first, first + len(new))))

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words by languages) and letters of each word."""
        words, parts = text.split(), []
        for i in range(0, len(words), BLOCK):
            block = words[i : i + BLOCK]
            self._learn_words(block)
            at = np.fromiter(map(self.place.__getitem__, block), np.int64, len(block))
            parts.append((self.scores[at], self.letters[at]))
        if not parts:
            return np.zeros((0, len(self.model.languages))), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Language number of each word, and its letters, of each text."""
        out, open_, size = [], [], 0
        for text in texts:
            scores, letters = self.words(text or "")
            if not len(scores) or not self.model.languages:
                out.append((np.zeros(len(scores), np.int64), letters))
                continue
            best = int(scores.sum(axis=0).argmax())
            gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
            lowest = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
            out.append((np.full(len(scores), best), letters))
            if (gain[0] > SWITCH / 2).any() or (gain[1:] - lowest[:-1] > SWITCH / 2).any():
                open_.append((len(out) - 1, scores))
                size += len(scores)
            if size > TRELLIS_WORDS:
                self._fill(out, open_)
                open_, size = [], 0
        self._fill(out, open_)
        return out

    @staticmethod
    def _fill(out: list, open_: list) -> None:
        for (i, _), path in zip(open_, viterbi([scores for _, scores in open_])):
            out[i] = (path, out[i][1])


def viterbi(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Best paths of states under per-step scores and one penalty for any change, of several texts at once.

    Step by step all texts that have that many words move on together, the longest first.
    """
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    scores = np.concatenate([texts[i] for i in order])
    own = np.arange(scores.shape[1], dtype=np.int32)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]))  # texts longer than t words
    value, ends, backs = scores[offsets].copy(), np.zeros(len(texts), np.int64), []
    for t in range(1, int(lengths[0])):
        k, before = int(live[t]), len(value)
        if k < before:
            ends[k:before] = value[k:].argmax(axis=1)
            value = value[:k]
        top = value.argmax(axis=1)
        switched = (value[np.arange(k), top] - SWITCH)[:, None]
        change = switched > value
        backs.append(np.where(change, top[:, None].astype(np.int32), own))
        value = np.where(change, switched, value) + scores[offsets[:k] + t]
    ends[: len(value)] = value.argmax(axis=1)
    paths = np.empty(len(scores), np.int64)
    state = ends.copy()
    for t in range(int(lengths[0]) - 1, 0, -1):
        k = int(live[t])
        paths[offsets[:k] + t] = state[:k]
        state[:k] = backs[t - 1][np.arange(k), state[:k]]
    paths[offsets] = state
    out: list = [None] * len(texts)
    for i, a, n in zip(order.tolist(), offsets.tolist(), lengths.tolist()):
        out[i] = paths[a : a + n]
    return out


SPANS = "doc_id long, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row of ``docs``: ``doc_id, lang_pred, score, spans``; a span gives its first and last word (from 0)."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # BUCKETS numbers per language

    def run(batches):
        labeller = worker_state(("language", key), lambda: Labeller(shared.value))
        names = labeller.model.languages
        for batch in batches:
            found, scores, spans = [], [], []
            for path, letters in labeller.label(batch.column(1).to_pylist()):
                total = letters.sum()
                if not total or not names:
                    found.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                by = np.bincount(path, letters, len(names))
                found.append(names[by.argmax()])
                scores.append(float(by.max() / total))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                spans.append([{"first": a, "last": b - 1, "lang": names[path[a]]} for a, b in zip(cuts, cuts[1:])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"]
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SPANS)


def held_out(doc_id="doc_id"):
    """The Column that is true for the fifth of the ids that nothing is learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
