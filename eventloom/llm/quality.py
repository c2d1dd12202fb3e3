"""Quality classifier from weak labels.

Overlapping heuristics each vote good, bad or nothing on a text.  What is bad comes in kinds (noise of symbols,
shouting, repetition), and a heuristic is written for one of them but may be set off by others.  Expectation-maximisation
over the counts of vote patterns of all texts estimates how many texts are good or of each kind, and how each
heuristic votes on each (Dawid and Skene's model); nothing about these accuracies is set beforehand but where to start.  That
gives a posterior for every pattern.  The posteriors of a bounded sample train a linear scorer on hashed word shapes,
which scores all texts.

Defined results: a text without words (null, empty, blank) scores 0 and is not kept; repeated rows score
alike; a table without texts is scored by the prior (0.5, kept); a null ``doc_id`` stays null; extra
columns are ignored, and carried along by :func:`keep_good`.
"""

from __future__ import annotations

import math
import operator
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._base import worker_state

#: Texts that the scorer is trained on, in expectation.
SAMPLE = 4000
#: Hash buckets of word shapes; the last place counts words equal to the one before.
BUCKETS = 512
#: Scores from here on are kept.
THRESHOLD = 0.5
MEMO_WORDS = 200_000
GOOD, BAD, NONE = 0, 1, 2

#: What a text can be, and the kind of bad text that each heuristic is written for.
KINDS = ("good", "noise", "shouting", "repetition")
WRITTEN_FOR = ("noise", "noise", "noise", "shouting", "shouting", "shouting", "repetition", "repetition", "repetition")

_SYMBOLS = b"#$%&*!|<>{}[]\\^~=_+@"
#: Runs of symbols beside words.
_MARKS = (b"$$", b"##", b"%%", b"&&", b"**", b"@@", b"==", b"~~", b"__", b" | ")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def _vote(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    return GOOD if good[0] <= value <= good[1] else BAD if value < bad[0] or value > bad[1] else NONE


def votes(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """Votes of the heuristics, in the order of ``WRITTEN_FOR``, on a text and its words (split at ASCII white space)."""
    n, size = len(words), len(text)
    if not n:
        return (NONE,) * len(WRITTEN_FOR)
    upper, lower = size - len(text.translate(None, _UPPER)), size - len(text.translate(None, _LOWER))
    symbols = size - len(text.translate(None, _SYMBOLS))
    marked = sum(text.count(mark) for mark in _MARKS)
    called = text.count(b"!!") + text.count(b"?!") + text.count(b"??")
    distinct = set(words)
    shouted = sum(1 for w in words if len(w) > 2 and w.isupper()) if upper else 0
    repeated = sum(map(operator.eq, words, words[1:]))
    length = (size - n + 1) / n
    return (
        _vote(symbols / size, (0, 0.01), (0, 0.04)),
        _vote(marked / n, (0, 0.03), (0, 0.15)) if n >= 3 else NONE,
        _vote(length, (3.5, 10), (2.5, 15)) if n >= 10 else NONE,
        _vote(upper / max(1, upper + lower), (0, 0.2), (0, 0.5)) if upper + lower >= 20 else NONE,
        _vote(shouted / n, (0, 0.1), (0, 0.3)) if n >= 5 else NONE,
        _vote(called / n, (0, 0.02), (0, 0.1)) if n >= 5 else NONE,
        _vote(repeated / n, (0, 0.02), (0, 0.2)) if n >= 10 else NONE,
        _vote(len(distinct) / n, (0.3, 1), (0.15, 1)) if 20 <= n <= 2000 else NONE,
        _vote(len(set(zip(words, words[1:]))) / n, (0.5, 1), (0.3, 1)) if 20 <= n <= 5000 else NONE,
    )


def shape(word: bytes) -> bytes:
    """Character classes of a word with runs shortened: ``Hello,`` is ``Aa,``."""
    out, last = bytearray(), 0
    for b in word:
        c = 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
        if c != last:
            out.append(c)
            last = c
    return bytes(out)


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        place = self[word] = zlib.crc32(shape(word)[:16]) % (BUCKETS - 1)
        return place


def vector(words: list[bytes], places: dict[bytes, int]) -> np.ndarray:
    """Shares of hashed shapes among a text's words, and of words equal to the one before."""
    counts = np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=BUCKETS).astype(np.float64)
    counts[-1] = sum(map(operator.eq, words, words[1:]))
    return np.sqrt(counts / max(1, len(words)))


@dataclass(frozen=True)
class QualityModel:
    """What :func:`fit` learns: weights of the scorer, and the vote model it came from."""

    weights: np.ndarray
    bias: float
    shares: np.ndarray  # of the kinds of texts
    accuracies: np.ndarray  # [heuristic, kind, vote]
    posteriors: dict[tuple[int, ...], float]


def _start(votes_of: np.ndarray) -> np.ndarray:
    """Where the estimation starts: a text without a bad vote is likely good, another one of the kinds that its bad votes were written for."""
    said = np.stack([(votes_of == BAD)[:, [w == kind for w in WRITTEN_FOR]].mean(axis=1) for kind in KINDS[1:]])
    bad = np.where(said.sum(axis=0) > 0, 0.8, 0.1)
    shares = (said + 0.01) / (said + 0.01).sum(axis=0)
    return np.concatenate([[1 - bad], bad * shares])


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 300) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, ...], float]]:
    """Shares of the kinds, probabilities ``[heuristic, kind, vote]`` of votes cast, and posterior of good per pattern."""
    keys = sorted(patterns)
    votes_of = np.array(keys)
    counts = np.array([patterns[k] for k in keys], float)
    belief = _start(votes_of)
    one_hot = np.eye(3)[votes_of][:, :, :NONE]  # an abstention says nothing about the text
    for _ in range(rounds):
        weights = belief * counts
        shares = (weights.sum(axis=1) + 1) / (counts.sum() + len(KINDS))
        table = np.einsum("cp,phv->hcv", weights, one_hot) + 1  # one vote of each sort, so that none is impossible
        table /= table.sum(axis=2, keepdims=True)
        joint = np.log(shares)[:, None] + np.einsum("phv,hcv->cp", one_hot, np.log(table))
        now = np.exp(joint - joint.max(axis=0))
        now /= now.sum(axis=0)
        if np.abs(now - belief).max() < 1e-9:
            break
        belief = now
    return shares, table, dict(zip(keys, belief[0].tolist()))


def train_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text")


def fit(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Votes of all texts, then the scorer from about ``sample`` of them chosen by a hash of id and text.

    The driver gets at most 3**9 pattern counts and the sample's vectors.
    """

    def count(batches):
        found: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if text and (words := text.split()):
                    key = bytes(votes(text, words))
                    found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["votes", "n"])

    rows = _texts(docs)
    counted = rows.mapInArrow(count, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = {tuple(r["votes"]): r["n"] for r in counted}
    if not patterns:
        return QualityModel(np.zeros(BUCKETS), 0.0, np.full(len(KINDS), 1 / len(KINDS)), np.full((len(WRITTEN_FOR), len(KINDS), 2), 1 / 2), {})
    shares, table, posteriors = expectation_maximisation(patterns)
    share = min(1.0, sample / sum(patterns.values()))

    def draw(batches):
        places = worker_state("quality", _Places)
        for batch in batches:
            keys, vectors = [], []
            for text in batch.column(1).to_pylist():
                if text and (words := text.split()):
                    keys.append(bytes(votes(text, words)))
                    vectors.append(vector(words, places).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["votes", "x"])

    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    taken = sorted((tuple(r["votes"]), bytes(r["x"])) for r in drawn.mapInArrow(draw, "votes binary, x binary").collect())
    if not taken:
        return QualityModel(np.zeros(BUCKETS), math.log(shares[0] / (1 - shares[0])), shares, table, posteriors)
    x = np.frombuffer(b"".join(t[1] for t in taken), np.float32).reshape(-1, BUCKETS).astype(float)
    weights, bias = train_scorer(x, np.array([posteriors[t[0]] for t in taken]))
    return QualityModel(weights, bias, shares, table, posteriors)


class _Scorer:
    def __init__(self, model: QualityModel):
        self.model, self.places = model, _Places()

    def score(self, text: bytes | None) -> float:
        words = (text or b"").split()
        if not words:
            return 0.0
        logit = float(vector(words, self.places) @ self.model.weights) + self.model.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id, score`` (probability of good) and ``kept``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        scorer = worker_state(("quality", key), lambda: _Scorer(shared.value))
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())], ["doc_id", "score", "kept"]
            )

    return _texts(docs).mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores at least ``threshold``; no shuffle."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches):
        scorer = worker_state(("quality", key), lambda: _Scorer(shared.value))
        for batch in batches:
            texts = (t.encode("utf-8") if t else b"" for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([scorer.score(t) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
