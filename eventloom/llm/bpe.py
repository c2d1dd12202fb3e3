"""BPE encoding and decoding by tree concatenation.

Two trees, both exact, whose leaves are encoded in parallel by the tokenizers library's threads (Spark tasks share out the texts):

* A long text is cut into leaves of equal size, each encoded on its own.  At each join the words around it are
  encoded again in a window that doubles until its first word equals the left side's and its last
  word equals the right side's.  The scanner keeps no state across a word boundary, so from an
  agreed boundary on both scans are the same.
* A long word that the pre-tokenizer does not split is cut in the same manner; leaves are
  merged on their own, and tokens around a join are merged again in a doubling window until both
  sides agree.  A sequence of tokens is the BPE encoding of its text exactly if every two
  neighbours encode to themselves; inside the window they do by construction, and at its two ends
  the agreed tokens have the neighbours that they had before.

Short texts are cut into words, whose ids are remembered.

Defined results: null text is empty (no ids, empty decoded text); a null ``doc_id`` stays null;
repeated rows are encoded one by one; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Encoding, Tokenizer

from eventloom.llm._base import worker_state
from eventloom.llm.pretokens import OUTSIDE_FAST, WORD_PIECES, byte_level

#: Characters of a leaf of the text tree (texts of up to two leaves are not cut), symbols of a leaf of the word tree.
LEAF_CHARS = 32768
LEAF_SYMBOLS = 128
#: Distinct short pieces that a worker remembers before it starts afresh.
MEMO_ENTRIES = 400_000
MEMO_PIECE_CHARS = 64

SCHEMA = "doc_id long, ids binary, decoded string"
Word = tuple[int, int, bytes]
_BARE = {"added_tokens": [], "normalizer": None, "post_processor": None, "truncation": None, "padding": None}


class BpeCodec:
    """Encodes and decodes as the tokenizers library does for a BPE file with word-end marks."""

    def __init__(self, tokenizer_json: str, leaf_chars: int = LEAF_CHARS, leaf_symbols: int = LEAF_SYMBOLS):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        model = json.loads(tokenizer_json)["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.leaf_chars, self.leaf_symbols = leaf_chars, leaf_symbols
        self.memo = _Memo(self)
        self.tokenizer_json = tokenizer_json

    # Tokenizers for leaves, made only when a long text or word comes up: each takes tens of megabytes.

    @cached_property
    def scanner(self) -> Tokenizer:
        """For texts that are normalised already."""
        return Tokenizer.from_str(json.dumps(json.loads(self.tokenizer_json) | _BARE))

    @cached_property
    def merger(self) -> Tokenizer:
        """For symbols inside a word, at whose end nothing is marked."""
        whole = json.loads(self.tokenizer_json) | _BARE
        return Tokenizer.from_str(json.dumps(whole | {"pre_tokenizer": None, "model": whole["model"] | {"end_of_word_suffix": None}}))

    # -- words of a text: their span and their ids ---------------------------------------------

    def words(self, text: str, first: int = 0) -> list[Word]:
        """Words of a normalised text without special strings, which stands at ``first``."""
        if OUTSIDE_FAST.search(text):
            found = [(text[a:b], a, b) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        else:
            found = [(m[0], *m.span()) for m in WORD_PIECES.finditer(text)]
        return [(first + a, first + b, self.memo[piece]) for piece, a, b in found]

    def _tree(self, text: str) -> list[Word]:
        """Words of a long text: leaves in parallel, then joins."""
        count = 1
        while len(text) > self.leaf_chars * count:
            count *= 2
        cuts = [len(text) * i // count for i in range(count + 1)]
        leaves = self.scanner.encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        parts = [_words_of(leaf, a) for leaf, a in zip(leaves, cuts)]
        while len(parts) > 1:
            parts = [self._join_words(text, cuts[2 * i], cuts[2 * i + 2], parts[2 * i], parts[2 * i + 1]) for i in range(len(parts) // 2)]
            cuts = cuts[::2]
        return parts[0]

    def _join_words(self, text: str, start: int, end: int, left: list[Word], right: list[Word]) -> list[Word]:
        """Words of both sides, encoded again around the cut until both sides agree."""
        k = 4
        while True:
            first, last = max(0, len(left) - k), min(k, len(right))
            a, b = left[first][0] if first else start, right[last - 1][1] if last < len(right) else end
            middle = self.words(text[a:b], a)
            if (not first or (middle and middle[0] == left[first])) and (last == len(right) or (middle and middle[-1] == right[last - 1])):
                return left[:first] + middle + right[last:]
            k *= 2

    # -- tokens of a word -----------------------------------------------------------------

    def piece_tokens(self, piece: str) -> list[str]:
        """Tokens of one word; long ones by the tree."""
        shown = byte_level(piece)
        if len(shown) <= self.leaf_symbols:
            return [t.value for t in self.tokenizer.model.tokenize(shown)]
        cuts = range(0, len(shown), self.leaf_symbols)
        leaves = self.merger.encode_batch([shown[i : i + self.leaf_symbols] for i in cuts[:-1]], add_special_tokens=False)
        parts = [leaf.tokens for leaf in leaves] + [[t.value for t in self.tokenizer.model.tokenize(shown[cuts[-1] :])]]
        while len(parts) > 1:
            odd = parts[len(parts) // 2 * 2 :]
            parts = [self._join_tokens(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)] + odd
        return parts[0]

    def _symbols(self, tokens: list[str]) -> list[str]:
        out: list[str] = []
        for token in tokens:
            if self.end and token.endswith(self.end):
                base = token[: -len(self.end)]
                out += [*base[:-1], base[-1] + self.end]
            else:
                out += token
        return out

    def _join_tokens(self, left: list[str], right: list[str]) -> list[str]:
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(k, len(right))
            middle = self._merge(self._symbols(left[a:] + right[:b]))
            if (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
                return left[:a] + middle + right[b:]
            k *= 2

    def _merge(self, symbols: list[str]) -> list[str]:
        """Merge by rank, lowest first and leftmost among equals, with a heap over a linked list."""
        symbols, n = list(symbols), len(symbols)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.ranks.get
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], live[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s, alive in zip(symbols, live) if alive]

    # -- whole texts -----------------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        for string, number in self.special.items():
            if string in text:
                mark = array("I", [number]).tobytes()
                return mark.join(map(self.encode, text.split(string)))
        fast = not OUTSIDE_FAST.search(text)
        text = text.lower() if fast else self.tokenizer.normalizer.normalize_str(text)
        if len(text) > 2 * self.leaf_chars:
            return b"".join([ids for _, _, ids in self._tree(text)])
        if fast:
            return b"".join(map(self.memo.__getitem__, WORD_PIECES.findall(text)))
        return b"".join([ids for _, _, ids in self.words(text)])

    def decode(self, ids: bytes) -> str:
        """As ``decode(ids, skip_special_tokens=False)`` of a file without a decoder: strings joined by spaces."""
        return " ".join(map(self.strings.__getitem__, memoryview(ids).cast("I").tolist()))


class _Memo(dict):
    def __init__(self, codec: BpeCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > MEMO_PIECE_CHARS:
            vocab = self.codec.vocab
            return array("I", [vocab[t] for t in self.codec.piece_tokens(piece)]).tobytes()
        ids = array("I", [t.id for t in self.codec.tokenizer.model.tokenize(byte_level(piece))]).tobytes()
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[piece] = ids
        return ids


def _words_of(leaf: Encoding, first: int) -> list[Word]:
    """Words of an encoded leaf that stands at ``first`` in its text."""
    found: list[Word] = []
    ids, spans, words = leaf.ids, leaf.offsets, leaf.word_ids
    at = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or words[i] != words[at]:
            found.append((first + spans[at][0], first + spans[i - 1][1], array("I", ids[at:i]).tobytes()))
            at = i
    return found


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the ids (packed as ``encode`` does) and the decoded text; no shuffle."""
    return _mapped(docs, tokenizer_path, SCHEMA, lambda codec, ids: [pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.string())])


def encode_decode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """As :func:`encode_decode` with ``n_tokens`` and SHA-256 digests in place of ids and decoded text."""

    def columns(codec: BpeCodec, ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(codec.decode(i).encode("utf-8")).hexdigest() for i in ids], pa.string()),
        ]

    return _mapped(docs, tokenizer_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _mapped(docs: DataFrame, tokenizer_path: str, schema: str, columns: Callable[[BpeCodec, list[bytes]], list[pa.Array]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        vocabulary = shared.value
        codec = worker_state(("bpe", hash(vocabulary)), lambda: BpeCodec(vocabulary))
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(codec, ids)], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
