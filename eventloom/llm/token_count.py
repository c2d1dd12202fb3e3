"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is merged alone; those that come out as one token
are proven whole.  A text is cut into pre-tokens; a pre-token that is a proven string counts
one, and only the rest is merged (with a bounded memo, since words repeat).

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` stays null;
repeated rows are counted one by one; extra columns of the input are ignored.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from eventloom.llm._base import worker_state
from eventloom.llm.pretokens import BYTE_PIECES, OUTSIDE_FAST, byte_level, from_byte_level

#: Distinct merged pre-tokens that a worker remembers before it starts afresh.
MEMO_ENTRIES = 400_000
#: Longer pre-tokens are merged each time, so that the memo's size is bounded in bytes too.
MEMO_PIECE_CHARS = 64

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove_whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """Strings of the vocabulary that, encoded alone, are exactly one token."""
    tokenizer = Tokenizer.from_str(tokenizer_json)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = [t for s in tokenizer.get_vocab(with_added_tokens=False) if s not in special and (t := from_byte_level(s)) is not None]
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded) if len(e.ids) == 1)


class _Counts(dict):
    """Tokens of each pre-token: the proven strings, and a bounded memo of merged ones."""

    def __init__(self, model, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.whole, self.most = model, whole, len(whole) + MEMO_ENTRIES

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(byte_level(piece)))
        if len(piece) <= MEMO_PIECE_CHARS:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens of a byte-level BPE file as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str] | None = None):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.counts = _Counts(self.tokenizer.model, prove_whole_tokens(tokenizer_json) if whole is None else whole)

    def count(self, text: str) -> int:
        """Tokens of the whole text; a special token's string counts one, as the library reads it."""
        for string in self.special:
            if string in text:
                return text.count(string) + sum(map(self.count, text.split(string)))
        if OUTSIDE_FAST.search(text):
            pieces = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        else:
            pieces = BYTE_PIECES.findall(text)
        return sum(map(self.counts.__getitem__, pieces))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``).

    The tokenizer file is read on the driver and broadcast; its size and that of the proven
    strings are fixed by the vocabulary.  There is no shuffle: one pass over two columns.
    """
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    shared = docs.sparkSession.sparkContext.broadcast((text, prove_whole_tokens(text)))

    def run(batches):
        vocabulary, whole = shared.value
        counter = worker_state(("token_count", hash(vocabulary)), lambda: TokenCounter(vocabulary, whole))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)
