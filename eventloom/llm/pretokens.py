"""Pre-tokenizers of two public BPE files, re-expressed for speed.

``FAST`` recognises texts whose characters all lie in ASCII and two Latin blocks, where
letters, digits and white space can be listed as explicit character classes for ``re``;
any other text goes through the tokenizers library's own pre-tokenizer, so both routes
give the library's pieces.
"""

from __future__ import annotations

import re

# Letters, numbers and white space among the characters of FAST.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \xa0"

#: Finds a character outside the fast range; U+0130 is left out because its lower case is two characters.
OUTSIDE_FAST = re.compile("[^\t-\r -~\xa0-įı-ſ]")

#: Pieces of byte_bpe_50k.json (its regular expression is public).
BYTE_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Pieces of word_bpe_49k.json; white space between them is dropped.
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def _byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARACTERS = _byte_characters()
CHARACTER_BYTES = {c: b for b, c in BYTE_CHARACTERS.items()}


def byte_level(piece: str) -> str:
    """``piece`` in the byte-level alphabet."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", BYTE_CHARACTERS[0x20])
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_CHARACTERS)


def from_byte_level(piece: str) -> str | None:
    """The text of a byte-level string, or None if its bytes are no UTF-8 text."""
    try:
        return bytes(CHARACTER_BYTES[c] for c in piece).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
