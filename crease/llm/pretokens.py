"""Byte-level BPE: pre-tokens, whole tokens proven offline, and ids of whole texts.

The pre-token pattern is the published one of byte-level BPE.  A vocabulary
string is a *whole token* if the tokenizer, given it alone, finds one pre-token
and returns one id.  As merging never crosses a pre-token's border, a pre-token
equal to a whole token always counts one.
"""

from __future__ import annotations

import struct
from functools import lru_cache

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the same for texts whose characters are all of Latin-1; `re` is faster than `regex`
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
LATIN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
         rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
LONG_TEXT = 1 << 22
LONG_PIECE = 64  # characters of the longest pre-token that a cache keeps


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once per process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _patterns():
    import re

    import regex

    return re.compile(LATIN), regex.compile(PATTERN)


@lru_cache(maxsize=1)
def _young():
    """Finds a code point unassigned in Unicode 3.2; libraries differ on the classes of younger ones."""
    import re
    import unicodedata

    young = [c for c in range(0x110000) if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
    ends = [k for k in range(len(young)) if k + 1 == len(young) or young[k + 1] != young[k] + 1]
    starts = [0, *(k + 1 for k in ends[:-1])]
    ranges = (f"\\U{young[a]:08x}-\\U{young[b]:08x}" for a, b in zip(starts, ends, strict=True))
    return re.compile(f"[{''.join(ranges)}]")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pre_tokens(text: str, path: str):
    """Pre-tokens of a text without special strings; lazily for a very long one.

    A text with characters younger than Unicode 3.2 is cut by the tokenizer's own
    pre-tokenizer, as its tables decide their class.
    """
    latin, every = _patterns()
    if is_latin(text):
        pattern = latin
    elif _young().search(text):
        return (text[a:b] for _, (a, b) in load(path).pre_tokenizer.pre_tokenize_str(text))
    else:
        pattern = every
    if len(text) > LONG_TEXT:
        return (m[0] for m in pattern.finditer(text))
    return pattern.findall(text)


@lru_cache(maxsize=4)
def special_strings(path: str) -> list[str]:
    """Strings that the tokenizer finds in texts and gives one id, before any other rule."""
    return [t.content for t in load(path).get_added_tokens_decoder().values()]


def around_special(text: str, special: list[str], keep: bool = False) -> list[str]:
    """The parts of a text between its special strings; with ``keep`` these too, in their places."""
    import re

    if not any(s in text for s in special):
        return [text]
    either = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
    return re.split(f"({either})" if keep else either, text)


def prove_whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that, alone, are one pre-token and one token."""
    tokenizer = load(path)
    special = set(special_strings(path))
    texts = [t for k in range(tokenizer.get_vocab_size(with_added_tokens=False))
             if (t := tokenizer.decode([k], skip_special_tokens=False)) and "�" not in t and t not in special]
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, found, strict=True) if len(e.ids) == 1 and list(pre_tokens(t, path)) == [t]]


def byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def fast_encoding(path: str):
    """The same vocabulary in the library that fills id arrays fastest (its ids are ranks of merges)."""
    import tiktoken

    alphabet = byte_of_char()
    ranks = {bytes(alphabet[c] for c in t): k for t, k in load(path).get_vocab(with_added_tokens=False).items()}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class PieceIds(dict):
    """Ids of a pre-token as little-endian uint32 bytes, encoded on first sight.

    Keeps at most ``cache_rows`` pre-tokens, and none of more than
    ``LONG_PIECE`` characters: a bound on memory, not on results.
    """

    def __init__(self, path: str, cache_rows: int = 300_000):
        super().__init__()
        self.path, self.limit, self.encoding = path, cache_rows, fast_encoding(path)

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoding.encode_ordinary(piece)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) > LONG_PIECE:
            return out
        if len(self) >= self.limit:
            self.clear()
        self[piece] = out
        return out


def encode_bytes(text: str, pieces: PieceIds) -> bytes:
    """Ids of a whole text as little-endian uint32 bytes, special strings as the tokenizer's default has them."""
    path = pieces.path
    special = special_strings(path)
    out = []
    for part in around_special(text, special, keep=True):
        if part in special:
            out.append(struct.pack("<I", load(path).token_to_id(part)))
        else:
            out.append(b"".join(map(pieces.__getitem__, pre_tokens(part, path))))
    return b"".join(out)
