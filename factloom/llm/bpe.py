"""Exact token ids of whole texts by looking up pre-tokens.

Texts of any script are cut into pre-tokens with array operations on the classes of their characters; each distinct
pre-token is encoded once a worker by the vocabulary's own library. A text goes to that library whole only if it holds
a code point that Unicode 15.1 leaves unassigned, whose class libraries disagree on, a zero character, or what may be a special token.
Both ways give the library's ids.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

#: Longest pre-token, in bytes, that packs into three machine words; longer ones are looked up one by one.
PACKED = 24
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 250_000

_SEPARATOR, _LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = range(6)
_TABLES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point. Made once a worker."""
    if not _TABLES:
        table = np.full(0x110000, _OTHER, np.uint8)
        kinds = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
        for code in range(0x110000):
            category = unicodedata.category(chr(code))
            if category == "Cn":
                table[code] = _UNSURE
            elif category[0] in kinds:
                table[code] = kinds[category[0]]
        table[[9, 10, 11, 12, 13, 0x85]] = _SPACE
        table[0] = _SEPARATOR
        _TABLES.append(table)
    return _TABLES[0]


#: Each byte as the library's byte-level step writes it: visible ones as themselves, others from U+0100 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}


def is_plain(text: str) -> bool:
    if "<|" in text or "\0" in text:
        return False
    return text.isascii() or not (_classes()[np.frombuffer(text.encode("utf-32-le"), "<u4")] == _UNSURE).any()


def _contractions(points: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of apostrophes that open one of 's 't 'm 'd 're 've 'll, and the number of letters that they take."""
    at = np.flatnonzero((points == 39) & begins)
    at = at[kind[at + 1] == _LETTER]
    first, second = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    two = ((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108)
    return at[one | two], np.where(one, 1, 2)[one | two]


def _take_letters(begins: np.ndarray, kind: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    begins[at + 1] = False
    after = at + 1 + n
    begins[after[kind[after] == _LETTER]] = True


def _byte_level(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens of the byte-level pattern begin; a text's closing zero begins a piece of its own."""
    begins = np.empty(len(points), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == _SEPARATOR
    follows = np.zeros(len(points), bool)  # last white space of a run before something visible
    follows[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _SEPARATOR)
    begins |= follows
    begins[np.flatnonzero(follows & (points == 32)) + 1] = False
    _take_letters(begins, kind, *_contractions(points, kind, begins))
    return np.flatnonzero(begins)


def _word_level(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The same for the pattern that drops white space and takes digits one by one; white space still begins a piece."""
    begins = np.empty(len(points), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= (kind == _SEPARATOR) | (kind == _NUMBER)
    _take_letters(begins, kind, *_contractions(points, kind, begins))
    return np.flatnonzero(begins)


class Cut(NamedTuple):
    """Texts in UTF-8, each closed by a zero byte, and where their pre-tokens begin, how many bytes they take, and which are those zeros."""

    data: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    closing: np.ndarray


def cut(texts: Sequence[str], *, words: bool = False) -> Cut:
    """Cut plain texts. words: by the pattern that drops white space, whose texts must have been normalised; else by the byte-level pattern."""
    joined = "\0".join(texts) + "\0"
    data = np.frombuffer(joined.encode(), np.uint8)
    points = data if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = _classes()[points]
    at = (_word_level if words else _byte_level)(points, kind)
    begin = at
    if points is not data:
        width = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
        begin = (np.cumsum(width, dtype=np.int64) - width)[at]
    length = np.diff(begin, append=len(data))
    closing = kind[at] == _SEPARATOR
    if words:
        keep = kind[at] != _SPACE
        begin, length, closing = begin[keep], length[keep], closing[keep]
    return Cut(data, begin, length, closing)


_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def packed_keys(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each piece of at most 24 bytes as three machine words; of a longer one its first 24."""
    held = np.concatenate([data, np.zeros(PACKED + 8, np.uint8)])
    words = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    parts = []
    for k in range(3):
        have = np.clip(length - 8 * k, 0, 8)
        parts.append(words[np.minimum(begin + 8 * k, len(words) - 1)] & _MASKS[have])
    return parts[0], parts[1], parts[2]


def mixed(keys: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = (h + keys[1]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h = (h + keys[2]) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class CompactTable:
    """Open addressing over packed pre-tokens: a few flat arrays, cheap to broadcast and to probe for many keys at once."""

    def __init__(self, pieces: Sequence[bytes], values: Sequence[int]):
        size = 1 << max(4, (2 * len(pieces)).bit_length())
        self.keys = np.zeros((3, size), np.uint64)
        self.values = np.full(size, -1, np.int32)
        for piece, value in zip(pieces, values, strict=True):
            data = np.frombuffer(piece, np.uint8)
            key = packed_keys(data, np.array([0]), np.array([len(piece)]))
            slot = int(mixed(key)[0]) & (size - 1)
            while self.values[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.keys[:, slot], self.values[slot] = [k[0] for k in key], value

    def find(self, keys: tuple[np.ndarray, np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        mask = len(self.values) - 1
        out = np.full(len(hashes), -1, np.int32)
        rows, slots = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(rows):
            value = self.values[slots]
            same = value >= 0
            for k in range(3):
                same &= self.keys[k][slots] == keys[k][rows]
            out[rows[same]] = value[same]
            go_on = ~same & (value >= 0)
            rows, slots = rows[go_on], (slots[go_on] + 1) & mask
        return out


def distinct(data: np.ndarray, begin: np.ndarray, length: np.ndarray, keys, hashes) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces and, for each piece, the place of its own among them. Equal hashes are compared by content."""
    raw = data.tobytes()
    order, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    alike = length == length[first][inverse]
    for k in keys:
        alike &= k == k[first][inverse]
    alike &= length <= PACKED
    pieces = [raw[a : a + n] for a, n in zip(begin[first].tolist(), length[first].tolist(), strict=True)]
    if not alike.all():
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(~alike).tolist():
            piece = raw[begin[i] : begin[i] + length[i]]
            if piece not in known:
                known[piece] = len(pieces)
                pieces.append(piece)
            inverse[i] = known[piece]
    return pieces, inverse


class Pieces:
    """Ids of pre-tokens by the library, remembered by the worker."""

    _open: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def ids(self, pieces: Sequence[bytes]) -> list[tuple[int, ...]]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        merge = self.model.tokenize
        for p in pieces:
            if p not in known:
                known[p] = tuple([x.id for x in merge(p.decode("latin-1").translate(_BYTE_CHARS))])
        return [known[p] for p in pieces]

    def normalised(self, text: str) -> str:
        """As the library normalises a text; within Latin-1 its normal form, white space apart, is the lower case."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.tokenizer.normalizer.normalize_str(text)
        return text.lower()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids
