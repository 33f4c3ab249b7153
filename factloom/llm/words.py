"""Hashes of the words of whole texts, with array operations."""

from __future__ import annotations

import numpy as np
import xxhash

from . import bpe


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def between(*separators: int | range) -> np.ndarray:
    """A table of which bytes stand between words."""
    table = np.zeros(256, bool)
    for s in separators:
        table[list(s) if isinstance(s, range) else s] = True
    return table


def word_hashes(texts: list[str], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, A-Z lower-cased, and where each text's words begin (one more entry for the end). A line feed must separate."""
    encoded = [t.encode("utf-8", "replace").lower() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    apart = separators[data]
    begin = np.flatnonzero(~apart & np.concatenate([[True], apart[:-1]]))
    length = np.flatnonzero(apart & np.concatenate([[False], ~apart[:-1]])) - begin
    hashes = mix(bpe.mixed(bpe.packed_keys(data, begin, length)) + length.astype(np.uint64))
    raw = data.tobytes()
    for i in np.flatnonzero(length > bpe.PACKED).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : begin[i] + length[i]])
    ends = np.cumsum([len(x) + 1 for x in encoded])
    return hashes, np.concatenate([[0], np.searchsorted(begin, ends)])


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words that begin at each word; where fewer are left it means nothing."""
    out = hashes.copy()
    with np.errstate(over="ignore"):
        for k in range(1, min(width, len(hashes))):
            out[: len(hashes) - k] = mix(out[: len(hashes) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    return out
