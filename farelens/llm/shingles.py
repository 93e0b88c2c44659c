"""Word shingles as sorted 64-bit fingerprints, computed with numpy inside tasks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
REMEMBERED_WORDS = 300_000

_UPPER = {c: c + 32 for c in range(65, 91)}
_split = re.compile(r"[^\x20\x09-\x0D]+").findall
_ROLL = np.uint64(0x9E3779B97F4A7C15)  # odd, so that the position of a word in a shingle counts
_words: dict[str, int] = {}


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit fingerprint for each word of the text, with A-Z lower-cased."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > REMEMBERED_WORDS:
        _words.clear()
    found = _split(text.translate(_UPPER) if not text.isascii() else text.lower())
    codes = []
    for word in found:
        code = _words.get(word)
        if code is None:
            code = _words[word] = xxhash.xxh3_64_intdigest(word)
        codes.append(code)
    return np.array(codes, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the SplitMix64 constants): spreads all bits over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CHUNK = 1 << 18  # bytes whose words are summed up at once
_BYTES = mixed(np.arange(1001, 1257, dtype=np.uint64))  # a blank adds nothing to the word before it
_BYTES[_BLANK] = 0
_BYTES[65:91] = _BYTES[97:123]
_PLACES = mixed(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, offsets, begin, n) of an Arrow column: its bytes, where each text begins and the last ends, where words
    begin, and how many words each text has. Words are runs of bytes without ASCII white space."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return np.empty(0, np.uint8), offsets - offsets[0], np.empty(0, np.int64), np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    borders = offsets[:-1][np.diff(offsets) > 0]
    begins[borders] = inside[borders]
    begin = np.flatnonzero(begins)
    return data, offsets, begin, np.diff(np.searchsorted(begin, offsets))


def text_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of an Arrow column's texts, one text after another, and each text's words.

    As :func:`word_codes`, with other values, since whole columns are summed up byte by byte: a word's fingerprint
    is the sum over its bytes of a number for the byte times a number for its place. A-Z counts as a-z.
    """
    data, _, begin, n = text_words(texts)
    codes = np.empty(len(begin), dtype=np.uint64)
    up_to = np.append(begin[1:], len(data))
    start = 0
    while start < len(begin):
        end = max(start + 1, int(np.searchsorted(up_to, begin[start] + _CHUNK, "right")))
        at = begin[start:end] - begin[start]
        place = np.arange(up_to[end - 1] - begin[start]) - np.repeat(at, up_to[start:end] - begin[start:end])
        # Blanks after a word have places of their own, so only long words leave the table.
        weight = _PLACES[np.minimum(place, len(_PLACES) - 1)]
        far = np.flatnonzero(place >= len(_PLACES))
        weight[far] = mixed(place[far].astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        codes[start:end] = np.add.reduceat(_BYTES[data[begin[start] : up_to[end - 1]]] * weight, at)
        start = end
    return codes, n


def text_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``WORDS`` words of an Arrow column's texts, one text after another, and how many
    each text has: none where it has fewer words."""
    codes, n = text_codes(texts)
    many = np.maximum(n - WORDS + 1, 0)
    if len(codes) < WORDS:
        return codes[:0], many
    places = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    whole = (places < np.repeat(many, n))[: len(codes) - WORDS + 1]
    return shingle_codes(codes)[whole], many


def shingle_codes(codes: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Fingerprints of all runs of ``width`` words, or of the whole sequence where it is shorter."""
    if not len(codes):
        return codes
    width = min(width, len(codes))
    rolled = codes[: len(codes) - width + 1].copy()
    for i in range(1, width):
        rolled = rolled * _ROLL + codes[i : len(codes) - width + 1 + i]
    # The width keeps a short text apart from a shingle of a longer one.
    return mixed(rolled + np.uint64(width))


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_codes(word_codes(text)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
