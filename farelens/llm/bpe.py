"""Byte-pair encoding and decoding with forced boundaries.

A byte pair that never occurs inside any vocabulary token can never be bridged by a merge, so a cut
there is certain. A text is first cut into pre-tokens, each pre-token at such pairs; the fragments are
encoded on their own and their ids concatenated. Fragments repeat a lot, so each worker remembers
their ids; what it remembers is bounded.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the pre-token pattern of byte-level BPE with 50,257 ids.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 300_000  # pre-tokens a worker remembers
LONGEST_REMEMBERED = 64  # characters
PIECE = 256  # rows


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ForcedBoundaryBpe:
    """Encoder and decoder for one tokenizer file; one per Python worker."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = tokenizer.model
        self.letters = _byte_letters()
        byte_of = {letter: byte for byte, letter in self.letters.items()}
        self.vocabulary = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        inside = {(t[i], t[i + 1]) for t in self.vocabulary.values() for i in range(len(t) - 1)}
        self.joinable = bytearray(65_536)
        for a, b in inside:
            self.joinable[a << 8 | b] = 1
        pattern = PRE_TOKEN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
        pattern = pattern.replace(r"(?!\S)", r"(?!\P{White_Space})")
        self.pre_tokens = regex.compile(pattern).findall
        names = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.bytes_of = dict(self.vocabulary) | {i: name.encode() for name, i in self.added.items()}
        self.known = _Remembered(self)

    def cuts(self, raw: bytes) -> list[int]:
        """Places i where a cut between bytes i - 1 and i is certain."""
        joinable = self.joinable
        return [i for i in range(1, len(raw)) if not joinable[raw[i - 1] << 8 | raw[i]]]

    def encode_pre_token(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8")
        ids: list[int] = []
        start = 0
        for end in [*self.cuts(raw), len(raw)]:
            fragment = "".join(map(self.letters.__getitem__, raw[start:end]))
            ids.extend(t.id for t in self.model.tokenize(fragment))
            start = end
        return tuple(ids)

    def encode(self, text: str) -> np.ndarray:
        known, ids = self.known.__getitem__, []
        for i, part in enumerate(self.specials(text) if self.specials else [text]):
            if i % 2:
                ids.append((self.added[part],))
            elif part:
                ids.extend(map(known, self.pre_tokens(part)))
        return np.fromiter(chain.from_iterable(ids), dtype="<u4")

    def decode(self, ids: bytes) -> str:
        parts = map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(parts).decode("utf-8", "replace")


class _Remembered(dict):
    def __init__(self, bpe: ForcedBoundaryBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.bpe.encode_pre_token(token)
        if len(token) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = ids
        return ids


@lru_cache(maxsize=2)
def _bpe(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def _in_pieces(docs: DataFrame, path: str, read: str, schema: str, code) -> DataFrame:
    """``docs`` with the columns of ``schema`` that ``code(bpe, values)`` makes from column ``read``.

    Arrow batches are worked through in pieces, so that a worker holds the results of few rows.
    """
    added = T.StructType.fromDDL(schema)
    own = docs.select(*[c for c in docs.columns if c not in added.names])

    def run(batches):
        bpe = _bpe(path)
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                made = code(bpe, piece.column(read).to_pylist())
                arrays = [pa.array(values, kind) for values, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], [*piece.schema.names, *added.names])

    kinds = [{"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.dataType.simpleString()] for f in added]
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *added.fields]))


def _encoded(bpe: ForcedBoundaryBpe, texts: list) -> tuple[list, list]:
    ids = [bpe.encode(t or "") for t in texts]
    return [len(i) for i in ids], [i.tobytes() for i in ids]


def encode(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens and ids; earlier columns of these names are replaced.

    ids holds little-endian unsigned 32-bit integers in one binary value. NULL and empty texts have no
    ids (an empty value). ``path`` is the tokenizer file, which every machine must have.
    """
    return _in_pieces(docs, path, text_col, "n_tokens long, ids binary", _encoded)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with column decoded, the texts of its ids; bytes that are not UTF-8 become U+FFFD."""
    return _in_pieces(
        encoded, path, ids_col, "decoded string", lambda bpe, packed: ([bpe.decode(p or b"") for p in packed],)
    )


def encode_and_decode(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass: n_tokens, ids and decoded."""

    def both(bpe: ForcedBoundaryBpe, texts: list):
        counts, ids = _encoded(bpe, texts)
        return counts, ids, [bpe.decode(i) for i in ids]

    return _in_pieces(docs, path, text_col, "n_tokens long, ids binary, decoded string", both)
