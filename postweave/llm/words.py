"""Tokens of many UTF-8 texts at once: places and 64-bit hashes, with numpy.

A token is a run of bytes of one class; class 0 separates. Long stretches are worked off in pieces
cut between tokens, so that memory follows the piece and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


class Tokens(NamedTuple):
    data: np.ndarray  # the bytes, A-Z lower-cased
    raw: np.ndarray  # the bytes as they were
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(**members: bytes) -> np.ndarray:
    """Table of 256 classes: 1, 2, .. in the order given, 0 for the rest."""
    table = np.zeros(256, np.uint8)
    for number, chars in enumerate(members.values(), 1):
        table[list(chars)] = number
    return table


def _tokens(piece: bytes, classes: np.ndarray) -> Tokens:
    raw, data = np.frombuffer(piece, np.uint8), np.frombuffer(piece.lower(), np.uint8)
    kind = classes[raw]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    bounds = np.concatenate(([0], change, [len(raw)]))
    starts, ends = bounds[:-1], bounds[1:]
    keep = kind[starts] > 0 if len(raw) else np.zeros(0, bool)
    starts, ends = starts[keep[: len(starts)]], ends[keep[: len(ends)]]
    size = 1 << max(10, int(len(raw)).bit_length())
    up, down = _powers(size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Tokens(data, raw, starts, ends, hashes)


def pieces(text: bytes, classes: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Cut at separators, about ``limit`` bytes each."""
    at = 0
    while len(text) - at > limit:
        stretch = classes[np.frombuffer(text, np.uint8, limit, at)] == 0
        last = np.flatnonzero(stretch)
        if len(last):
            cut = at + int(last[-1]) + 1
        else:  # one token longer than the limit
            rest = np.flatnonzero(classes[np.frombuffer(text, np.uint8, -1, at + limit)] == 0)
            cut = at + limit + int(rest[0]) + 1 if len(rest) else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def tokens_of(text: bytes, classes: np.ndarray) -> Iterator[Tokens]:
    """Tokens of one text, piece by piece."""
    for piece in pieces(text, classes):
        if piece:
            yield _tokens(piece, classes)


def batches_of(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def slices(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """The values of an Arrow column, few at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def tokenize(texts: list[bytes], classes: np.ndarray, separator: bytes = b"\0") -> Iterator[tuple[np.ndarray, Tokens]]:
    """(index of the text of each token, tokens) over all texts, a bounded stretch at a time."""
    for first, stop in batches_of(texts):
        if stop - first == 1:
            for found in tokens_of(texts[first], classes):
                yield np.full(len(found.starts), first), found
            continue
        joined = separator.join(texts[first:stop])
        if not joined:
            continue
        found = _tokens(joined, classes)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[first:stop]])))
        yield first + np.searchsorted(begins, found.starts, side="right") - 1, found
