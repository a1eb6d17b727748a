"""Words of a batch of texts as arrays: UTF-8 bytes of a class run together, A-Z count as a-z, copies are encoded once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import joined

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 truth values: the bytes of the ranges, ends included."""
    held = np.zeros(256, dtype=bool)
    for low, high in ranges:
        held[low : high + 1] = True
    return held


#: Bytes of letters, digits and all that isn't ASCII; the same without digits; all but blanks and marks that end a piece.
TERM = byte_class((48, 57), (65, 90), (97, 122), (128, 255))
LETTERS = byte_class((65, 90), (97, 122), (128, 255))
BREAK = byte_class(*[(ord(c), ord(c)) for c in ".,;:!?"], (10, 13))
PHRASE = ~(BREAK | byte_class((9, 9), (32, 32)))


class Words(NamedTuple):
    code: np.ndarray  #: of each word, its place among the distinct ones
    known: pa.Array  #: the distinct words
    row: np.ndarray  #: of each word, the row of the batch that holds it
    begin: np.ndarray  #: of each word, its first byte in ``data``
    data: np.ndarray  #: the lower-cased bytes of all texts, a space behind each


def cut_words(texts: pa.Array, kind: np.ndarray) -> Words:
    """The words of all texts, maximal runs of bytes of ``kind``, to which the space doesn't belong; nulls hold none."""
    data, starts = joined(texts)
    data = _FOLD[data]
    solid = kind[data]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[solid]))
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(starts, begin, side="right") - 1, begin, data)
