"""Vectorised encoding over the tokenizers library: a text is cut where no token can cross, each piece is encoded once.

A batch of texts becomes one array of chunks, cut before white space; Arrow finds the distinct chunks, only these are
split and encoded, and their ids are gathered back by position. A worker keeps the chunks and pieces that it met first,
up to a fixed number, so memory is bounded and common words are looked up; all others go through the library's model,
many at a time.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections import ChainMap
from itertools import islice

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

#: Chunks and pieces that a worker keeps, at most, and the longest that is kept: about 60 MB in all.
MOST_CHUNKS, MOST_PIECES, LONGEST_KEPT = 400_000, 150_000, 48

#: Latin letters without combining marks: here NFC changes nothing, and all engines class every character alike. Chunks
#: with others are cut by the library itself.
_PLAIN = re.compile("[\x00-ɏ]*")
_STOPS = frozenset(".,;:!?")
_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True
_INK_BYTE = np.zeros(256, bool)
_INK_BYTE[33:127] = True


def byte_table() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}


BYTE_CHARS = byte_table()
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}


def to_chars(raw: bytes) -> str:
    return raw.decode("latin-1").translate(BYTE_CHARS)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_model(path: str) -> models.BPE:
    """The ranks as a BPE model: whatever two tokens join to a token may merge, in the order of the joined token's rank."""
    rank = ranks(path)
    vocab = {to_chars(t): i for t, i in rank.items()}
    merges = []
    for token, _ in sorted(rank.items(), key=lambda x: x[1]):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in rank and token[i:] in rank]
        merges += [(to_chars(a), to_chars(b)) for a, b in sorted(cuts, key=lambda c: (rank[c[0]], rank[c[1]]))]
    return models.BPE(vocab=vocab, merges=merges, ignore_merges=True)


def chunks(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The texts cut into chunks, and the number of chunks of each text.

    A cut stands before ASCII white space behind a character that surely is none, so a run of white space stays whole.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.empty(0, np.uint8)
    ends -= ends[0]
    at = np.flatnonzero(_SPACE_BYTE[data])
    at = at[at > 0]
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # no two-byte character from C3 on and no three-byte one from E4 on is white space
    solid = _INK_BYTE[one] | (one >= 0x80) & ((two >= 0xC3) & (two < 0xE0) | (two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three < 0xF0))
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = cut[at[solid]] = True
    bounds = np.flatnonzero(cut)
    counts = np.diff(np.searchsorted(bounds, ends))
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))), counts


def gathered(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``which`` of a ragged array joined, and where each ends."""
    begins = np.cumsum(lengths) - lengths
    n = lengths[which]
    ends = np.cumsum(n)
    step = np.int32 if max(len(flat), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    at = np.repeat((begins[which] - ends + n).astype(step), n)
    at += np.arange(len(at), dtype=step)
    return flat[at], ends


class Coder:
    """Encodes many texts at once. A subclass splits a chunk into pieces of the model, or leaves it to the library."""

    def __init__(self, model: models.Model):
        self.model = model
        self.known, self.flat, self.lengths = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)
        self.pieces: dict[str, bytes] = {}

    def split(self, chunk: str) -> list[str] | None:
        """The pieces of a chunk, None if ``odd`` must encode it."""
        raise NotImplementedError

    def odd(self, found: list[str]) -> list[bytes]:
        """The bytes of the ids of chunks that ``split`` can't cut."""
        raise NotImplementedError

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(to_chars(piece.encode()))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _made(self, names: list[str]) -> list[bytes]:
        """The bytes of the ids of distinct chunks."""
        cut = list(map(self.split, names))
        new = {p for c in cut if c for p in c}.difference(self.pieces)
        made = dict(zip(new, map(self._piece, new), strict=True))
        for p in islice((p for p in new if len(p) <= LONGEST_KEPT), MOST_PIECES - len(self.pieces)):
            self.pieces[p] = made[p]
        look = ChainMap(self.pieces, made) if len(self.pieces) == MOST_PIECES else self.pieces | made
        rest = [n for n, c in zip(names, cut, strict=True) if c is None]
        others = iter(self.odd(rest) if rest else [])
        return [next(others) if c is None else look[c[0]] if len(c) == 1 else b"".join([look[p] for p in c]) for c in cut]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and where each text's end."""
        cut, counts = chunks(pc.fill_null(texts.cast(pa.string()), ""))
        at = pc.index_in(cut, value_set=self.known)
        unknown = pc.is_null(at)
        coded = cut.filter(unknown).dictionary_encode()
        made = self._made(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), "<u4")])
        lengths = np.concatenate([self.lengths, np.fromiter(map(len, made), np.int64, len(made)) // 4])
        which = pc.fill_null(at, 0).to_numpy().copy()
        which[unknown.to_numpy(zero_copy_only=False)] = coded.indices.to_numpy() + len(self.known)
        ids, ends = gathered(flat, lengths, which)
        if len(self.known) < MOST_CHUNKS:
            short = np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy() <= LONGEST_KEPT)[: MOST_CHUNKS - len(self.known)]
            kept = np.concatenate([np.arange(len(self.known)), short + len(self.known)])
            self.flat, self.lengths = gathered(flat, lengths, kept)[0], lengths[kept]
            self.known = pa.concat_arrays([self.known, coded.dictionary.take(pa.array(short))])
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


class ByteLevelCoder(Coder):
    """Encodes each match of a pattern by byte-level ranks; the matches' gaps, if any, get no ids."""

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__(byte_model(ranks_path))
        self.library = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.pattern = regex.compile(pattern)
        rank = ranks(ranks_path)
        table = [b""] * (max(rank.values()) + 1)
        for token, i in rank.items():
            table[i] = token
        self.table = pa.array(table, pa.binary())
        self.sizes = np.array([len(t) for t in table], dtype=np.int64)

    def split(self, chunk: str) -> list[str] | None:
        if chunk.isascii() or _PLAIN.fullmatch(chunk):
            return self.pattern.findall(chunk)
        return [m for m, _ in self.library.pre_tokenize_str(chunk)]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
        """The bytes of each text. A character may be split among ids; only a text's whole sequence need be UTF-8."""
        taken = self.table.take(pa.array(ids.astype(np.int32)))
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], ends])].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), taken.buffers()[2] or pa.py_buffer(b"")])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids, np.array([len(ids)]))[0].as_py()

    def byte_ends(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The byte offset in its own text at which each id ends."""
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        return at[1:] - np.repeat(at[np.concatenate([[0], ends[:-1]])], np.diff(ends, prepend=0))


class WordCoder(Coder):
    """Encodes by a tokenizer file that normalises to lower-case NFC, drops white space and marks word ends.

    Strings of the file's special tokens give these tokens, as in the library.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        super().__init__(self.whole.model)
        found = re.search(r'Split\(pattern=Regex\("(.*?)"\)', repr(self.whole.pre_tokenizer))
        normal = repr(self.whole.normalizer)
        #: The pattern of the file's own pre-tokenizer; without one each chunk goes through the whole tokenizer.
        self.pattern = regex.compile(found[1].replace('\\"', '"')) if found and "NFC()" in normal and "Lowercase()" in normal else None
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if any(c.isspace() for s in special for c in s):
            raise ValueError("special tokens with white space can't be cut at white space")
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def split(self, chunk: str) -> list[str] | None:
        word = chunk.strip(" \t\n\r\x0b\x0c").lower()
        if self.pattern is None or not (word.isascii() or _PLAIN.fullmatch(word)):
            return None
        # a word of letters is one match of the pattern, and a stop behind it another
        if word.isalpha():
            return [word]
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return None if self.special.search(chunk) else self.pattern.findall(word)

    def odd(self, found: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(found, add_special_tokens=False)]


_held: dict[tuple, object] = {}


def held(kind, *args):
    """The coder of a worker, made once."""
    if (kind, *args) not in _held:
        _held[(kind, *args)] = kind(*args)
    return _held[(kind, *args)]
