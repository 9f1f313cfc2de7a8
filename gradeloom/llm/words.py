"""Words of many texts at once with numpy: tokens as numbers of exact words, and polynomial fingerprints of words and n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 3_000_000
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)  # A-Z only
# Two odd multipliers; their powers wrap modulo 2^64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """For each byte: 0 part of a word, 1 between words, 2 between pieces."""
    out = np.zeros(256, np.uint8)
    out[list(spaces)] = 1
    out[list(breaks)] = 2
    return out


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows whose texts (binary, no nulls) hold about ``most`` bytes, over the borders of batches; a longer text is alone.

    Only the texts of one portion are copied out of the batches at a time.
    """
    parts: list[pa.RecordBatch] = []
    size = 0

    def portion() -> tuple[pa.Table, list[bytes]]:
        rows = pa.Table.from_batches(parts)
        return rows.drop_columns([text]), rows.column(text).to_pylist()

    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            if size and size + n > most:
                if i > start:
                    parts.append(batch.slice(start, i - start))
                yield portion()
                parts, size, start = [], 0, i
            size += n
        if batch.num_rows > start:
            parts.append(batch.slice(start))
    if parts:
        yield portion()


@dataclass
class Tokens:
    """The words of some texts, in order: number of the word, of its text, and of its piece."""

    word: np.ndarray
    doc: np.ndarray
    piece: np.ndarray
    dictionary: pa.Array  # the distinct words; equal numbers mean equal bytes
    start: np.ndarray  # where words begin and end in the joined text, in lower case
    end: np.ndarray
    joined: np.ndarray


def tokens(texts: list[bytes], kind: np.ndarray) -> Tokens:
    """Lower-case A-Z and split; a newline, which separates words and pieces alike, stands between texts."""
    joined = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    of = kind[joined]
    inside = of == 0
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    data = joined[inside]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
    counts = np.diff(np.searchsorted(start, firsts))
    return Tokens(
        words.indices.to_numpy(), np.repeat(np.arange(len(texts), dtype=np.int32), counts),
        np.cumsum(of == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32), words.dictionary, start, end, joined,
    )


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of ``base``; kept by the worker and grown when more are asked for."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        table = np.full(max(n, 1 << 20), base, np.uint64)
        table[0] = 1
        _POWERS[base] = np.multiply.accumulate(table)
    return _POWERS[base][:n]


class Polynomial:
    """Prefix sums of values times powers: the fingerprint of any run of values is one difference, shifted back."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        self.back = powers(pow(base, -1, 1 << 64), len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.back[start]


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each word of a dictionary."""
    offsets = np.frombuffer(dictionary.buffers()[1], np.int64, len(dictionary) + 1, dictionary.offset * 8) if len(dictionary) else np.zeros(1, np.int64)
    data = np.frombuffer(dictionary.buffers()[2], np.uint8, offsets[-1]) if len(dictionary) and offsets[-1] else np.zeros(0, np.uint8)
    sums = Polynomial(data.astype(np.uint64) + np.uint64(1), BYTE_BASE)
    return mix(sums.of(offsets[:-1], offsets[1:]) ^ mix(np.diff(offsets).astype(np.uint64)))
