"""Words, lines and their hashes over blocks of texts, vectorised with numpy.

Tasks receive texts as Arrow batches. `blocks` cuts a batch into runs of whole documents of a
few megabytes, so memory follows the block size (or the one longest text), never the partition.
Hashes are 64 bits wide, are the same in every process, and stand for the word (or word
sequence) they were made from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_LONG = 64  # bytes
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_ODD))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._table(self._base, n)
            self.down = self._table(self._inverse, n)
        return self.up, self.down

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        values = np.full(n, base & _MASK, U64)
        values[0] = 1
        return np.multiply.accumulate(values)


_BYTE_POWERS = _Powers(0x9FB21C651E98DF25)
_WORD_POWERS = _Powers(0xD6E8FEB86659FD93)


def _range_hashes(values: np.ndarray, powers: _Powers, starts, ends) -> np.ndarray:
    """Polynomial hash of values[start:end] for every given range."""
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def byte_range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes data[start:end] for every given range.

    A polynomial modulo 2**64 tells short ranges apart; long ones can be made to collide under
    every base (by a word of two letters and its complement that repeat a doubling pattern), so
    they get a cryptographic hash.
    """
    made = _range_hashes(_BYTE_VALUE[data], _BYTE_POWERS, starts, ends)
    for i in np.flatnonzero(ends - starts >= _LONG):
        made[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return made


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: All but digits, lower-case letters and what lies beyond ASCII.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Block:
    """Some whole texts as one byte array. Null texts count as empty."""

    def __init__(self, texts: pa.Array, first: int):
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        n = len(texts)
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.first, self.n = first, n
        self.bytes = raw[at[0] : at[-1]]
        self.offsets = at - at[0]

    def lowered(self) -> np.ndarray:
        return _LOWER[self.bytes]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Runs of whole texts, each of at most `limit` bytes unless one text alone has more."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < len(texts):
        used = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, used + limit, "right")))
        yield Block(texts.slice(at, to - at), at)
        at = to


class Words:
    """The words of a block: maximal runs of bytes outside `separators`.

    starts, ends  byte positions in the block
    bounds        words of text d are bounds[d]:bounds[d + 1]
    """

    def __init__(self, block: Block, separators: np.ndarray, lower: bool):
        self.block = block
        self.bytes = block.lowered() if lower else block.bytes
        inside = ~separators[self.bytes]
        edge = np.zeros(len(inside) + 1, bool)  # a text begins here, or all end
        edge[block.offsets] = True
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, block.offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return byte_range_hash(self.bytes, self.starts, self.ends)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.n), self.counts)

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of `size` words that lies inside one text."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    starts = np.flatnonzero(room >= size)
    return starts, _range_hashes(hashes, _WORD_POWERS, starts, starts + size)


def sequence_hash(words: list[bytes]) -> int:
    """The hash `windows` gives to this sequence of words."""
    return int(range_hash(np.array([word_hash(w) for w in words], U64), [0], [len(words)])[0])


def word_hash(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(byte_range_hash(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


def range_hash(hashes: np.ndarray, starts, ends) -> np.ndarray:
    """Hash of the word sequence hashes[start:end] for every given range."""
    return _range_hashes(hashes, _WORD_POWERS, np.asarray(starts), np.asarray(ends))


def remainder(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of the decimal id, modulo `modulus`; an id that is null counts as the text ''."""
    import zlib

    return np.array(
        [zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids.to_pylist()],
        np.int64,
    )


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions start, ..., start + length - 1 of every range, in order."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return skip + np.arange(total)
