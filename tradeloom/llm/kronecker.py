"""Exact inner products of integer vectors by Kronecker packing.

The components of several candidates are biased to be non-negative and put into separated bit
fields of one wide integer. One multiplication of that integer by an anchor's (biased) component
multiplies all its candidates, and the sums over components stay inside their fields, so that
unpacking gives every candidate's exact score.

A wide integer is kept in a float64, which holds integers below 2**53 exactly; fields are as wide
as the largest sum needs, and vectors are taken in slices of components short enough for at least
two fields. Values for which even one component needs more go through unbounded Python integers.
"""

from __future__ import annotations

import numpy as np

_BITS = 53  # integers up to 2**53 are exact in a float64
_WIDE_FIELDS = 8  # candidates in one unbounded integer
_SAFE = 1 << 62


def _packed(values: np.ndarray, fields: int, bits: int) -> np.ndarray:
    """(components, ceil(n / fields)) wide integers of the (n, components) values; candidate i is
    in field i // width of integer i % width."""
    n, d = values.shape
    width = -(-n // fields)
    padded = np.zeros((fields * width, d), values.dtype)
    padded[:n] = values
    shift = np.array([1 << (f * bits) for f in range(fields)], values.dtype).reshape(fields, 1, 1)
    return (padded.reshape(fields, width, d) * shift).sum(axis=0).T


def _unpacked(words: np.ndarray, fields: int, bits: int, n: int) -> np.ndarray:
    mask = (1 << bits) - 1
    return np.concatenate([(words >> (f * bits)) & mask for f in range(fields)], axis=1)[:, :n]


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """(anchors, candidates) exact inner products of two arrays of whole numbers.

    Inputs of any numeric type hold whole numbers. The result is int64; products beyond its range
    are held at its ends.
    """
    d = min(anchors.shape[1], candidates.shape[1])  # missing components count as zero
    anchors, candidates = anchors[:, :d], candidates[:, :d]
    if not (len(anchors) and len(candidates) and d):
        return np.zeros((len(anchors), len(candidates)), np.int64)
    low = [int(v.min()) for v in (anchors, candidates)]
    high = [int(v.max()) for v in (anchors, candidates)]
    largest = [max(abs(a), abs(b)) for a, b in zip(low, high, strict=True)]
    spread = (high[0] - low[0]) * (high[1] - low[1])  # of one biased product
    slice_size = d if not spread else min(d, ((1 << (_BITS // 2)) - 1) // spread)
    if not slice_size or 4 * d * largest[0] * largest[1] >= _SAFE:
        return _unbounded(anchors, candidates, low, spread, d)
    a = anchors.astype(np.int64)
    c = candidates.astype(np.int64)
    biased_a, biased_c = (a - low[0]).astype(np.float64), (c - low[1]).astype(np.float64)
    total = np.zeros((len(a), len(c)), np.int64)
    bits = max(1, (spread * slice_size).bit_length())
    fields = _BITS // bits if bits * 2 <= _BITS else 1
    fields = min(fields, len(c))
    for at in range(0, d, slice_size):
        part = slice(at, at + slice_size)
        words = biased_a[:, part] @ _packed(biased_c[:, part], fields, bits)
        total += _unpacked(words.astype(np.int64), fields, bits, len(c))
    # (a' + low_a)(c' + low_c), summed: a'c' + low_c a' + low_a c
    return total + low[1] * (a - low[0]).sum(axis=1)[:, None] + low[0] * c.sum(axis=1)[None, :]


def _unbounded(anchors: np.ndarray, candidates: np.ndarray, low: list[int], spread: int, d: int) -> np.ndarray:
    exact = np.frompyfunc(int, 1, 1)
    a, c = exact(anchors).astype(object), exact(candidates).astype(object)
    bits = max(1, (spread * d).bit_length())
    words = (a - low[0]) @ _packed(c - low[1], _WIDE_FIELDS, bits)
    total = _unpacked(words, _WIDE_FIELDS, bits, len(c))
    total = total + low[1] * (a - low[0]).sum(axis=1)[:, None] + low[0] * c.sum(axis=1)[None, :]
    ends = np.iinfo(np.int64)
    return np.clip(total, ends.min, ends.max).astype(np.int64)
