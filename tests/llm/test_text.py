"""Words, lines and hashes of blocks against plain Python."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tradeloom.llm import fuse, line_dedup, ppm
from tradeloom.llm import text as tx

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 \t\n.é漢🙂\x00", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words(texts, limit):
    found = []
    for block in tx.blocks(pa.array(texts, pa.string()), limit):
        words = tx.Words(block, tx.WHITE, lower=False)
        hashes = words.hashes()
        for d in range(block.n):
            own = range(words.bounds[d], words.bounds[d + 1])
            found.append([words.word(i).decode() for i in own])
            assert [int(hashes[i]) for i in own] == [tx.word_hash(words.word(i)) for i in own]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_windows(texts, size):
    for block in tx.blocks(pa.array(texts, pa.string())):
        words = tx.Words(block, tx.WHITE, lower=False)
        starts, hashes = tx.windows(words.hashes(), words.bounds, size)
        wanted = [i for d in range(block.n) for i in range(words.bounds[d], words.bounds[d + 1] - size + 1)]
        assert starts.tolist() == wanted
        assert hashes.tolist() == [tx.sequence_hash([words.word(k) for k in range(i, i + size)]) for i in wanted]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_lines(texts):
    at, chars, counts = [], [], []
    for block in tx.blocks(pa.array(texts, pa.string()), 25):
        lines = line_dedup.Lines(block)
        counts += lines.counts.tolist()
        at += [block.lowered()[a:b].tobytes().decode() for a, b in zip(lines.key_starts, lines.key_ends, strict=True)]
        chars += lines.key_chars.tolist()
    plain = [line for t in texts for line in (t or "").split("\n")]
    keys = [re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in plain]
    assert counts == [(t or "").count("\n") + 1 for t in texts]
    assert at == keys and chars == [len(k) for k in keys]


def test_fuse_filters_never_miss():
    for n in (0, 1, 2, 3, 17, 400, 30_000):
        keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        made = fuse.build(np.r_[keys, keys])
        assert made.maybe(keys).all()
        others = np.random.default_rng(n + 1).integers(0, 2**63, 20_000).astype(np.uint64)
        assert made.maybe(others).mean() < 0.01


def test_memory_of_a_block(monkeypatch):
    """Words, windows and grams of long batches: several such tasks share an executor with its heap."""
    numbers = np.random.default_rng(5).integers(0, 9999, (800, 2000))
    texts = pa.array([" ".join(map(str, row)) for row in numbers])
    for powers in (tx._BYTE_POWERS, tx._WORD_POWERS):
        monkeypatch.setattr(powers, "up", np.ones(1, tx.U64))
        monkeypatch.setattr(powers, "down", np.ones(1, tx.U64))
    tracemalloc.start()
    try:
        for block in tx.blocks(texts):
            words = tx.Words(block, tx.WHITE, lower=False)
            tx.windows(words.hashes(), words.bounds, 50)
            np.sort(ppm.grams(*ppm.symbols(block), ppm.ORDER))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 90e6
