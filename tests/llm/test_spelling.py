"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import edge_rows, frame
from tradeloom.llm import spelling
from tradeloom.llm.acceptor import Acceptor, pairs

CLASHING = ["word", "n", "form", "root", "key", "low", "high", "j", "longer", "bucket"]


def variants(spark, rows, **options):
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in CLASHING})
    return sorted(tuple(r) for r in spelling.variants(docs, **options).collect())


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("seed", range(40))
def test_composition(seed):
    """Pairs of several groups, each found once."""
    rng = random.Random(seed)
    words, number, short, long = [], [], [], []
    for g in range(rng.randrange(1, 5)):
        m = rng.randrange(0, 6)
        make = lambda n, most: sorted({bytes(rng.choice(b"abc\xff") for _ in range(n)) for _ in range(rng.randrange(1, most))})
        one, two = make(m, 14), make(m + 1, 14) if rng.random() < 0.8 else []
        short.append(len(words))
        long.append(len(words) + len(one) if two else -1)
        words += [*one, *two]
        number += [2 * g] * len(one) + [2 * g + 1] * len(two)
    found = pairs(Acceptor(words, np.array(number)), np.array(short), np.array(long), np.ones(len(short), bool))
    got = sorted(tuple(sorted(p)) for p in zip(*(f.tolist() for f in found), strict=True))
    joins = lambda i, k: number[i] % 2 == 0 and number[k] - number[i] in (0, 1)
    assert got == [(i, k) for i in range(len(words)) for k in range(i + 1, len(words)) if joins(i, k) and one_edit(words[i], words[k])]


def test_states_are_minimal():
    """Equal right languages are one state, also across groups."""
    acceptor = Acceptor([b"abc", b"abd", b"xbc", b"xbd", b"bc", b"bd"], np.array([0, 0, 0, 0, 1, 1]))
    assert [len(level.first) for level in acceptor.levels] == [1, 1, 1, 1]
    assert acceptor.levels[3].words.tolist() == [4] and acceptor.levels[3].before.tolist() == [0, 2]


def test_checksums():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    lengths = np.array([0, 1, 5, 64, 65, 700, 3, 3])
    starts, before = np.arange(8) * 600, np.array([zlib.crc32(b"%d:" % i) for i in range(8)], np.uint32)
    got = spelling.checksums(data, starts, lengths, before)
    assert got.tolist() == [zlib.crc32(data[s : s + n].tobytes(), int(b)) for s, n, b in zip(starts, lengths, before, strict=True)]


@pytest.mark.parametrize("group_words", [spelling.GROUP_WORDS, 4, 1])
def test_equals_comparing_all(spark, small, group_words):
    wanted = spelling.brute_force(small)
    assert len(wanted) > 500 and sum(r[1] is not None for r in wanted) > 50 and any(r[1] != r[2] for r in wanted if r[1])
    assert variants(spark, small, group_words=group_words) == wanted


def test_hot_prefix_is_split(spark):
    """All words share half of their letters; groups stay small and no pair is lost."""
    rng = random.Random(3)
    some = sorted({"prefix" + "".join(rng.choice("abcdé") for _ in range(5)) + "suffix" for _ in range(900)})
    rows = [(i, " ".join(some)) for i in range(4)]
    words = spelling.vocabulary(frame(spark, rows))
    sizes = spelling.groups(words, 40).groupBy("key").count().agg(F.max("count")).first()[0]
    assert sizes <= 40 < spelling.groups(words).groupBy("key").count().agg(F.max("count")).first()[0]
    assert variants(spark, rows, group_words=40) == spelling.brute_force(rows)


def test_chains_reach_the_last_form(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc"]
    rows = [(i, " ".join(f"{w} " * 3 * 2**k for k, w in enumerate(chain))) for i in range(5)]
    rows = [r for r in rows if all(zlib.crc32(f"{r[0]}:{w}".encode()) % 97 for w in chain)]
    got = {r[0]: r[2] for r in variants(spark, rows)}
    assert len(rows) > 2 and set(got.values()) == {"bbbbc"}


def test_edges(spark):
    letters = "x" * 9_000
    rows = [
        *edge_rows(), (20, "Straße straße STRASSE STRAßE Straße"), (21, "naïve naive naïve naive NAÏVE naïve naive naive naive naive naive"),
        (22, f"{letters} {letters} {letters} {letters}y {letters}y {letters}y"), (None, "nulls nulls nulls"), (23, "a×bcd÷ a×bcd÷ a×bcd÷ abcd÷ abcd÷ abcd÷"),
        (24, "tie_one1tieaa tieaa tieaa tieab tieab tieab tiea tieac tieac tieac"), (24, "tieac tieac tieac"), (25, "edges,edges;edges.edgess edgess edgess"),
    ] + [(100 + i, "wordy wordi worda") for i in range(400)]
    assert variants(spark, rows) == spelling.brute_force(rows)


def test_empty(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, "rare words only"), (2, None)]) == []
