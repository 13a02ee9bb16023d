"""Exact, near, line and passage deduplication against SQL or plain search."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from checks.compare import compare
from tests.conftest import SMALL
from tests.llm.conftest import edge_rows, frame
from tradeloom.llm import exact_dedup, line_dedup, ngram_join, substring_dedup

WORDS = [f"{a}{b}" for a in "bdfgklmn" for b in ("a", "e", "ila", "oru")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


# exact


@pytest.mark.parametrize("module", [exact_dedup, line_dedup])
def test_equals_sql(spark, module):
    assert compare(spark, SMALL, module.__name__, module.query, module.ORACLE) == ""


def test_exact_edges(spark):
    docs = frame(spark, edge_rows())
    rows = exact_dedup.deduplicate(*exact_dedup.halves(docs)).collect()
    assert len(rows) == docs.count()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert got[1] == [(2, 3, False)] and got[2] == [(2, 3, True)]  # null, empty and null
    assert got[4] == [(5, 2, False)] and got[5] == [(5, 2, True)]
    assert sorted(got[8]) == [(8, 2, False), (8, 2, True)]  # repeated row: one stays
    assert sorted(got[None], key=str) == [(2, 3, False), (None, 1, True)]
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [2, 3, 5, 7, 8, 9, None, 11]))


def test_exact_empty(spark):
    docs = frame(spark, [])
    assert exact_dedup.deduplicate(docs, docs).count() == 0
    assert exact_dedup.kept_documents(docs).count() == 0


def test_snapshot_without_batch_and_batch_without_snapshot(spark):
    docs, none = frame(spark, [(1, "a"), (2, "A"), (3, "b")]), frame(spark, [])
    for pair in ((docs, none), (none, docs)):
        rows = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(*pair).collect()}
        assert rows == {1: (2, False), 2: (2, True), 3: (3, True)}


# near


@pytest.mark.parametrize(("width", "similarity"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_equals_all_pairs(spark, small, width, similarity):
    rng = random.Random(5)
    rows = [(i, t) for i, t in small[:100]]
    base = sentence(rng, 60).split()
    for i in range(70):  # a group in which only some pairs link
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(60)] = "edit" + str(rng.randrange(10**6))
        rows.append((10_000 + i, " ".join(own)))
    rows += [(20_000 + i, sentence(rng, 8) + " " + " ".join(base[:20])) for i in range(30)]  # shared passage
    rows += [(30_000, None), (30_001, ""), (30_002, "a b"), (30_003, "A  b"), (30_004, "a")]
    found = ngram_join.jaccard_components(frame(spark, rows), width, similarity)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == ngram_join.brute_force(rows, width, similarity)


def test_jaccard_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_TILE", 8)
    rng = random.Random(3)
    base = sentence(rng, 80).split()
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(80)] = "e" + str(rng.randrange(10**6))
        rows.append((i, " ".join(own)))
    found = ngram_join.jaccard_components(frame(spark, rows), 3, Fraction(9, 10)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == ngram_join.brute_force(rows, 3, Fraction(9, 10))


def test_signatures_of_linked_sets_meet():
    """Whatever is left out of the domain, linked sets share a signature."""
    rng = np.random.default_rng(1)
    for similarity in (Fraction(9, 10), Fraction(4, 5)):
        for size in (4, 9, 25, 80, 300):
            for _ in range(12):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                b = a
                while True:  # change b as long as it stays linked
                    c = np.unique(np.r_[rng.permutation(b)[1:], rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)])
                    if len(np.intersect1d(a, c)) < similarity * len(np.union1d(a, c)):
                        break
                    b = c
                frequent = np.sort(rng.permutation(a)[: rng.integers(0, len(a) + 1)])
                bounds = np.array([0, len(a), len(a) + len(b)])
                bands = ngram_join.Bands.of(similarity, 1000)
                who, sig = ngram_join.signatures(np.r_[a, b], bounds, bands, frequent)
                assert np.array_equal(a, b) or set(sig[who == 0]) & set(sig[who == 1])


def test_chains_of_unlinked_sets_are_not_compared_all_with_all(spark, monkeypatch):
    """Each document shares signatures with the next one, but none is linked."""
    words = [f"w{i}" for i in range(20_000)]
    rows = [(i, " ".join(words[i * 75 : i * 75 + 300])) for i in range(200)] + [(900, " ".join(words[3:303]))]
    compared, made = [], ngram_join._tile_links

    def noted(members, *options, **more):
        groups = members.select("root", "n").distinct().collect()
        compared.append(sum(r["n"] ** 2 for r in groups))
        return made(members, *options, **more)

    monkeypatch.setattr(ngram_join, "_tile_links", noted)
    found = ngram_join.jaccard_components(frame(spark, rows), 1, Fraction(4, 5)).collect()
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert linked == {i: (300, 0 if i == 900 else i) for i, _ in rows}
    assert max(compared) < 20 * len(rows)


def test_large_groups_that_overlap_are_compared_once(spark):
    """40 groups of 80 among the same 100 sets, and two small ones of which one is joined."""
    rng = random.Random(7)
    groups = [(g, *sorted(rng.sample(range(100), 80))) for g in range(1, 41)] + [(50, 1, 200, 201), (51, 300, 301, 302)]
    pairs = spark.createDataFrame([(g, u, v) for g, u, *others in groups for v in others], "g long, u long, v long")
    stars = spark.createDataFrame([(300, 301), (300, 302), (1, 2)], "u long, v long")
    found = ngram_join.open_groups(pairs, stars).collect()
    sets = {}
    for r in found:
        sets.setdefault((r["root"], r["n"]), []).append((r["set_id"], r["label"]))
    assert sorted(n for _, n in sets) == [3, 100]
    assert all(len(own) == len(set(own)) == n for (_, n), own in sets.items())
    family = next(dict(own) for (_, n), own in sets.items() if n == 100)
    assert family[1] == family[2] and len(set(family.values())) == 99
    assert sorted(x for x, _ in sets[50, 3]) == [1, 200, 201]


def test_signatures_of_unlike_sets_rarely_meet():
    """Sets of 300 that have a tenth of their elements in common."""
    rng, met = np.random.default_rng(3), 0
    bands, none = ngram_join.Bands.of(Fraction(4, 5), 1000), np.zeros(0, np.uint64)
    for _ in range(200):
        common = rng.integers(0, 2**64, 30, np.uint64)
        a, b = (np.sort(np.r_[common, rng.integers(0, 2**64, 270, np.uint64)]) for _ in "ab")
        who, sig = ngram_join.signatures(np.r_[a, b], np.array([0, 300, 600]), bands, none)
        met += bool(set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()))
    assert met < 15


def test_histograms_tell_long_sets_apart():
    rng = np.random.default_rng(5)
    values = [np.sort(rng.integers(0, 2**64, n, np.uint64)) for n in (20_000, 20_000, 17_000, 16_000)]
    values[3] = np.sort(np.r_[values[2][:15_500], values[3][:500]])  # 0.89 alike, with another number of ranges
    bins = ngram_join.histograms(np.concatenate(values), np.r_[0, np.cumsum([len(v) for v in values])])
    a, b = bins[0].astype(int), bins[1].astype(int)
    assert np.abs(a - b).sum() > 40_000 / 9  # more than linked sets may differ
    sets = ngram_join._Sets(Fraction(4, 5), np.array([len(v) for v in values]), list(bins), None)
    assert sets.linked(0, np.array([1, 2, 3])).tolist() == []
    assert sets.linked(2, np.array([0, 1, 3])).tolist() == [3]
    assert sets.linked(3, np.array([0, 1, 2])).tolist() == [2]


def test_jaccard_edges(spark):
    docs = frame(spark, edge_rows())
    found = ngram_join.jaccard_components(docs, 5, Fraction(4, 5))
    rows = {r["doc_id"]: r["component_id"] for r in found.collect() if r["doc_id"] is not None}
    assert found.count() == docs.count()
    assert rows == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 10}
    kept = ngram_join.near_unique(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 6, 8, 8, 9, None, None, 10]))
    assert ngram_join.near_unique(frame(spark, [])).count() == 0


# lines


def test_line_bitmaps(spark):
    line = "this very line is long enough"
    rows = [*edge_rows(), *[(100 + i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nend\n{line}") for i in range(9)], (None, line)]
    docs = frame(spark, rows)
    got = {}
    for r in line_dedup.keep_bitmaps(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_dropped"], r["keep"]))
    assert got[108] == [(4, 0, None)] and got[1] == [(1, 0, None)] and got[2] == [(1, 0, None)]
    assert (1, 1) in [x[:2] for x in got[None]]
    for i in range(8):
        n, dropped, keep = got[100 + i][0]
        assert (n, dropped) == (4, 2)
        assert np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:4].tolist() == [1, 0, 1, 0]
    assert line_dedup.keep_bitmaps(frame(spark, [])).count() == 0
    assert line_dedup.apply_bitmap(b"a\nb\nc", 3, zlib.compress(np.packbits([1, 0, 1]).tobytes())) == b"a\nc"


def test_one_line_over_many_partitions(spark):
    """A line that all documents hold spreads over ranges and still keeps its last holder only."""
    rows = [(i, f"unique to {i} and long enough\nthe same line in every document") for i in range(400)]
    gone = {r["doc_id"]: r["n_dropped"] for r in line_dedup.keep_bitmaps(frame(spark, rows)).collect()}
    assert gone == {i: int(i < 399) for i in range(400)}


# passages


def test_passages_equal_plain_search(spark, small):
    rng = random.Random(9)
    shared = [sentence(rng, n) for n in (49, 50, 51, 90)]
    rows = list(small[:80])
    for i in range(60):
        parts = [sentence(rng, rng.randrange(30)), rng.choice(shared), sentence(rng, rng.randrange(20)), rng.choice(shared)]
        rows.append((5_000 + i, "  \n".join(parts)))
    rows += [(9_000 - i, shared[3] + " " + shared[3]) for i in range(20)]
    rows += [(9_500, None), (9_501, ""), (9_502, " "), (9_503, "word")]
    found = substring_dedup.remove_repeats(frame(spark, rows))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()}
    assert got == substring_dedup.brute_force(rows)


def test_passage_edges(spark):
    docs = frame(spark, edge_rows())
    rows = substring_dedup.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert got[6][:2] == (60_000, 0) or got[6][0] == got[6][1] + 0 or got[6][1] == 0
    assert got[7] == (60_000, 60_000, hashlib.sha256(b"").hexdigest())
    assert got[8][1] == 0  # rows of one doc_id do not repeat each other
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
