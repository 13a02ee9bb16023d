"""Operators keep what is rare in the whole input: contexts, evidence, languages."""

from __future__ import annotations

import pickle
import random
import zlib
from fractions import Fraction

import pytest

from tests.llm.conftest import LONG, frame
from tradeloom.llm import langid, line_dedup, ngram_join, ppm, substring_dedup, toxicity
from tradeloom.llm import text as tx


def test_rare_contexts_count(spark):
    """Contexts below 1/200,000 of the training symbols, against a model without a cut."""
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:4]
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = [LONG, "Quixotic jugglers vex", "", "zebra quartz"]
    rows = [*zip(learnt, texts, strict=True), (out[0], "quixotic jugglers quartz"), (out[1], None)]
    assert len(LONG) > 200_000
    wanted = ppm.brute_force(rows)
    got = {r["doc_id"]: r["score"] for r in ppm.score(frame(spark, rows)).collect()}
    assert got == {i: pytest.approx(w[5], rel=1e-5) for i, w in wanted.items()}


def test_broadcast_part_is_sparse(spark):
    """No table of all symbols after each context reaches the driver."""
    rng = random.Random(3)
    text = "".join(chr(rng.randrange(1, 128)) for _ in range(300_000))
    trie = ppm.grow(frame(spark, [(1, text)]).select("text"))
    assert len(pickle.dumps(trie)) < 16_000_000


def test_rare_toxic_word_is_learnt(spark):
    """A word that 120 of 4,000 toxic documents hold, and under 5 of the sampled 60."""
    plain = [f"{a}{b}" for a in "abcdefgh" for b in "jklmnopq"]
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(plain) for _ in range(12))
    rows, labels, rare = [], [], [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5][:120]
    for i in range(8000):
        word = "" if i >= 4000 else " grimlok grimlok" if i in rare else " vile vile"
        rows.append((i, text() + word))
        labels.append((i, int(i < 4000)))
    rows.append((9000, text() + " grimlok grimlok"))
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sample=200)
    got = {r["doc_id"]: r["_score"] for r in toxicity.scored(docs, model).collect()}
    assert all(got[i] >= 0.5 for i in [*rare, 9000]) and sum(got[i] >= 0.5 for i in range(4000, 8000)) < 40


def test_toxic_scores_do_not_depend_on_the_sample(spark):
    """8,000 rows; of those with the word 42 % are toxic, of the others none."""
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in "abcdefgh" for b in "jklmnopq"]
    rows, labels = [], []
    for i in range(8000):
        word = rng.random() < 0.2
        toxic = int(word and rng.random() < 0.42)
        rows.append((i, " ".join(rng.choice(plain) for _ in range(10)) + (" vile" if word else "")))
        labels.append((i, toxic))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    means = []
    for sample in (500, 2000, 20_000):
        scores = toxicity.scored(docs, toxicity.train(docs, known, sample=sample)).collect()
        own = [r["_score"] for r in scores if "vile" in rows[r["doc_id"]][1]]
        means.append(sum(own) / len(own))
    assert max(means) - min(means) < 0.06 and abs(means[-1] - 0.42) < 0.03


def test_rare_language_is_learnt(spark):
    """Three rows among 12,000, with a sample of 200."""
    english, german = "the quick brown fox jumps over it", "über größere straßen läuft der fuchs"
    rows = [(i, f"{english} {i % 97}", "en") for i in range(12_000)] + [(20_000 + i, f"{german} {i}", "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, sample=200)
    got = {r["doc_id"]: r["_lang"] for r in langid.identify(docs.drop("lang"), model).collect()}
    assert model.languages == ["de", "en"] and {got[20_000 + i] for i in range(3)} == {"de"}
    assert sum(got[i] == "en" for i in range(12_000)) == 12_000


def test_sample_rates_never_vanish():
    shares = langid.shares_of({"en": 10**14, "de": 3, "fr": 10**9}, 4000)
    assert shares["de"] == langid._GRAIN
    assert all(shares[lang] * n // langid._GRAIN in range(150, 4100) for lang, n in (("en", 10**14), ("fr", 10**9)))


def doubling(n):
    """Two strings of 2**n letters that collide under every polynomial modulo 2**64."""
    one, two = "a", "b"
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


def test_strings_that_collide_under_polynomials(spark):
    a, b = doubling(11)
    assert len(a) == 2048 and a != b
    words = [a.encode(), b.encode()]
    assert tx.word_hash(words[0]) != tx.word_hash(words[1])
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    linked = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, 3, Fraction(9, 10)).collect()}
    assert linked == {1: 1, 2: 2, 3: 1}
    passage = " ".join(f"w{i}" for i in range(49))
    long = spark.createDataFrame([(1, f"{passage} {a}"), (2, f"{passage} {b}"), (3, f"{passage} {a}")], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(long).collect()}
    assert removed == {1: 0, 2: 0, 3: 50}


def test_lines_that_collide_under_polynomials(spark, tmp_path):
    a, b = doubling(11)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.query(spark, str(tmp_path)).collect()} == {1: 0, 2: 0, 3: 0}


def test_known_words_that_collide_under_polynomials(spark):
    a, b = doubling(11)
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][0]
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = {r["doc_id"]: r["n_known"] for r in ppm.score(frame(spark, [(learnt, a), (out[0], b), (out[1], a)])).collect()}
    # The end counts as a known token.
    assert got[out[0]] == 1 and got[out[1]] == 2
