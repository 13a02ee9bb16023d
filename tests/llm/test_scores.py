"""Models and counts: language-model scores, languages, toxicity, secrets, leaks and packing."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from checks.compare import compare
from tests.conftest import SMALL
from tests.llm.conftest import edge_rows, frame
from tradeloom.llm import decontam, langid, packing, ppm, secrets_scan, toxicity

MEDIUM = "/root/testdata/sf0.01"


# packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_bounds_are_the_best():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randrange(1, 9)
        lengths = np.array(rng.sample(range(1, 60), n))
        counts = np.array([rng.randrange(1, 9) for _ in range(n)])
        for k in range(1, n + 2):
            got = packing.best_bounds(lengths, counts, k)
            assert len(got) <= k and max(got) == lengths.max()
            rest = sorted(set(lengths.tolist()) - {int(lengths.max())})
            best = min(
                padding(lengths, counts, [*c, int(lengths.max())])
                for size in range(min(k, n))
                for c in itertools.combinations(rest, size)
            )
            assert padding(lengths, counts, got) == best


@pytest.mark.parametrize("source", ["small", "edges"])
def test_batches(spark, small, source):
    rows = small if source == "small" else edge_rows()
    budget, most = 4096, 512
    got = packing.pack(frame(spark, rows), buckets=4, budget=budget, max_len=most).collect()
    tokens = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for _, t in rows)
    pieces = [min(most, n - at) for n in tokens for at in range(0, n, most)]
    assert sorted(r["n_tokens"] for r in got) == sorted(pieces)
    bounds = sorted({r["bucket_len"] for r in got})
    lengths, counts = np.unique(pieces, return_counts=True)
    best = packing.best_bounds(lengths, counts, 4)
    assert bounds == best
    batches = {}
    for r in got:
        assert r["bucket_len"] == min(b for b in bounds if b >= r["n_tokens"])
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), own in batches.items():
        full = budget // own[0]["bucket_len"]
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and len(own) <= full
        assert len(own) == full or (bucket, batch + 1) not in batches


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, [])).count() == 0


# language model


def test_scores_equal_dictionaries(spark, small):
    rows = [*small[:60], *[(i, t) for i, t in edge_rows() if i not in (6, 7, 8, None)]]
    rows = list({i + 1000 * (n > 59): (i + 1000 * (n > 59), t) for n, (i, t) in enumerate(rows)}.values())
    wanted = ppm.brute_force(rows)
    got = {r["doc_id"]: r for r in ppm.score(frame(spark, rows)).collect()}
    assert got.keys() == wanted.keys()
    for i, (out, n, known, total, base, score) in wanted.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-5)


def test_rows_are_distributions(spark, small):
    trie = ppm.grow(frame(spark, small).select("text"))
    others = ppm.SYMBOLS - (trie.rows[1].shape[1] - 1)
    for rows in trie.rows.values():
        p = 10.0 ** rows.astype(np.float64)
        assert np.allclose(p[:, :-1].sum(1) + others * p[:, -1], 1, atol=1e-4)


def test_score_edges(spark):
    docs = frame(spark, edge_rows())
    rows = ppm.score(docs).collect()
    assert len(rows) == docs.count() and all(r["score"] < 0 and r["base_score"] <= 0 for r in rows)
    assert ppm.score(frame(spark, [])).count() == 0
    alone = ppm.score(docs, modulus=1, held_out=0).collect()  # nothing to learn from
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone)
    assert {round(r["score"] / (r["n_bytes"] + 1), 6) for r in alone} == {round(-math.log10(257), 6)}


# languages


def test_languages_of_held_out_texts(spark):
    langs = {r[0]: r[1] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in langid.query(spark, MEDIUM).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_edges(spark):
    docs = frame(spark, edge_rows())
    model = langid.train(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang"))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: (r["_lang"], r["_score"]) for r in rows}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.languages
    none = langid.train(docs.selectExpr("doc_id", "text", "lang"))
    assert none is None and {r["_lang"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(frame(spark, []), model).count() == 0


def test_ftrl_leaves_useless_weights_zero():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 5 + int(rng.integers(20))]), np.array([1.0, 0.01]), y) for y in rng.integers(0, 2, 400)]
    w = langid.ftrl(rows, 2)
    assert (w[5:25] == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]


def test_temperature_of_overconfident_logits():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    z = np.zeros((4000, 2))
    z[np.arange(4000), np.where(rng.random(4000) < 0.8, y, 1 - y)] = 10.0
    assert langid.calibrate(z, y) == pytest.approx(10 / math.log(4), rel=0.1)


# toxicity


def chains(n):
    return itertools.product((0, 1), repeat=n)


def test_forward_backward_equals_enumeration():
    field = toxicity.Field.of(np.array([-2.0, -0.7, 0.3, 1.1, 0.5, 1.5, 2.5, 3.5]))
    rng = random.Random(4)
    lengths, ats, grades = [], [], []
    for _ in range(25):
        n = rng.randrange(0, 8)
        at = sorted(rng.sample(range(n), rng.randrange(n + 1)))
        lengths.append(n)
        ats.append(at)
        grades.append([rng.randrange(1, 5) for _ in at])
    seq = toxicity.Sequences(
        np.array(lengths), np.r_[0, np.cumsum([len(a) for a in ats])],
        np.array(sum(ats, []), np.int64), np.array(sum(grades, []), np.int64),
    )
    logz, marginals = field.run(seq)
    jump = {(0, 0): 0.0, (0, 1): field.enter, (1, 0): field.leave, (1, 1): field.stay}
    place = 0
    for i, (n, at, grade) in enumerate(zip(lengths, ats, grades, strict=True)):
        bonus = dict(zip(at, (field.grades[g] for g in grade), strict=True))
        weights = {
            path: math.exp(sum(jump[a, b] + b * (field.bias + bonus.get(t, 0.0)) for t, (a, b) in enumerate(zip((0, *path), path, strict=False))))
            for path in chains(n)
        }
        total = sum(weights.values())
        assert logz[i] == pytest.approx(math.log(total), abs=1e-9)
        for t in at:
            wanted = sum(w for path, w in weights.items() if path[t]) / total
            assert marginals[place] == pytest.approx(wanted, abs=1e-9)
            place += 1


def toy(spark):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice("abcdefghijklm") * rng.randrange(3, 9) for _ in range(rng.randrange(5, 60)))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = plain()
        if bad:
            text += " " + " ".join(rng.choice(["Vile", "rottenness", "rottenly"]) for _ in range(3)) + ". " + plain()
        rows.append((i, text))
        labels.append((i, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_documents_and_offsets(spark):
    rows, labels = toy(spark)
    docs = frame(spark, rows)
    found = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == 600
    for r in found:
        assert (r["_score"] >= 0.5) == (r["doc_id"] % 4 == 0)
        spans = [r["text"].encode()[s["start"] : s["end"]].decode() for s in r["_spans"]]
        assert bool(spans) == (r["doc_id"] % 4 == 0)
        assert all(set(re.findall(r"\w+", s)) <= {"Vile", "rottenness", "rottenly"} for s in spans)
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 450


def test_toxicity_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, MEDIUM).collect() if r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"]]) > 0.93


def test_toxicity_edges(spark):
    rows, labels = toy(spark)
    model = toxicity.train(frame(spark, rows), labels)
    docs = frame(spark, edge_rows())
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["_score"] < 0.5 for r in got)
    odd = labels.selectExpr("doc_id", "cast(null as int) as toxic")
    assert toxicity.train(docs, odd) is None
    assert {r["_score"] for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert toxicity.scored(frame(spark, []), model).count() == 0


# secrets


def test_secrets_equal_sql(spark):
    assert compare(spark, SMALL, "secrets", secrets_scan.query, secrets_scan.ORACLE) == ""


def test_secret_spans(spark):
    shared, own = "AKIA" + "Z9" * 10, "q8Rt5Yw2Lp0Xs7Vb3Nc6Mk"
    texts = {
        1: ("a/x", f"é password = 'hunter2!' then {shared} end"), 2: ("b/x", f"{shared} token:abc secret=abcdef"),
        3: ("c/x", shared), 4: ("a/y", f"plain {own} here"), 5: ("a/z", f"deadbeef{'0' * 16} PASSWD:  x"),
        6: (None, None), 7: ("d", ""), 8: ("d", "api_key==tok api-key=1234567 " + "ab" * 3000),
    }
    docs = frame(spark, [(i, t) for i, (_, t) in texts.items()])
    sources = spark.createDataFrame([(i, s) for i, (s, _) in texts.items()], "doc_id long, source string")
    rows = secrets_scan.scan(docs.drop("source").join(sources, "doc_id")).collect()
    got = {r["doc_id"]: [(secrets_scan.KINDS[s["kind"]], s["start"], s["end"], s["live"], s["n_owners"]) for s in r["spans"] or []] for r in rows}
    assert [s[:3] for s in got[1]] == [("assign", 2, 21), ("access", 29, 53)]
    assert got[3] == [("access", 0, 24, False, 3)]  # three owners: widely copied
    assert [s[:3] for s in got[2]] == [("access", 0, 24), ("assign", 35, 48)]
    assert got[4] == [("opaque", 6, 28, True, 1)]
    assert [s[:3] for s in got[5]] == [("hex", 0, 24)]
    assert got[6] == got[7] == []
    for i, (_, text) in texts.items():
        wanted = [(m.start(), m.end()) for m in re.finditer(secrets_scan.ASSIGN, text or "") if len(m[2]) >= 6]
        assert [s[1:3] for s in got[i] if s[0] == "assign"] == wanted


def test_secret_edges(spark):
    assert secrets_scan.scan(frame(spark, edge_rows())).count() == len(edge_rows())
    assert secrets_scan.scan(frame(spark, [])).count() == 0


# leaks


@pytest.mark.parametrize("block", [100_000, 7])
def test_leaks_equal_plain_search(spark, small, monkeypatch, block):
    monkeypatch.setattr(decontam, "WINDOWS_PER_BLOCK", block)
    words = "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    items = [(1, " ".join(words)), (2, "short item"), (3, None), (4, "..."), (5, " ".join(words[2:])), (5, "short item"), (6, "Mu")]
    rows = [
        *small[:15], (900, "x " + "-".join(words).upper() + " y"), (901, "a short, ITEM b mu"), (902, " ".join(words[:9])),
        (903, None), (904, ""), (905, " ".join(words) + " " + " ".join(words[1:11])),
    ]
    found = decontam.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()}
    wanted = decontam.brute_force(rows, items)
    assert {i: (n, hit, len(names)) for i, (n, hit, names) in got.items()} == {i: w[:3] for i, w in wanted.items()}
    assert got[905][2] == ["1", "5", "6"] and got[901][2] == ["2", "5", "6"]


def test_leaks_of_the_test_tables(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in decontam.query(spark, SMALL).collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows}
    assert got == decontam.brute_force(small, items)


def test_leak_edges(spark):
    items = spark.createDataFrame([(None, "one two three four five six seven"), (1, "zwei Wörter")], "item_id long, text string")
    docs = frame(spark, edge_rows())
    rows = decontam.decontaminate(docs, items).collect()
    assert len(rows) == docs.count()
    assert sorted((r["doc_id"], r["n_hit"], len(r["items"])) for r in rows if r["n_hit"]) == [(8, 2, 1), (8, 2, 1), (10, 7, 0), (11, 7, 0)]
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean_documents(docs, nothing).count() == docs.count()
    assert decontam.decontaminate(frame(spark, []), items).count() == 0


def test_word_tokens_of_nulls():
    assert packing.word_tokens(pa.array(["a b", None, ""], pa.string())).tolist() == [3, 1, 1]
