"""The pipeline against plain decisions, stage by stage, and the registered names."""

from __future__ import annotations

import re
from fractions import Fraction

import corpus_pipeline

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.llm.conftest import edge_rows, frame
from tradeloom.llm import decontam, ngram_join

COLUMNS = {
    "op2": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op4": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op5": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op6": {"doc_id", "held_out", "lang_pred", "score"},
    "op7": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op8": {"doc_id", "n_shingles", "component_id"},
    "op9": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10": {"doc_id", "held_out", "score", "predicted"},
}


def test_every_operator_is_registered(spark):
    queries = entry.queries()
    assert "pipeline" in queries
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for n in range(1, 11):
        (name,) = [q for q in queries if q.startswith(f"op{n}_")]
        df = queries[name](spark, SMALL)
        assert COLUMNS.get(f"op{n}", set()) <= set(df.columns), name
        assert n == 1 or df.count() == rows, name


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]
    pairs = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    mild = stages["toxicity"](spark, docs, SMALL)
    unique = stages["exact_dedup"](spark, docs, SMALL)
    apart = stages["ngram_jaccard"](spark, docs, SMALL)
    clean = stages["decontamination"](spark, docs, SMALL)
    assert all(df.columns == columns for df in (mild, unique, apart, clean))
    every = pairs(docs)
    low = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t) for i, t in every.items()}
    assert pairs(unique).keys() == {max(j for j in low if low[j] == t) for t in low.values()}
    near = ngram_join.brute_force(list(every.items()), 5, Fraction(4, 5))
    assert pairs(apart).keys() == {i for i, (_, top) in near.items() if i == top}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = decontam.brute_force(list(every.items()), items)
    assert pairs(clean).keys() == {i for i, w in leaks.items() if not w[1]}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    dropped = every.keys() - pairs(mild).keys()
    assert sum(labels.get(i, 1) == 0 for i in dropped) <= 1


def test_run_packs_what_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
    tokens = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) + 1 for r in docs.collect()}
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == tokens


def test_stages_take_odd_documents(spark):
    docs = frame(spark, edge_rows())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
        assert stage(spark, frame(spark, []), SMALL).count() == 0
