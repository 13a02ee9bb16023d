"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tradeloom.llm import (
    decontam,
    exact_dedup,
    hard_negatives,
    langid,
    line_dedup,
    ngram_join,
    packing,
    ppm,
    secrets_scan,
    spelling,
    substring_dedup,
    toxicity,
    warc,
)

_OPERATORS = {
    "op1_packing": packing,
    "op2_ppm_score": ppm,
    "op3_secret_ownership": secrets_scan,
    "op4_decontamination": decontam,
    "op5_exact_dedup": exact_dedup,
    "op6_language_id": langid,
    "op7_line_dedup": line_dedup,
    "op8_ngram_jaccard": ngram_join,
    "op9_substring_dedup": substring_dedup,
    "op10_toxic_spans": toxicity,
    "op11_warc_packages": warc,
    "op12_spelling_variants": spelling,
    "op13_hard_negatives": hard_negatives,
}


def queries() -> dict:
    operators = {name: module.query for name, module in _OPERATORS.items()}
    return operators | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: module.ORACLE for name, module in _OPERATORS.items() if module.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
