"""Registered corpus queries, and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, language, licenses, mixture, phrases, pii, quality, simhash, spelling, tokens, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_mixture": mixture.op1_mixture,
    "op2_tokens": tokens.op2_tokens,
    "op3_quality": quality.op3_quality,
    "op4_licenses": licenses.op4_licenses,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_language": language.op7_language,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_pii": pii.op9_pii,
    "op10_simhash": simhash.op10_simhash,
    "op11_urls": urls.op11_urls,
    "op12_spelling": spelling.op12_spelling,
    "op13_phrases": phrases.op13_phrases,
}

# Tokenizers, fitted models and XXH64 are not in SQL: operators 2, 3, 5, 7 and 10 are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_mixture": mixture.OP1_SQL,
    "op4_licenses": licenses.OP4_SQL,
    "op6_embeddings": embeddings.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_pii": pii.OP9_SQL,
    "op11_urls": urls.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
