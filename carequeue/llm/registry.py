"""Queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carequeue.llm import decontaminate, merkle
from carequeue.llm.alignment import op12_align
from carequeue.llm.bpe import op3_bpe
from carequeue.llm.decontaminate import op2_decontaminate
from carequeue.llm.language import language_of_pages, op8_language
from carequeue.llm.merkle import op11_merkle
from carequeue.llm.neighbours import op5_neighbours
from carequeue.llm.ngram_join import op13_similar
from carequeue.llm.pages import op6_pages
from carequeue.llm.secrets import op10_secrets
from carequeue.llm.simhash import op1_simhash
from carequeue.llm.token_files import op4_token_files
from carequeue.llm.toxicity import op7_toxicity
from carequeue.llm.token_counts import op9_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_token_files": op4_token_files,
    "op5_neighbours": op5_neighbours,
    "op6_pages": op6_pages,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_token_counts": op9_token_counts,
    "op10_secrets": op10_secrets,
    "op11_merkle": op11_merkle,
    "op12_align": op12_align,
    "op13_similar": op13_similar,
    "language_of_pages": language_of_pages,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op11_merkle": merkle.ORACLE,
}
