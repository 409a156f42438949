"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from plumbline.llm import decontaminate, substring_dedup, warc
from plumbline.llm.bpe_stream import op3_bpe_stream
from plumbline.llm.dart_minhash import op6_dart_minhash
from plumbline.llm.decontaminate import op10_winnowing
from plumbline.llm.quality_bands import op7_quality_bands
from plumbline.llm.substring_dedup import op2_substring_dedup
from plumbline.llm.suffix_tree_lm import op1_suffix_tree_lm
from plumbline.llm.token_files import op4_token_files
from plumbline.llm.toxicity_knn import op8_toxicity_knn
from plumbline.llm.url_rules import op9_url_rules
from plumbline.llm.warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_lm": op1_suffix_tree_lm,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe_stream": op3_bpe_stream,
    "op4_token_files": op4_token_files,
    "op5_warc": op5_warc,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_quality_bands": op7_quality_bands,
    "op8_toxicity_knn": op8_toxicity_knn,
    "op9_url_rules": op9_url_rules,
    "op10_winnowing": op10_winnowing,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {"op2_substring_dedup": substring_dedup.SQL, "op5_warc": warc.SQL, "op10_winnowing": decontaminate.SQL}
