"""The registered queries of this subpackage, and the same in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from feedlode.llm.decontaminate import OP3_SQL, op3_decontamination
from feedlode.llm.fill_middle import OP11_SQL, op11_fill_middle
from feedlode.llm.licenses import op1_licenses
from feedlode.llm.line_dedup import op6_line_dedup
from feedlode.llm.near_join import OP8_SQL, op8_near_duplicates
from feedlode.llm.pieces import op2_sentencepiece
from feedlode.llm.quality import op5_quality
from feedlode.llm.spelling import op12_spelling_variants
from feedlode.llm.suffix_dedup import op13_suffix_dedup
from feedlode.llm.suffix_tree import op4_lm_score
from feedlode.llm.target_rules import op10_quality_rules
from feedlode.llm.toxicity import op7_toxicity
from feedlode.llm.url_templates import op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_lm_score": op4_lm_score,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_middle": op11_fill_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_suffix_dedup": op13_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op11_fill_middle": OP11_SQL,
}
