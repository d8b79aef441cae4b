"""The registered queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.suffix_dedup import op1_suffix_dedup
from basketry.llm.conversation_repair import op13_conversation_repair
from basketry.llm.chat_format import op6_chat_format
from basketry.llm.decontamination import op10_decontamination
from basketry.llm.language_id import op5_language_id
from basketry.llm.lm_score import op2_lm_score
from basketry.llm.near_dedup import op9_near_dedup
from basketry.llm.packing import op3_best_fit_packing
from basketry.llm.private_data import op7_private_data
from basketry.llm.quality_rules import OP4_SQL, op4_quality_rules
from basketry.llm.source_divergence import OP11_SQL, op11_source_divergence
from basketry.llm.source_mixing import OP12_SQL, op12_source_mixing
from basketry.llm.substring_dedup import op8_substring_dedup

_ALL = [
    op1_suffix_dedup,
    op2_lm_score,
    op3_best_fit_packing,
    op4_quality_rules,
    op5_language_id,
    op6_chat_format,
    op7_private_data,
    op8_substring_dedup,
    op9_near_dedup,
    op10_decontamination,
    op11_source_divergence,
    op12_source_mixing,
    op13_conversation_repair,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        op4_quality_rules.__name__: OP4_SQL,
        op11_source_divergence.__name__: OP11_SQL,
        op12_source_mixing.__name__: OP12_SQL,
    }
