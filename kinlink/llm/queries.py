"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.op01_quality import op1_quality
from kinlink.llm.op02_tokens import op2_token_counts
from kinlink.llm.op03_neighbours import op3_neighbours
from kinlink.llm.op04_pieces import op4_sentencepiece
from kinlink.llm.op05_language import op5_language
from kinlink.llm.op06_lists import OP6_SQL, op6_url_lists
from kinlink.llm.op07_topk import OP7_SQL, op7_topk
from kinlink.llm.op08_copies import op8_near_copies
from kinlink.llm.op09_mixture import OP9_SQL, op9_mixture
from kinlink.llm.op10_private import OP10_SQL, op10_private

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_neighbours": op3_neighbours,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language": op5_language,
    "op6_url_lists": op6_url_lists,
    "op7_topk": op7_topk,
    "op8_near_copies": op8_near_copies,
    "op9_mixture": op9_mixture,
    "op10_private": op10_private,
}

ORACLE_SQL: dict[str, str] = {"op6_url_lists": OP6_SQL, "op7_topk": OP7_SQL, "op9_mixture": OP9_SQL, "op10_private": OP10_SQL}
