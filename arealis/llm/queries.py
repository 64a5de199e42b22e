"""The queries of this folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .html import op7_html
from .lines import op5_lines
from .media import op10_media
from .mixing import SQL as MIXING_SQL
from .mixing import op6_mixing
from .neardup import op2_near_duplicates
from .pieces import op1_pieces
from .pii import op8_pii
from .quality import op4_quality
from .suffix import op3_suffix
from .toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_pieces,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_suffix_dedup": op3_suffix,
    "op4_quality_rules": op4_quality,
    "op5_line_dedup": op5_lines,
    "op6_mixing": op6_mixing,
    "op7_html_text": op7_html,
    "op8_pii_spans": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_media_columns": op10_media,
}

ORACLE_SQL: dict[str, str] = {"op6_mixing": MIXING_SQL}
