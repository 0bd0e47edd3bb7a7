"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm.align import op13_align
from vectorloom.llm.bpe import op3_bpe
from vectorloom.llm.decontaminate import OP2_SQL, op2_decontaminate
from vectorloom.llm.language import op12_language
from vectorloom.llm.lines import OP5_SQL, op5_lines
from vectorloom.llm.neighbours import op9_neighbours
from vectorloom.llm.pages import op4_html
from vectorloom.llm.pii import op1_pii
from vectorloom.llm.secrets import op7_secrets
from vectorloom.llm.simhash import op6_simhash
from vectorloom.llm.toxicity import op8_toxicity
from vectorloom.llm.variants import OP11_SQL, op11_variants
from vectorloom.llm.warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_html": op4_html,
    "op5_lines": op5_lines,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_neighbours": op9_neighbours,
    "op10_warc": op10_warc,
    "op11_variants": op11_variants,
    "op12_language": op12_language,
    "op13_align": op13_align,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op5_lines": OP5_SQL,
    "op10_warc": OP10_SQL,
    "op11_variants": OP11_SQL,
}
