"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from subsida.llm import decontaminate, html_extract, language_id, line_dedup, mixing, packing, simhash, token_count, topk, url_filter
from subsida.llm.common import read

QUERIES = {
    "op1_line_dedup": lambda spark, d: line_dedup.op1_line_dedup(read(spark, d, "documents")),
    "op2_simhash": lambda spark, d: simhash.op2_simhash(read(spark, d, "documents")),
    "op3_url_filter": lambda spark, d: url_filter.op3_url_filter(read(spark, d, "pages")),
    "op4_token_count": lambda spark, d: token_count.op4_token_count(read(spark, d, "documents")),
    "op5_mixing": lambda spark, d: mixing.op5_mixing(read(spark, d, "documents")),
    "op6_packing": lambda spark, d: packing.op6_packing(read(spark, d, "documents")),
    "op7_language_id": lambda spark, d: language_id.op7_language_id(read(spark, d, "documents")),
    "op8_topk": lambda spark, d: topk.op8_topk(read(spark, d, "embeddings")),
    "op9_decontamination": lambda spark, d: decontaminate.op9_decontamination(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op10_html_extract": lambda spark, d: html_extract.op10_html_extract(read(spark, d, "pages")),
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op8_topk": topk.ORACLE,
}
