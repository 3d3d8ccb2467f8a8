"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from skeinql.llm import op01_near_dedup, op02_language_id, op03_embedding_dedup, op04_token_store, op05_token_counts, op06_mixing, op07_warc_fixity, op08_toxicity, op09_decontaminate, op10_url_filter

QUERIES = {
    "op1_near_dedup": op01_near_dedup.query,
    "op2_language_id": op02_language_id.query,
    "op3_embedding_dedup": op03_embedding_dedup.query,
    "op4_token_store": op04_token_store.query,
    "op5_token_counts": op05_token_counts.query,
    "op6_mixing": op06_mixing.query,
    "op7_warc_fixity": op07_warc_fixity.query,
    "op8_toxicity": op08_toxicity.query,
    "op9_decontaminate": op09_decontaminate.query,
    "op10_url_filter": op10_url_filter.query,
}
ORACLES = {"op3_embedding_dedup": op03_embedding_dedup.ORACLE, "op7_warc_fixity": op07_warc_fixity.ORACLE, "op9_decontaminate": op09_decontaminate.ORACLE, "op10_url_filter": op10_url_filter.ORACLE}
