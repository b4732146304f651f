"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op01_lines, op02_packing, op03_tokenstore, op04_jaccard, op05_media, op06_counts, op07_licenses, op08_mixing, op09_toxicity, op10_exact

QUERIES = {
    "op1_line_dedup": op01_lines.op1_line_dedup,
    "op2_packing": op02_packing.op2_packing,
    "op3_token_store": op03_tokenstore.op3_token_store,
    "op4_jaccard_join": op04_jaccard.op4_jaccard_join,
    "op5_media": op05_media.op5_media,
    "op6_token_counts": op06_counts.op6_token_counts,
    "op7_licenses": op07_licenses.op7_licenses,
    "op8_mixing": op08_mixing.op8_mixing,
    "op9_toxicity": op09_toxicity.op9_toxicity,
    "op10_exact_dedup": op10_exact.op10_exact_dedup,
}
SQL = {
    "op4_jaccard_join": op04_jaccard.SQL,
    "op10_exact_dedup": op10_exact.SQL,
}
