"""The registered queries of this folder and their DuckDB counterparts."""

from __future__ import annotations

from llm import (
    arc_convert,
    byte_bpe,
    cross_parsing,
    exact_dedup,
    html_layout,
    hyperminhash,
    importance_resampling,
    line_dedup,
    multi_index,
    ppm,
    pu_quality,
    spelling_variants,
    vector_packing,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_hyperminhash": hyperminhash.op2,
    "op3_pu_quality": pu_quality.op3,
    "op4_vector_packing": vector_packing.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_arc_to_warc": arc_convert.op6,
    "op7_multi_index": multi_index.op7,
    "op8_byte_bpe": byte_bpe.op8,
    "op9_html_layout": html_layout.op9,
    "op10_ppm": ppm.op10,
    "op11_spelling_variants": spelling_variants.op11,
    "op12_importance_resampling": importance_resampling.op12,
    "op13_cross_parsing": cross_parsing.op13,
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op6_arc_to_warc": arc_convert.OP6_SQL,
    "op11_spelling_variants": spelling_variants.OP11_SQL,
    "op12_importance_resampling": importance_resampling.OP12_SQL,
}
