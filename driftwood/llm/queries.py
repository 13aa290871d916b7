"""Name -> (query, DuckDB SQL or None) for the operators of this subpackage."""

from __future__ import annotations

from driftwood.llm.decontaminate import op10_winnowing_decontamination
from driftwood.llm.embeddings import op1_hnsw_near_dedup
from driftwood.llm.html_text import op8_html_main_text
from driftwood.llm.manifest import OP13_SQL, op13_merkle_manifest
from driftwood.llm.mixing import OP11_SQL, op11_source_mixing
from driftwood.llm.near_duplicates import op5_minhash_near_dedup
from driftwood.llm.packing import op2_cutting_stock_packing
from driftwood.llm.pii import op6_pii_surrogates
from driftwood.llm.quality import op3_quality_scores
from driftwood.llm.quantiles import op12_quantile_splines
from driftwood.llm.repeats import op7_suffix_array_dedup
from driftwood.llm.sharding import OP4_SQL, op4_extendible_sharding
from driftwood.llm.url_rules import OP9_SQL, op9_url_rules

QUERIES = {
    "op1_hnsw_near_dedup": (op1_hnsw_near_dedup, None),
    "op2_cutting_stock_packing": (op2_cutting_stock_packing, None),
    "op3_quality_scores": (op3_quality_scores, None),
    "op4_extendible_sharding": (op4_extendible_sharding, OP4_SQL),
    "op5_minhash_near_dedup": (op5_minhash_near_dedup, None),
    "op6_pii_surrogates": (op6_pii_surrogates, None),
    "op7_suffix_array_dedup": (op7_suffix_array_dedup, None),
    "op8_html_main_text": (op8_html_main_text, None),
    "op9_url_rules": (op9_url_rules, OP9_SQL),
    "op10_winnowing_decontamination": (op10_winnowing_decontamination, None),
    "op11_source_mixing": (op11_source_mixing, OP11_SQL),
    "op12_quantile_splines": (op12_quantile_splines, None),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
