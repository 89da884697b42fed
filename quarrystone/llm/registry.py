"""Queries of the operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from quarrystone.llm import conversation_repair, exact_topk, license_scan, oracles, ranked_search, url_templates
from quarrystone.llm.balanced_packing import op11_balanced_packing
from quarrystone.llm.conversation_repair import op13_conversation_repair
from quarrystone.llm.exact_topk import op4_exact_topk
from quarrystone.llm.license_scan import op9_license_scan
from quarrystone.llm.near_dedup import op5_near_dedup
from quarrystone.llm.packing import op7_packing
from quarrystone.llm.ranked_search import op12_ranked_search
from quarrystone.llm.sentencepiece_bpe import op8_sentencepiece
from quarrystone.llm.substring_dedup import op6_substring_dedup
from quarrystone.llm.suffix_dedup import op2_suffix_dedup
from quarrystone.llm.toxicity import op10_toxicity
from quarrystone.llm.url_templates import op3_url_templates
from quarrystone.llm.vp_tree import op1_vp_tree

QUERIES = {
    f.__name__: f
    for f in (
        op1_vp_tree, op2_suffix_dedup, op3_url_templates, op4_exact_topk, op5_near_dedup, op6_substring_dedup, op7_packing, op8_sentencepiece, op9_license_scan, op10_toxicity,
        op11_balanced_packing, op12_ranked_search, op13_conversation_repair,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": oracles.OP2,
    "op3_url_templates": url_templates.oracle(),
    "op4_exact_topk": exact_topk.OP4_SQL,
    "op5_near_dedup": oracles.OP5,
    "op6_substring_dedup": oracles.OP6,
    "op9_license_scan": license_scan.oracle(),
    "op12_ranked_search": ranked_search.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
