"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from offerloom.llm.cross_parsing import op3_language_id
from offerloom.llm.fair_mix import op7_fair_mix
from offerloom.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from offerloom.llm.page_layout import op9_page_layout
from offerloom.llm.pivot_search import OP4_SQL, op4_pivot_search
from offerloom.llm.shingle_join import op12_jaccard_join
from offerloom.llm.simhash import op6_simhash
from offerloom.llm.string_kernel import op1_toxicity
from offerloom.llm.suffix_dedup import op5_suffix_dedup
from offerloom.llm.warc_archive import op8_warc
from offerloom.llm.weak_labels import op2_weak_labels
from offerloom.llm.whitening import op11_whitening
from offerloom.llm.winnowing import OP10_SQL, op10_winnowing

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_weak_labels": op2_weak_labels,
    "op3_language_id": op3_language_id,
    "op4_pivot_search": op4_pivot_search,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_fair_mix": op7_fair_mix,
    "op8_warc": op8_warc,
    "op9_page_layout": op9_page_layout,
    "op10_winnowing": op10_winnowing,
    "op11_whitening": op11_whitening,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op4_pivot_search": OP4_SQL,
    "op10_winnowing": OP10_SQL,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_hard_negatives": OP13_SQL,
}
