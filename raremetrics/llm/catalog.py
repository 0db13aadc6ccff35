"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from raremetrics.llm.bpe import op5_bpe
from raremetrics.llm.fim import OP11_SQL, op11_fill_in_middle
from raremetrics.llm.jaccard import op6_ngram_jaccard_join
from raremetrics.llm.license_scan import op1_license_scan
from raremetrics.llm.packing import op9_best_fit_packing
from raremetrics.llm.quality_classifier import op4_quality_classifier
from raremetrics.llm.quality_rules import op2_quality_rules
from raremetrics.llm.simhash import op12_simhash
from raremetrics.llm.suffixes import op8_suffix_dedup
from raremetrics.llm.syncmers import op10_syncmers
from raremetrics.llm.toxicity import op3_toxicity
from raremetrics.llm.warc import OP7_SQL, op7_warc
from raremetrics.llm.whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_toxicity, op4_quality_classifier, op5_bpe,
                                   op6_ngram_jaccard_join, op7_warc, op8_suffix_dedup, op9_best_fit_packing,
                                   op10_syncmers, op11_fill_in_middle, op12_simhash, op13_embedding_whitening)}

ORACLE: dict[str, str] = {"op7_warc": OP7_SQL, "op11_fill_in_middle": OP11_SQL}
