"""Registered queries of the training-data operators."""

from __future__ import annotations

from .chat_format import OP6_SQL, op6_chat_formatting
from .collocations import OP12_SQL, op12_phrase_collocations
from .decontamination import OP9_SQL, op9_benchmark_decontamination
from .line_dedup import OP7_SQL, op7_line_dedup
from .packing import op3_packing
from .quality_rules import OP2_SQL, op2_quality_rules
from .quality_classifier import op4_quality_classifier
from .ranked_search import OP11_SQL, op11_ranked_lexical_search
from .simhash import op1_simhash_near_dedup
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .toxicity import op10_toxicity
from .url_filters import OP5_SQL, op5_url_filters
from .warc import OP13_SQL, op13_warc

QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_rules, op3_packing, op4_quality_classifier, op5_url_filters, op6_chat_formatting, op7_line_dedup, op8_substring_dedup, op9_benchmark_decontamination, op10_toxicity, op11_ranked_lexical_search, op12_phrase_collocations, op13_warc)}
ORACLES = {"op2_quality_rules": OP2_SQL, "op5_url_filters": OP5_SQL, "op6_chat_formatting": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_ranked_lexical_search": OP11_SQL, "op12_phrase_collocations": OP12_SQL, "op13_warc": OP13_SQL}
