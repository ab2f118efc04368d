"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import op10_chat_format
from .ibf_fingerprint import op9_document_fingerprints
from .language_id import op6_language_id
from .mixing import op2_source_mixing, op2_sql
from .quality import op4_quality_classifier
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op5_simhash
from .suffix_dedup import op3_suffix_dedup
from .topk_search import OP7_SQL, op7_topk_search
from .url_filter import OP8_SQL, op8_url_filters

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_source_mixing": op2_source_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_topk_search": op7_topk_search,
    "op8_url_filters": op8_url_filters,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL = {
    "op2_source_mixing": op2_sql(),
    "op7_topk_search": OP7_SQL,
    "op8_url_filters": OP8_SQL,
}
