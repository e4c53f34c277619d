"""The registered queries of this subpackage, each next to its DuckDB twin."""

from __future__ import annotations

from folioflow.llm.bpe import op13_bpe
from folioflow.llm.centroids import OP11_SQL, op11_centroids
from folioflow.llm.chat import OP5_SQL, op5_chat_format
from folioflow.llm.collocations import OP12_SQL, op12_collocations
from folioflow.llm.decontaminate import OP10_SQL, op10_decontaminate
from folioflow.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from folioflow.llm.language_id import op9_language_id
from folioflow.llm.licenses import OP7_SQL, op7_license_scan
from folioflow.llm.mixing import OP4_SQL, op4_mix_sources
from folioflow.llm.ngram_join import op1_ngram_join
from folioflow.llm.secret_scan import op2_secret_scan
from folioflow.llm.suffix_dedup import op6_suffix_dedup
from folioflow.llm.url_filter import OP8_SQL, op8_url_filter

PLANS: dict = {
    "op1_ngram_join": (op1_ngram_join, None),
    "op2_secret_scan": (op2_secret_scan, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_mix_sources": (op4_mix_sources, OP4_SQL),
    "op5_chat_format": (op5_chat_format, OP5_SQL),
    "op6_suffix_dedup": (op6_suffix_dedup, None),
    "op7_license_scan": (op7_license_scan, OP7_SQL),
    "op8_url_filter": (op8_url_filter, OP8_SQL),
    "op9_language_id": (op9_language_id, None),
    "op10_decontaminate": (op10_decontaminate, OP10_SQL),
    "op11_centroids": (op11_centroids, OP11_SQL),
    "op12_collocations": (op12_collocations, OP12_SQL),
    "op13_bpe": (op13_bpe, None),
}
