"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from haulspark.llm.collocations import OP11_SQL, op11_collocations
from haulspark.llm.embedding_dedup import OP4_SQL, op4_embedding_dedup
from haulspark.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from haulspark.llm.mixing import op2_mix_sources
from haulspark.llm.near_dedup import OP1_SQL, op1_near_dedup
from haulspark.llm.pii import op9_pii
from haulspark.llm.quality import op6_quality_classifier
from haulspark.llm.sentencepiece_codec import op7_sentencepiece
from haulspark.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from haulspark.llm.top_products import OP12_SQL, op12_top_products
from haulspark.llm.url_filter import OP3_SQL, op3_url_filter
from haulspark.llm.vector_codes import OP13_SQL, op13_vector_codes
from haulspark.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_url_filter": op3_url_filter,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_top_products": op12_top_products,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op1_near_dedup": OP1_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op10_warc": OP10_SQL,
    "op3_url_filter": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_top_products": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
