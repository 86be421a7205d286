"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from docframe.llm.decontamination import op3_positional_index
from docframe.llm.jaccard import op10_count_vector_rtree
from docframe.llm.lm_scoring import op7_pseudo_likelihood
from docframe.llm.oracles import ORACLES
from docframe.llm.pii import op5_weak_supervision_pii
from docframe.llm.quality import op8_host_quality
from docframe.llm.sharding import op9_feistel_sharding
from docframe.llm.substring_dedup import op2_super_kmer_dedup
from docframe.llm.suffix_dedup import op6_collection_bwt_dedup
from docframe.llm.tokenising import op1_max_plus_sentencepiece
from docframe.llm.url_filter import op4_host_trust

__all__ = ["ORACLES", "QUERIES"]


def of(query, *columns: str):
    """``query`` with the columns of its contract."""
    return lambda spark, sf_dir: query(spark, sf_dir).select(*columns)


QUERIES = {
    "op1_max_plus_sentencepiece": op1_max_plus_sentencepiece,
    "op2_super_kmer_dedup": op2_super_kmer_dedup,
    "op3_positional_index": of(op3_positional_index, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"),
    "op4_host_trust": op4_host_trust,
    "op5_weak_supervision_pii": op5_weak_supervision_pii,
    "op6_collection_bwt_dedup": op6_collection_bwt_dedup,
    "op7_pseudo_likelihood": op7_pseudo_likelihood,
    "op8_host_quality": of(op8_host_quality, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failures"),
    "op9_feistel_sharding": op9_feistel_sharding,
    "op10_count_vector_rtree": of(op10_count_vector_rtree, "doc_id", "n_shingles", "component_id"),
}
