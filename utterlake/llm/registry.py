"""Queries of this subpackage and their SQL."""

from utterlake.llm import (
    alignment,
    centroids,
    fingerprints,
    jaccard_join,
    minhash_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece_sampling,
    substring_dedup,
    toxicity,
    url_filters,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_sentencepiece_sampling": sentencepiece_sampling.op4_sentencepiece_sampling,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_pii": pii.op10_pii,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_minhash_dedup": minhash_dedup.op12_minhash_dedup,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op3_url_filters": url_filters.SQL,
    "op5_ngram_jaccard_join": jaccard_join.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op12_minhash_dedup": minhash_dedup.SQL,
    "op13_centroid_clustering": centroids.SQL,
}
