"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from depscope.llm import (
    bpe, centroids, chat, fingerprints, hard_negatives, licenses, ngram_join, packing, quality_model, quality_rules, sharding, url_filters, warc,
)

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_bpe": bpe.op2_bpe,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_warc": warc.op4_warc,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_sharding": sharding.op6_sharding,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_classifier": quality_model.op8_quality_classifier,
    "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
    "op10_packing": packing.op10_packing,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_url_filters": url_filters.op12_url_filters,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_license_scan": licenses.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_ngram_jaccard": ngram_join.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_url_filters": url_filters.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
