"""The registered queries of this subpackage, and their checking SQL."""

from __future__ import annotations

from duelframe.llm import collocations, forest, languages, licences, mixing, near_copies, near_vectors, packing, repair, sharding, token_files, toxicity, urls

QUERIES = {
    "op1_licence_sentences": licences.digest,
    "op2_hilbert_shards": sharding.digest,
    "op3_toxic_segments": toxicity.digest,
    "op4_near_copies": near_copies.digest,
    "op5_url_trust": urls.digest,
    "op6_token_files": token_files.digest,
    "op7_mixing": mixing.digest,
    "op8_near_vectors": near_vectors.digest,
    "op9_best_fit_packing": packing.digest,
    "op10_projection_forest": forest.digest,
    "op11_language_id": languages.digest,
    "op12_collocations": collocations.digest,
    "op13_conversation_repair": repair.digest,
}

ORACLES = {
    "op1_licence_sentences": licences.SQL,
    "op4_near_copies": near_copies.SQL,
    "op5_url_trust": urls.SQL,
    "op7_mixing": mixing.SQL,
    "op12_collocations": collocations.SQL,
}
