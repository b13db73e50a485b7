"""Registered queries of the training-data operators, and their SQL.

Queries without SQL are tested against brute force, held-out labels or exact
round trips in ``tests/llm``.
"""

from __future__ import annotations

from . import bpe, bytecnn, ctph, editmatch, mixing, nbsvm, prefixtrie, secrets, sharding, simhash, toxcnn, warc, whitening

QUERIES = {
    "op1_quality_nbsvm": nbsvm.op1_quality_nbsvm,
    "op2_sharding_lpt": sharding.op2_sharding_lpt,
    "op3_warc": warc.op3_warc,
    "op4_langid_bytecnn": bytecnn.op4_langid_bytecnn,
    "op5_decontamination_edit": editmatch.op5_decontamination_edit,
    "op6_toxicity_cnn": toxcnn.op6_toxicity_cnn,
    "op7_secrets_entropy": secrets.op7_secrets_entropy,
    "op8_mixing_ipf": mixing.op8_mixing_ipf,
    "op9_fingerprints_ctph": ctph.op9_fingerprints_ctph,
    "op10_simhash_neardup": simhash.op10_simhash_neardup,
    "op11_prefix_trie": prefixtrie.op11_prefix_trie,
    "op12_byte_bpe": bpe.op12_byte_bpe,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLES = {"op3_warc": warc.ORACLE, "op7_secrets_entropy": secrets.ORACLE, "op8_mixing_ipf": mixing.ORACLE, "op11_prefix_trie": prefixtrie.ORACLE}
