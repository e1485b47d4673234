"""The registered queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from srcatlas.llm import align, ann, bpe, chat, jaccard, langid, licenses, merkle, packing, quality, sharding, substring, toxicity

QUERIES = {
    "op1_feistel_sharding": sharding.query,
    "op2_permutation_ann": ann.query,
    "op3_ngram_jaccard": jaccard.query,
    "op4_substring_dedup": substring.query,
    "op5_chat_format": chat.query,
    "op6_bpe_transducer": bpe.query,
    "op7_quality_rules": quality.query,
    "op8_kneser_ney_toxicity": toxicity.query,
    "op9_mixture_langid": langid.query,
    "op10_best_fit_packing": packing.query,
    "op11_merkle_manifest": merkle.query,
    "op12_token_alignment": align.query,
    "op13_license_automaton": licenses.query,
}

ORACLE: dict[str, str] = {
    "op4_substring_dedup": substring.SQL,
    "op5_chat_format": chat.SQL,
    "op7_quality_rules": quality.SQL,
    "op11_merkle_manifest": merkle.SQL,
}
