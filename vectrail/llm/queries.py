"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, jaccard, licenses, mixing, pii, quality, sharding, substring, warc

QUERIES = {
    "op1_warc_transactions": warc.op1_warc_transactions,
    "op2_stratified_shards": sharding.op2_stratified_shards,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_chat_round_trip": chat.op4_chat_round_trip,
    "op5_latent_decontamination": decontam.op5_latent_decontamination,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_personal_data": pii.op7_personal_data,
    "op8_debruijn_dedup": substring.op8_debruijn_dedup,
    "op9_mix_to_weights": mixing.op9_mix_to_weights,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
}

ORACLE_SQL = {
    "op1_warc_transactions": warc.OP1_SQL,
    "op2_stratified_shards": sharding.OP2_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op4_chat_round_trip": chat.OP4_SQL,
    "op8_debruijn_dedup": substring.OP8_SQL,
    "op9_mix_to_weights": mixing.OP9_SQL,
    "op10_ngram_jaccard": jaccard.OP10_SQL,
}
