"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from stratafold.llm import bitplanes, chat, decontam, jaccard, langid, licenses, mixing, pii, quality, wrapper

QUERIES = {
    "op1_wrapper_extract": wrapper.op1_wrapper_extract,
    "op5_license_digests": licenses.op5_license_digests,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_pii_boosted": pii.op8_pii_boosted,
    "op10_chat_format": chat.op10_chat_format,
    "op2_language_id": langid.op2_language_id,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_token_planes": bitplanes.op4_token_planes,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op9_quality_cascade": quality.op9_quality_cascade,
}
ORACLES = {
    "op5_license_digests": licenses.OP5_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op3_decontaminate": decontam.OP3_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op7_jaccard_join": jaccard.OP7_SQL,
    "op9_quality_cascade": quality.OP9_SQL,
}
