"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audio, bpe, codes, langid, lexical, oracles, packing, privacy, quality, secrets, shard, simhash, suffix_tree, toxicity

QUERIES = {
    "op1_telephony": audio.op1_telephony,
    "op2_interleave": shard.op2_interleave,
    "op3_suffix_tree": suffix_tree.op3_suffix_tree,
    "op4_privacy": privacy.op4_privacy,
    "op5_bpe": bpe.op5_bpe,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_secrets": secrets.op9_secrets,
    "op10_language": langid.op10_language,
    "op11_tiered": lexical.op11_tiered,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_codes": codes.op13_codes,
}

ORACLE_SQL: dict[str, str] = {"op7_quality": oracles.QUALITY, "op9_secrets": oracles.SECRETS, "op11_tiered": oracles.LEXICAL, "op13_codes": oracles.CODES}
