"""Queries and SQL of this package, by name."""

from __future__ import annotations

from . import chat, fingerprint, jaccard_join, licences, packing, pii, quality, tokens, toxicity

QUERIES = {
    "op1_lexical_packing": packing.op1_lexical_packing,
    "op2_quartile_digest": fingerprint.op2_quartile_digest,
    "op2_like_pairs": fingerprint.op2_like_pairs,
    "op3_quality": quality.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_bpe_encode": tokens.op5_bpe_encode,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_licence_scan": licences.op7_licence_scan,
    "op8_reply_trees": chat.op8_reply_trees,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op9_jaccard_links": jaccard_join.op9_jaccard_links,
    "op10_token_counts": tokens.op10_token_counts,
}
ORACLE_SQL = {**fingerprint.SQL, **licences.SQL, **chat.SQL, **jaccard_join.SQL}
