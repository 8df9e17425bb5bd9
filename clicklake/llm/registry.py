"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from . import chat, jaccard, lexical, mixing, neighbours, packing, quality, secrets, sharding, substrings, subwords, tokens, whitening
from .common import in_small_batches

_FUNCTIONS = {
    "op1_chat": chat.op1_chat,
    "op2_packing": packing.op2_packing,
    "op3_secrets": secrets.op3_secrets,
    "op4_substrings": substrings.op4_substrings,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_tokens": tokens.op7_tokens,
    "op8_sharding": sharding.op8_sharding,
    "op10_jaccard": jaccard.op10_jaccard,
    "op9_neighbours": neighbours.op9_neighbours,
    "op11_lexical": lexical.op11_lexical,
    "op12_subwords": subwords.op12_subwords,
    "op13_whitening": whitening.op13_whitening,
}
QUERIES = {name: in_small_batches(function) for name, function in _FUNCTIONS.items()}
ORACLES = {
    "op1_chat": chat.OP1_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op4_substrings": substrings.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op10_jaccard": jaccard.OP10_SQL,
    "op11_lexical": lexical.OP11_SQL,
}
