"""The queries of this subpackage."""

from __future__ import annotations

from .bpe import op2_bpe_round_trip
from .classify import op5_toxicity, op8_quality
from .fmindex import op4_decontamination
from .huffman import op3_huffman_tokens
from .neardup import op6_near_duplicates
from .ngram import op1_language_model
from .pii import op10_personal_data
from .secrets import op7_secret_scan
from .topk import op9_exact_topk

_OPS = (op1_language_model, op2_bpe_round_trip, op3_huffman_tokens, op4_decontamination, op5_toxicity, op6_near_duplicates, op7_secret_scan, op8_quality, op9_exact_topk, op10_personal_data)


def queries() -> dict:
    return {f.__name__: f for f in _OPS}


def oracle_sql() -> dict:
    """None: hashes of ids, trained models, sketches and exact searches have no SQL form; the tests hold each query against a
    brute-force version, an exact round trip or held-out accuracy."""
    return {}
