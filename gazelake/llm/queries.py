"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (alignment, bpe, language, main_text, mixing, near_copies, near_vectors, phrases, quality, repeats, token_files,
               top_vectors, toxicity)

QUERIES = {
    "op1_language": language.query,
    "op2_main_text": main_text.query,
    "op3_token_files": token_files.query,
    "op4_near_copies": near_copies.query,
    "op5_repeats": repeats.query,
    "op6_bpe": bpe.query,
    "op7_mixing": mixing.query,
    "op8_top_vectors": top_vectors.query,
    "op9_near_vectors": near_vectors.query,
    "op10_toxicity": toxicity.query,
    "op11_alignment": alignment.query,
    "op12_quality": quality.query,
    "op13_phrases": phrases.query,
}
SQL = {
    "op4_near_copies": near_copies.SQL,
    "op8_top_vectors": top_vectors.SQL,
    "op9_near_vectors": near_vectors.SQL,
    "op12_quality": quality.SQL,
    "op13_phrases": phrases.SQL,
}
