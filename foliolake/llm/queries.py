"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import language_id, mixing, multi_index, near_dup, perspectives, pii, pivot_index, quality, sentence_pieces, toxicity

QUERIES = {
    "op1_multi_index": multi_index.nearest_rows,
    "op2_language_id": language_id.languages,
    "op3_toxicity": toxicity.toxicities,
    "op4_perspectives": perspectives.rotated,
    "op5_near_dup": near_dup.near_duplicates,
    "op6_quality": quality.qualities,
    "op7_mixing": mixing.mix,
    "op8_pivot_index": pivot_index.exact_rows,
    "op9_pii": pii.personal_data,
    "op10_sentence_pieces": sentence_pieces.tokens,
}

SQL = {
    "op4_perspectives": perspectives.SQL,
    "op5_near_dup": near_dup.SQL,
    "op7_mixing": mixing.SQL,
    "op8_pivot_index": pivot_index.SQL,
}
