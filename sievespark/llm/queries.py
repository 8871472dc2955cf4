"""The registered queries of the training-data operators and their SQL.

Only op6 has SQL; the others learn models, tokenise, find components, or use hashes
and eigenvectors that DuckDB lacks, and are
tested against brute force, exact round trips or held-out accuracy in tests/llm.
"""

from . import ans, decontam, fuzzy_lines, language, mixing, packing, pii, quality, scoring, simhash, spelling, substring, whitening

QUERIES = {
    "op1_recompression": substring.op1_recompression,
    "op2_candidate_boosting": pii.op2_candidate_boosting,
    "op3_pivot_tables": simhash.op3_pivot_tables,
    "op4_fuzzy_lines": fuzzy_lines.op4_fuzzy_lines,
    "op5_deleted_interpolation": scoring.op5_deleted_interpolation,
    "op6_line_frequency": quality.op6_line_frequency,
    "op7_multi_length": packing.op7_multi_length,
    "op8_family_then_svm": language.op8_family_then_svm,
    "op9_spaced_seeds": decontam.op9_spaced_seeds,
    "op10_interleaved_rans": ans.op10_interleaved_rans,
    "op11_multinomial_blocks": mixing.op11_multinomial_blocks,
    "op12_sorted_list": spelling.op12_sorted_list,
    "op13_polarisation": whitening.op13_polarisation,
}

ORACLES = {
    "op6_line_frequency": quality.OP6_SQL,
}
