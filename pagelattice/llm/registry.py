"""The opN_ queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import anchor_repeats, digest_dedup, fill_middle, license_index, media_columns, pair_bpe, prefix_doubling, set_join, source_mix, token_counts, token_files, toxic_crf, vector_codes

QUERIES = {f.__name__: f for f in (token_files.op1_token_files, token_counts.op2_token_counts, toxic_crf.op3_toxic_crf, anchor_repeats.op4_anchor_repeats, media_columns.op5_media_webp, pair_bpe.op6_pair_bpe, digest_dedup.op7_digest_dedup, source_mix.op8_source_mix, license_index.op9_license_index, set_join.op10_set_join, prefix_doubling.op11_prefix_doubling, fill_middle.op12_fill_middle, vector_codes.op13_vector_codes)}
ORACLE = {"op4_anchor_repeats": anchor_repeats.ORACLE, "op10_set_join": set_join.ORACLE, "op11_prefix_doubling": prefix_doubling.ORACLE, "op12_fill_middle": fill_middle.ORACLE, "op13_vector_codes": vector_codes.ORACLE, "op7_digest_dedup": digest_dedup.ORACLE, "op8_source_mix": source_mix.ORACLE}
