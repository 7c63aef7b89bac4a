"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from levyscape.llm import block_join, cube, decontaminate, language, line_dedup, minhash, phrases, recompress_dedup, residue_join, simhash, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_language": language.query,
    "op4_cube_mix": cube.query,
    "op5_line_dedup": line_dedup.query,
    "op6_recompress_dedup": recompress_dedup.query,
    "op7_decontaminate": decontaminate.query,
    "op8_simhash_ball": simhash.query,
    "op9_url_filter": url_filter.query,
    "op10_block_join": block_join.query,
    "op11_residue_join": residue_join.query,
    "op12_phrases": phrases.query,
    "op13_minhash": minhash.query,
}

# the others train, hash, align, name components or choose at random: tested against brute force instead
ORACLES = {"op10_block_join": block_join.SQL, "op11_residue_join": residue_join.SQL, "op12_phrases": phrases.SQL}
