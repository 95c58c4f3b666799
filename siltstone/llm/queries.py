"""The queries of this package, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, debruijn, langid, linededup, mixing, simhash, tokenfile, topk, toxicity, winnowing

QUERIES = {
    "op1_winnowing": winnowing.op1_winnowing,
    "op2_mixing": mixing.op2_mixing,
    "op3_topk": topk.op3_topk,
    "op4_simhash": simhash.op4_simhash,
    "op5_language_id": langid.op5_language_id,
    "op6_substring_dedup": debruijn.op6_substring_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_token_file": tokenfile.op9_token_file,
    "op10_line_dedup": linededup.op10_line_dedup,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op6_substring_dedup": debruijn.OP6_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
}
