"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import (bpe, chat, exact_dedup, fill_in_middle, filter_audit, html_text, minhash, packing, simhash, substring,
               suffix_dedup, toxicity, warc)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat_format": chat.op4_chat_format,
    "op5_simhash": simhash.op5_simhash,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_minhash_fingerprints": minhash.op7_minhash_fingerprints,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_html_text": html_text.op9_html_text,
    "op10_packing": packing.op10_packing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLE = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
