"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from framewright.llm import bpe_stream, exact_dedup, html_extract, mixing, ogg_media, quality, secret_scan, simhash, token_output, toxicity

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_bpe_stream": bpe_stream.op4_bpe_stream,
    "op5_quality": quality.op5_quality,
    "op6_ogg_media": ogg_media.op6_ogg_media,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_token_output": token_output.op8_token_output,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op7_secret_scan": secret_scan.SQL,
    "op9_mixing": mixing.SQL,
}
