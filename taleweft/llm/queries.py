"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html, lexical, mixing, neardup, quality, repair, secrets, sharding, substring, topk

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_topk": topk.op3_topk,
    "op4_quality": quality.op4_quality,
    "op5_substring": substring.op5_substring,
    "op6_mixing": mixing.op6_mixing,
    "op7_neardup": neardup.op7_neardup,
    "op8_html": html.op8_html,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_tool_calls": chat.op10_tool_calls,
    "op11_bpe": bpe.op11_bpe,
    "op12_repair": repair.op12_repair,
    "op13_lexical": lexical.op13_lexical,
}

ORACLE_SQL = {
    "op3_topk": topk.OP3_SQL,
    "op10_tool_calls": chat.OP10_SQL,
    "op13_lexical": lexical.OP13_SQL,
}
