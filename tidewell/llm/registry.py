"""The registered queries of the training-data operators, and their SQL where SQL can express them.

mixing_targets, url_rules and whitening_fit are views of op5_mixing, op7_url_filter and op11_whitening without the columns that a draw, a model or an iteration
decides, so that SQL can check the rest.
"""

from __future__ import annotations

from . import chat, clusters, decontam, htmltext, lines, mixing, packing, quality, recompress, simhash, suffix, urls, whitening

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_suffix_array": suffix.op3_suffix_array,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_recompression": recompress.op6_recompression,
    "op7_url_filter": urls.op7_url_filter,
    "op8_html_extraction": htmltext.op8_html_extraction,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_whitening": whitening.op11_whitening,
    "op12_ball_tree": clusters.op12_ball_tree,
    "op13_packing": packing.op13_packing,
    "mixing_targets": mixing.mixing_targets,
    "url_rules": urls.url_rules,
    "whitening_fit": whitening.whitening_fit,
}
SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_quality_rules": quality.OP2_SQL,
    "op3_suffix_array": suffix.OP3_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op6_recompression": recompress.OP6_SQL,
    "op12_ball_tree": clusters.OP12_SQL,
    "mixing_targets": mixing.MIXING_TARGETS_SQL,
    "whitening_fit": whitening.WHITENING_FIT_SQL,
    "url_rules": urls.URL_RULES_SQL,
}
