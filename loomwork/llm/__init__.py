"""Operators of training-data pipelines; nothing else in loomwork imports this subpackage.

queries() and oracle_sql() are what __spark_entry__ adds to its own when the subpackage is there.
"""

from __future__ import annotations

from . import chat, decontaminate, html_text, license_scan, mixing, near_dup, pii, quality, token_files, url_rules


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_near_dup": near_dup.op3_near_dup,
        "op4_token_files": token_files.op4_token_files,
        "op5_chat": chat.op5_chat,
        "op6_url_rules": url_rules.op6_url_rules,
        "op7_licenses": license_scan.op7_licenses,
        "op8_quality": quality.op8_quality,
        "op9_mixing": mixing.op9_mixing,
        "op10_html_text": html_text.op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_near_dup": near_dup.OP3_SQL,
        "op5_chat": chat.OP5_SQL,
        "op6_url_rules": url_rules.OP6_SQL,
        "op9_mixing": mixing.OP9_SQL,
    }
