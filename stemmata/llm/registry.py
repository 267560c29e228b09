"""The queries of this subpackage and their SQL, by registered name."""

from __future__ import annotations

from . import ann, audit, bpe, chat, fim, htmltext, katz, minhash, packing, quality, simhash, substring, urlfilter

MODULES = {
    "op1_url_filter": urlfilter,
    "op2_katz_backoff": katz,
    "op3_simhash_variants": simhash,
    "op4_variable_packing": packing,
    "op5_quality_rules": quality,
    "op6_recursive_bpe": bpe,
    "op7_block_neighbours": ann,
    "op8_chat_perspectives": chat,
    "op9_automaton_repeats": substring,
    "op10_page_differencing": htmltext,
    "op11_fill_in_middle": fim,
    "op12_interaction_audit": audit,
    "op13_fast_minhash": minhash,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for name, m in MODULES.items() if getattr(m, "ORACLE_SQL", None)}
