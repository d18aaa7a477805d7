"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
from tabulary.llm import chat, decontam, licences, lm, packing, pieces, pii, quality, ranking, rules, simhash, substrings, whitening

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": quality.op3_quality,
    "op4_rules": rules.op4_rules,
    "op5_chat": chat.op5_chat,
    "op6_licences": licences.op6_licences,
    "op7_lm": lm.op7_lm,
    "op8_pii": pii.op8_pii,
    "op9_pieces": pieces.op9_pieces,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_packing": packing.op11_packing,
    "op12_ranking": ranking.op12_ranking,
    "op13_whitening": whitening.op13_whitening,
}
SQL: dict[str, str] = {
    "op5_chat": chat.OP5_SQL,
    "op6_licences": licences.oracle_sql(),
    "op12_ranking": ranking.OP12_SQL,
}


def queries() -> dict:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
