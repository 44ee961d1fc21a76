"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from talkgrid.llm import decontaminate, hardnegatives, language, linededup, mixing, neighbours, pii, quality, repair, simhash, substrings, toxicity, vectors

QUERIES = {
    "op1_language": language.op1,
    "op2_personal_data": pii.op2,
    "op3_simhash": simhash.op3,
    "op4_quality": quality.op4,
    "op5_substrings": substrings.op5,
    "op6_vectors": vectors.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_mixing": mixing.op8,
    "op9_line_dedup": linededup.op9,
    "op10_toxicity": toxicity.op10,
    "op11_neighbours": neighbours.op11,
    "op12_hard_negatives": hardnegatives.op12,
    "op13_repair": repair.op13,
}

ORACLE_SQL = {
    "op5_substrings": substrings.SQL,
    "op6_vectors": vectors.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op8_mixing": mixing.SQL,
    "op9_line_dedup": linededup.SQL,
    "op12_hard_negatives": hardnegatives.SQL,
    "op13_repair": repair.SQL,
}
