"""The numbered queries of this subpackage and the SQL that must return the same rows."""

from __future__ import annotations

from . import ann, conversations, decontaminate, divergence, exact_dedup, licences, mixing, near_dedup, packing, pii, substrings, toxicity, url_graph


def queries():
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_ann": ann.op2_ann,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_substrings": substrings.op4_substrings,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_packing": packing.op6_packing,
        "op7_url_filter": url_graph.op7_url_filter,
        "op8_licences": licences.op8_licences,
        "op9_pii": pii.op9_pii,
        "op10_mixing": mixing.op10_mixing,
        "op11_conversations": conversations.op11_conversations,
        "op12_divergence": divergence.op12_divergence,
        "op13_decontaminate": decontaminate.op13_decontaminate,
    }


def oracle_sql():
    return {
        "op1_near_dedup": near_dedup.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op8_licences": licences.oracle(),
        "op10_mixing": mixing.ORACLE,
        "op12_divergence": divergence.ORACLE,
        "op13_decontaminate": decontaminate.ORACLE,
    }
