"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import decontaminate, mixing, near_dups, perplexity, pii, quality_rules, secrets, tokens, toxicity, warc

QUERIES = {
    "op1_planes": tokens.query,
    "op2_decontaminate": decontaminate.query,
    "op3_near_dups": near_dups.query,
    "op4_secrets": secrets.query,
    "op5_quality_rules": quality_rules.query,
    "op6_toxicity": toxicity.query,
    "op7_kneser_ney": perplexity.query,
    "op8_pii": pii.query,
    "op9_warc": warc.query,
    "op10_pareto_mix": mixing.query,
}

ORACLE_SQL = {
    "op3_near_dups": near_dups.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_pareto_mix": mixing.ORACLE_SQL,
}
