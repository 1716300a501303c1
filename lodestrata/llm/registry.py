"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestrata.llm import decontaminate, embed_dedup, jaccard, langid, merkle, mixing, negatives, packing, pii, quality, repeats, secrets, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_repeats": repeats.op2_repeats,
    "op3_language": langid.op3_language,
    "op4_quality": quality.op4_quality,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_secrets": secrets.op6_secrets,
    "op7_embeddings": embed_dedup.op7_embeddings,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_packing": packing.op9_packing,
    "op10_pii": pii.op10_pii,
    "op11_merkle": merkle.op11_merkle,
    "op12_negatives": negatives.op12_negatives,
    "op13_mixing": mixing.op13_mixing,
}
ORACLE_SQL = {
    "op1_warc": warc.ORACLE_SQL,
    "op5_jaccard": jaccard.ORACLE_SQL,
    "op7_embeddings": embed_dedup.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op12_negatives": negatives.ORACLE_SQL,
    "op13_mixing": mixing.ORACLE_SQL,
}
