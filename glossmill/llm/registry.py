"""The queries of this subpackage and their SQL, for the driver contract."""

from __future__ import annotations

from . import alignment, decontamination, language_id, licenses, line_dedup, lm, neighbours, packing, pieces, prefix_trie, sharding, simhash, toxicity

QUERIES = {
    "op1_sentencepiece": pieces.query,
    "op2_line_dedup": line_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_lm_score": lm.query,
    "op5_decontaminate": decontamination.query,
    "op6_neighbours": neighbours.query,
    "op7_licenses": licenses.query,
    "op8_simhash": simhash.query,
    "op9_sharding": sharding.query,
    "op10_language_id": language_id.query,
    "op11_alignment": alignment.query,
    "op12_packing": packing.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op4_lm_score": lm.ORACLE_SQL,
    "op5_decontaminate": decontamination.ORACLE_SQL,
    "op7_licenses": licenses.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
