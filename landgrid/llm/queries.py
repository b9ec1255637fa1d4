"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import block_knn, chat_format, decontamination, filter_audit, importance, jaccard_join, language_id, lexical_search, license_scan, mixing, sharding, simhash, url_filters

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_shard_shuffle": sharding.op2,
    "op3_license_scan": license_scan.op3,
    "op4_block_knn": block_knn.op4,
    "op5_chat_windows": chat_format.op5,
    "op6_language_id": language_id.op6,
    "op7_simhash": simhash.op7,
    "op8_importance_resampling": importance.op8,
    "op9_url_filters": url_filters.op9,
    "op10_decontaminate": decontamination.op10,
    "op11_lexical_search": lexical_search.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_jaccard_join": jaccard_join.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license_scan.SQL,
    "op4_block_knn": block_knn.SQL,
    "op5_chat_windows": chat_format.SQL,
    "op9_url_filters": url_filters.SQL,
    "op10_decontaminate": decontamination.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_jaccard_join": jaccard_join.SQL,
}
