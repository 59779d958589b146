"""All queries of this subpackage and the SQL that some of them are compared with."""

from foliospark.llm import p1_pairs, p2_sample, p3_splits, p4_sentences, p5_forms, p6_markup, p7_encode, p8_leaks, p9_language

_MODULES = (p1_pairs, p2_sample, p3_splits, p4_sentences, p5_forms, p6_markup, p7_encode, p8_leaks, p9_language)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
