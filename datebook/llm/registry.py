"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from datebook.llm.byte_bpe import op1_byte_bpe
from datebook.llm.decontamination import ORACLE as DECONTAMINATION_SQL
from datebook.llm.decontamination import op4_decontamination
from datebook.llm.hard_negatives import ORACLE as NEGATIVES_SQL
from datebook.llm.hard_negatives import op12_hard_negatives
from datebook.llm.language_id import op13_language_id
from datebook.llm.license_scan import op8_license_scan
from datebook.llm.quality_rules import ORACLE as QUALITY_SQL
from datebook.llm.quality_rules import op2_quality_rules
from datebook.llm.simhash import op3_simhash
from datebook.llm.source_divergence import ORACLE as DIVERGENCE_SQL
from datebook.llm.source_divergence import op11_source_divergence
from datebook.llm.token_counts import op7_token_counts
from datebook.llm.token_shards import op5_token_shards
from datebook.llm.toxicity import op9_toxicity
from datebook.llm.url_filter import op6_url_filter
from datebook.llm.weak_quality import op10_weak_quality


def queries():
    return {"op1_byte_bpe": op1_byte_bpe, "op2_quality_rules": op2_quality_rules, "op3_simhash": op3_simhash, "op4_decontamination": op4_decontamination, "op5_token_shards": op5_token_shards, "op6_url_filter": op6_url_filter, "op7_token_counts": op7_token_counts, "op8_license_scan": op8_license_scan, "op9_toxicity": op9_toxicity, "op10_weak_quality": op10_weak_quality, "op11_source_divergence": op11_source_divergence, "op12_hard_negatives": op12_hard_negatives, "op13_language_id": op13_language_id}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY_SQL, "op4_decontamination": DECONTAMINATION_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_hard_negatives": NEGATIVES_SQL}
