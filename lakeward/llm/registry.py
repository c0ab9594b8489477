"""Queries of this subpackage and their SQL, as `__spark_entry__.py` adds them."""

from __future__ import annotations

from lakeward.llm.backoff import op4_lm_scoring
from lakeward.llm.chat import ORACLE_OP7, op7_chat_formatting
from lakeward.llm.infill import ORACLE_OP11, op11_infill
from lakeward.llm.language import op1_language_id
from lakeward.llm.lines import ORACLE_OP12, op12_line_dedup
from lakeward.llm.manifest import ORACLE_OP13, op13_merkle_manifest
from lakeward.llm.packing import op3_packing
from lakeward.llm.pieces import op10_sentencepiece
from lakeward.llm.quality import op9_quality_rules
from lakeward.llm.simhash import op5_simhash
from lakeward.llm.sketches import op6_fingerprints
from lakeward.llm.substrings import op2_substring_dedup
from lakeward.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_simhash": op5_simhash,
    "op6_fingerprints": op6_fingerprints,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_infill": op11_infill,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat_formatting": ORACLE_OP7,
    "op11_infill": ORACLE_OP11,
    "op12_line_dedup": ORACLE_OP12,
    "op13_merkle_manifest": ORACLE_OP13,
}
