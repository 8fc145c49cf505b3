"""One query for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, decontaminate, htmltext, langid, licenses, linedup, lm, neardup, oracle, packing, secrets

QUERIES = {
    "op1_packing": packing.query,
    "op2_decontamination": decontaminate.query,
    "op3_line_dedup": linedup.query,
    "op4_near_dedup": neardup.query,
    "op5_html_extraction": htmltext.query,
    "op6_secret_scan": secrets.query,
    "op7_lm_scoring": lm.query,
    "op8_language_id": langid.query,
    "op9_nearest_neighbours": ann.query,
    "op10_license_scan": licenses.query,
}
#: Models trained here, approximate search and the tokeniser are not for SQL; tests/llm compares those with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": oracle.LINE_DEDUP,
    "op4_near_dedup": oracle.NEAR_DEDUP,
    "op6_secret_scan": oracle.secret_scan(),
    "op10_license_scan": oracle.license_scan(),
}
