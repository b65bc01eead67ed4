"""The registered queries of this subpackage and their DuckDB SQL."""

from glyphspark.llm import decontaminate, exact_dedup, html_extract, langid, license_scan, line_dedup, mixing, quality, simhash, substring_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_langid": langid.op8_langid,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_license_scan": license_scan.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
}
