"""The training-data queries, and SQL for those that SQL can express."""

from tidewater.llm import decontaminate, exact_dedup, html_extract, langid, line_dedup, minhash, mixing, quality, secrets, suffix_dedup

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality": quality.op2_quality,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_minhash": minhash.op4_minhash,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_secrets": secrets.op6_secrets,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_langid": langid.op8_langid,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
