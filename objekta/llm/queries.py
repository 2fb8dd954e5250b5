"""The queries opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from objekta.llm import decontaminate, html_text, line_dedup, mixing, phrase_dedup, quality, secret_scan, simhash, token_counts, token_files

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_quality": quality.op2_quality,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html_text": html_text.op4_html_text,
    "op5_token_files": token_files.op5_token_files,
    "op6_phrase_dedup": phrase_dedup.op6_phrase_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_mix": mixing.op10_mix,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan.OP1_SQL,
    "op6_phrase_dedup": phrase_dedup.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_mix": mixing.OP10_SQL,
}
