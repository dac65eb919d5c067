"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, exact, langid, media, mixing, pii, secrets, simhash, substring, tokenfile


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_bpe": bpe.op2_bpe,
        "op3_secrets": secrets.op3_secrets,
        "op4_language_id": langid.op4_language_id,
        "op5_media": media.op5_media,
        "op6_token_ids": tokenfile.op6_token_ids,
        "op7_simhash": simhash.op7_simhash,
        "op8_mixing": mixing.op8_mixing,
        "op9_exact_dedup": exact.op9_exact_dedup,
        "op10_substring_dedup": substring.op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.SQL, "op9_exact_dedup": exact.SQL}
