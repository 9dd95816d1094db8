"""The queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from lakewright.llm import byte_bpe, chat, decontaminate, importance, language_id, ngram_join, order_minhash, secrets, substring_dedup, token_alignment, toxicity, vector_codes, warc

QUERIES = {
    "op1_importance_resampling": importance.op1,
    "op2_credential_linking": secrets.op2,
    "op3_reply_trees": chat.op3,
    "op4_order_minhash": order_minhash.op4,
    "op5_toxicity": toxicity.op5,
    "op6_cross_parsing_language": language_id.op6,
    "op7_byte_bpe": byte_bpe.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_ngram_jaccard_join": ngram_join.op10,
    "op11_warc": warc.op11,
    "op12_token_alignment": token_alignment.op12,
    "op13_vector_codes": vector_codes.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op3_reply_trees": chat.OP3_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_warc": warc.OP11_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
