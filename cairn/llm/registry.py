"""The queries of this subpackage and the SQL of those that SQL can express."""

from cairn.llm import bpe, byte_bpe, chat, exact_dedup, hard_negatives, mixing, quality, sharding, simhash, suffix_dedup, url_filter, vector_codes, vector_dedup

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_chat_format": chat.op4_chat_format,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_vector_dedup": vector_dedup.op7_vector_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality": quality.op10_quality,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
    "chat_tool_calls": chat.chat_tool_calls,
}

ORACLE = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "chat_tool_calls": chat.TOOL_ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op7_vector_dedup": vector_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
