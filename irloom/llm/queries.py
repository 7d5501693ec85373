"""The registered queries of the training-data operators, and their SQL where it can express them."""

from irloom.llm import chat_format, collocations, decontaminate, exact_dedup, katz, language_id, near_dedup, packing, secrets, sharding, substring_dedup, suffix_dedup, whitening

QUERIES = {
    "op1_decontaminate": (decontaminate.op1_decontaminate, decontaminate.SQL),
    "op2_katz_score": (katz.op2_katz_score, katz.SQL),
    "op3_suffix_dedup": (suffix_dedup.op3_suffix_dedup, suffix_dedup.SQL),
    "op4_exact_dedup": (exact_dedup.op4_exact_dedup, exact_dedup.SQL),
    "op5_substring_dedup": (substring_dedup.op5_substring_dedup, substring_dedup.SQL),
    "op6_language_id": (language_id.op6_language_id, language_id.SQL),
    "op7_near_dedup": (near_dedup.op7_near_dedup, near_dedup.SQL),
    "op8_packing": (packing.op8_packing, packing.SQL),
    "op9_secret_scan": (secrets.op9_secret_scan, secrets.SQL),
    "op10_chat_format": (chat_format.op10_chat_format, chat_format.SQL),
    "op11_sharding": (sharding.op11_sharding, sharding.SQL),
    "op12_whitening": (whitening.op12_whitening, whitening.SQL),
    "op13_collocations": (collocations.op13_collocations, collocations.SQL),
}
