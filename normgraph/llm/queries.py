"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from normgraph.llm import chat_format, decontaminate, exact_dedup, importance, infilling, license_scan, line_dedup, minhash, packing, secret_scan, sentencepiece_codec, topk_search, toxicity
from normgraph.llm.common import scoped

QUERIES = {
    "op1_license_scan": (license_scan.op1_license_scan, license_scan.SQL),
    "op2_toxicity": (toxicity.op2_toxicity, toxicity.SQL),
    "op3_exact_dedup": (exact_dedup.op3_exact_dedup, exact_dedup.SQL),
    "op4_secret_scan": (secret_scan.op4_secret_scan, secret_scan.SQL),
    "op5_topk_search": (topk_search.op5_topk_search, topk_search.SQL),
    "op6_sentencepiece": (sentencepiece_codec.op6_sentencepiece, sentencepiece_codec.SQL),
    "op7_best_fit_packing": (packing.op7_best_fit_packing, packing.SQL),
    "op8_minhash_dedup": (minhash.op8_minhash_dedup, minhash.SQL),
    "op9_line_dedup": (line_dedup.op9_line_dedup, line_dedup.SQL),
    "op10_chat_format": (chat_format.op10_chat_format, chat_format.SQL),
    "op11_benchmark_decontamination": (decontaminate.op11_benchmark_decontamination, decontaminate.SQL),
    "op12_importance_resampling": (importance.op12_importance_resampling, importance.SQL),
    "op13_fill_in_middle": (infilling.op13_fill_in_middle, infilling.SQL),
}


def queries() -> dict:
    return {name: scoped(f) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
