"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, boilerplate, chat, kdtree, langid, media, mixing, ngram_join, periodic, pieces, tokenfiles, topk, toxicity


def queries() -> dict:
    found = (
        ngram_join.op1_ngram_jaccard_join, pieces.op2_sentencepiece, media.op3_media_columns, topk.op4_exact_topk, chat.op5_chat_format,
        toxicity.op6_toxicity, mixing.op7_mix_sources, boilerplate.op8_line_dedup, tokenfiles.op9_token_files, kdtree.op10_kd_shards,
        audit.op11_filter_audit, langid.op12_language_id, periodic.op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.OP1_SQL, "op4_exact_topk": topk.OP4_SQL, "op5_chat_format": chat.OP5_SQL,
        "op7_mix_sources": mixing.OP7_SQL, "op8_line_dedup": boilerplate.OP8_SQL,
        "op11_filter_audit": audit.OP11_SQL,
    }
