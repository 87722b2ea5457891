"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, embeddings, langid, linedup, media, minhash, packing, pieces, token_files, toxicity

QUERIES = {
    "op1_embeddings": embeddings.query,
    "op2_token_files": token_files.query,
    "op3_minhash": minhash.query,
    "op4_chat": chat.query,
    "op5_packing": packing.query,
    "op6_line_dedup": linedup.query,
    "op7_media": media.query,
    "op8_toxicity": toxicity.query,
    "op9_language_id": langid.query,
    "op10_pieces": pieces.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op4_chat": chat.SQL}
