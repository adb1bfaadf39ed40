"""The queries of this subpackage and their SQL."""

from . import bpe, chat, embeddings, jaccard, language, media, mixing, secrets, substrings, token_counts


def queries() -> dict:
    return {
        "op1_language_id": language.op1_language_id,
        "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_media_columns": media.op4_media_columns,
        "op5_secret_scans": secrets.op5_secret_scans,
        "op6_byte_level_bpe": bpe.op6_byte_level_bpe,
        "op7_mixing_sources": mixing.op7_mixing_sources,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op2_ngram_jaccard_join": jaccard.SQL,
        "op3_substring_dedup": substrings.SQL,
        "op4_media_columns": media.SQL,
        "op8_chat_formatting": chat.SQL,
        "op10_embedding_near_dedup": embeddings.SQL,
    }
