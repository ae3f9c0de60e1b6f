"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embeddings, jaccard, licenses, packing, quality, sharding, sql, suffix, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_sharding": sharding.op1,
    "op2_jaccard_join": jaccard.op2,
    "op3_toxicity": toxicity.op3,
    "op4_packing": packing.op4,
    "op5_suffix_dedup": suffix.op5,
    "op6_chat_format": chat.op6,
    "op7_byte_bpe": bpe.op7,
    "op8_embedding_dedup": embeddings.op8,
    "op9_quality_rules": quality.op9,
    "op10_license_scan": licenses.op10,
    "chat_transcripts": chat.chat_transcripts,
    "quality_base": quality.quality_base,
    "license_base": licenses.license_base,
}

SQL: dict[str, str] = {
    "op2_jaccard_join": sql.OP2,
    "op5_suffix_dedup": suffix.OP5_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_embedding_dedup": sql.OP8,
    "chat_transcripts": chat.TRANSCRIPTS_SQL,
    "quality_base": sql.QUALITY_BASE,
    "license_base": sql.LICENSE_BASE,
}
