"""The queries of this package, one for each operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from tidewrack.llm import chat, decontaminate, gif, langid, linededup, mixing, quality, secrets, sharding, simhash

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_simhash": simhash.op2_simhash,
    "op3_shard_bytes": sharding.op3_shard_bytes,
    "op4_language_id": langid.op4_language_id,
    "op5_chat_format": chat.op5_chat_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_gif_media": gif.op9_gif_media,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op8_line_dedup": linededup.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op1_mix_sources": mixing.ORACLE,
}
