"""The queries of this subpackage, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from . import chat, htmltree, kdtree, linededup, media, mixing, pieces, quality, simhash, toxicity
from .common import table

DOCS = "doc_id text lang source n_chars"


def _documents(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents", DOCS))


def queries() -> dict:
    return {
        "op1_quality_rules": _documents(quality.quality_rules),
        "op2_simhash": _documents(simhash.near_duplicates),
        "op3_mix_sources": _documents(mixing.mix_report),
        "op4_toxicity": lambda spark, sf_dir: toxicity.toxicity(table(spark, sf_dir, "documents", "doc_id text"), table(spark, sf_dir, "labels", "doc_id toxic")),
        "op5_sentencepiece": _documents(pieces.encode_report),
        "op6_media_columns": _documents(media.media_report),
        "op7_line_dedup": _documents(linededup.line_dedup_report),
        "op8_chat_threads": lambda spark, sf_dir: chat.link(table(spark, sf_dir, "conversations", "conv_id turn role text")),
        "op9_kd_sharding": _documents(kdtree.shard),
        "op10_html_text": lambda spark, sf_dir: htmltree.extract(table(spark, sf_dir, "pages", "page_id url html")),
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are held against brute force in tests/llm."""
    return {"op1_quality_rules": quality.ORACLE, "op3_mix_sources": mixing.ORACLE, "op7_line_dedup": linededup.ORACLE}
