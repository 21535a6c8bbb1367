"""The queries of this subpackage and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terravia.llm import chat, fingerprint, langid, lexical, packing, pii, quality, secrets, sentencepiece, simhash, urlfilter, vectorcodes, warc
from terravia.llm.common import table

_QUERIES = {
    "op1_language_id": ("documents", langid.op1),
    "op2_quality_rules": ("documents", quality.op2),
    "op3_pii": ("documents", pii.op3),
    "op4_sentencepiece": ("documents", sentencepiece.op4),
    "op5_warc": ("pages", warc.op5),
    "op6_fingerprints": ("documents", fingerprint.op6),
    "op7_chat_format": ("conversations", chat.op7),
    "op8_url_filter": ("pages", urlfilter.op8),
    "op9_best_fit_packing": ("documents", packing.op9),
    "op10_simhash": ("documents", simhash.op10),
    "op13_secret_scan": ("documents", secrets.op13),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, t=t, f=f: f(table(spark, sf_dir, t))) for name, (t, f) in _QUERIES.items()}
    return found | {"op11_lexical_search": lexical.op11, "op12_vector_codes": vectorcodes.op12}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.ORACLE,
        "op5_warc": warc.ORACLE,
        "op7_chat_format": chat.ORACLE,
        "op8_url_filter": urlfilter.oracle(),
        "op11_lexical_search": lexical.ORACLE,
        "op12_vector_codes": vectorcodes.oracle(),
    }
