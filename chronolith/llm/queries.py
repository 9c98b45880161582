"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .fingerprints import op9_fingerprints
from .language import op2_language_id
from .mixing import op8_mix_sources
from .near_dedup import op6_near_dedup
from .perspectives import op4_perspectives
from .pieces import op5_sentencepiece_sampling
from .quality_gam import op7_quality_gam
from .quality_rules import op10_quality_rules
from .secrets import op1_secret_scan
from .warc import op3_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_perspectives": op4_perspectives,
    "op5_sentencepiece_sampling": op5_sentencepiece_sampling,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_gam": op7_quality_gam,
    "op8_mix_sources": op8_mix_sources,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op3_warc_revisits": sql.OP3,
    "op4_perspectives": sql.OP4,
    "op8_mix_sources": sql.OP8,
    "op10_quality_rules": sql.OP10,
}
