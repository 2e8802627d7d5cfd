"""The queries of this subpackage by name, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import audio, decontam, jaccard, language, lines, packing, paths, pii, quality, suffixes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lines.query,
        "op2_ordinal_quality": quality.query,
        "op3_pii": pii.query,
        "op4_benchmark_decontamination": decontam.query,
        "op5_suffix_array_dedup": suffixes.query,
        "op6_chroma_fingerprints": audio.query,
        "op7_best_fit_packing": packing.query,
        "op8_jaccard_pigeonhole": jaccard.query,
        "op9_ppm_language": language.query,
        "op10_de_bruijn_spans": paths.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_decontamination": decontam.ORACLE,
    }
