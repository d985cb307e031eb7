"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderlake.llm import decontaminate, exact_dedup, filter_audit, language, packing, quality, simhash, substring_words, suffix_dedup, toxicity, url_filters, warc, whitening
from cinderlake.session import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """op1 to op13 over whole tables with production parameters."""
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_suffix_dedup": lambda s, d: suffix_dedup.op1_suffix_dedup(docs(s, d)),
        "op2_warc": lambda s, d: warc.op2_warc(table(s, d, "pages")),
        "op3_packing": lambda s, d: packing.op3_packing(docs(s, d)),
        "op4_quality": lambda s, d: quality.op4_quality(docs(s, d), table(s, d, "labels")),
        "op5_exact_dedup": lambda s, d: exact_dedup.op5_exact_dedup(docs(s, d)),
        "op6_simhash": lambda s, d: simhash.op6_simhash(docs(s, d)),
        "op7_substring": lambda s, d: substring_words.op7_substring(docs(s, d)),
        "op8_language": lambda s, d: language.op8_language(docs(s, d)),
        "op9_toxicity": lambda s, d: toxicity.op9_toxicity(docs(s, d), table(s, d, "labels")),
        "op10_decontaminate": lambda s, d: decontaminate.op10_decontaminate(docs(s, d), table(s, d, "benchmark")),
        "op11_url_filters": lambda s, d: url_filters.op11_url_filters(table(s, d, "pages")),
        "op12_filter_audit": lambda s, d: filter_audit.op12_filter_audit(docs(s, d), table(s, d, "labels")),
        "op13_whitening": lambda s, d: whitening.op13_whitening(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express."""
    return {"op2_warc": warc.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op7_substring": substring_words.ORACLE, "op11_url_filters": url_filters.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
