"""The extractors as SQL functions of a session: expressions, so that SQL queries over them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillspark.functions import patterns as P

#: Names of functions of a text and the patterns whose matches they return, in order.
EXTRACTORS = {
    "quill_quantities": P.QUANTITY, "quill_numerics": P.NUMERIC, "quill_citations": P.CITATION, "quill_references": P.FIGURE, "quill_variables": P.SUBSCRIPT_VARIABLE, "quill_dates": P.DATE,
    "quill_symbols": P.SYMBOL, "quill_numbers": P.BARE_NUMBER, "quill_dois": P.DOI,
}


def literal(pattern: str) -> str:
    return "r\"" + pattern + "\"" if '"' not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> list[str]:
    """Makes temporary functions of EXTRACTORS: each takes a text and gives an array of strings, null for a null text."""
    for name, pattern in EXTRACTORS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(t, {literal(pattern)}, 0)")
    return list(EXTRACTORS)
