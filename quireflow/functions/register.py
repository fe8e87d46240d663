"""Publish the scalar and table functions to SQL, as SQL functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SCALARS = {
    "qf_strip_subset_tag(font STRING) RETURNS STRING": r"regexp_replace(font, r'^[A-Z]{6}\+', '')",
    "qf_bates_label(n BIGINT, prefix STRING, suffix STRING, padding INT) RETURNS STRING":
        "concat(prefix, repeat('0', greatest(padding - length(CAST(n AS STRING)), 0)), CAST(n AS STRING), suffix)",
    "qf_csv_quote(t STRING) RETURNS STRING": "if(t rlike r'[,\"\\n\\r]', concat('\"', replace(t, '\"', '\"\"'), '\"'), t)",
    "qf_xml_escape(t STRING) RETURNS STRING":
        "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), r\"'\", '&apos;')",
    "qf_scheme(url STRING) RETURNS STRING": r"nullif(lower(regexp_extract(url, r'^([A-Za-z][A-Za-z0-9+.\-]+):', 1)), '')",
    "qf_path_hash(path STRING) RETURNS STRING": "sha2(path, 256)",
    "qf_luhn_card(t STRING) RETURNS BOOLEAN": "length(regexp_replace(t, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(t, '[^0-9]', ''))",
    "qf_rgb_hex(r INT, g INT, b INT) RETURNS STRING": "format_string('#%02x%02x%02x', r, g, b)",
    "qf_roman(n BIGINT) RETURNS STRING":
        "CASE WHEN n >= 1 THEN concat(repeat('M', CAST(n div 1000 AS INT)), "
        "element_at(array('', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'), CAST(n div 100 % 10 + 1 AS INT)), "
        "element_at(array('', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'), CAST(n div 10 % 10 + 1 AS INT)), "
        "element_at(array('', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'), CAST(n % 10 + 1 AS INT))) END",
}

_TABLES = {
    "qf_chunk_text(t STRING, size INT, overlap INT) RETURNS TABLE (chunk_no INT, start BIGINT, end BIGINT, chunk STRING)":
        "SELECT pos, CAST(col AS BIGINT), CAST(least(col + size, length(t)) AS BIGINT), substring(t, col + 1, size) "
        "FROM posexplode(sequence(0, greatest(length(t) - overlap - 1, 0), size - overlap))",
    "qf_text_matches(t STRING, pattern STRING) RETURNS TABLE (start BIGINT, end BIGINT, match STRING)":
        "SELECT CAST(start AS BIGINT), CAST(end AS BIGINT), match FROM inline(transform(array(split(regexp_replace(t, concat('(?:', pattern, ')'), "
        "'\ufdd0$0\ufdd1'), '[\ufdd0\ufdd1]', -1)), p -> transform(array(aggregate(p, array(0), (a, x) -> concat(a, array(element_at(a, -1) + length(x))))), "
        "e -> transform(filter(sequence(0, size(p) - 1), i -> i % 2 = 1), i -> named_struct('start', e[i], 'end', e[i + 1], 'match', p[i])))[0])[0])",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for head, body in {**_SCALARS, **_TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in (*_SCALARS, *_TABLES)]
