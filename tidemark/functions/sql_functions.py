"""Scalar market functions by name for SQL text: temporary SQL functions, which the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result and body.
FUNCTIONS = {
    "log_return_bps": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a > 0 AND b > 0 THEN ln(b / a) * 1e4 END"),
    "ternary_label": ("a DOUBLE, b DOUBLE, bps DOUBLE", "INT", "CASE WHEN b > a * (1 + bps / 1e4) THEN 1 WHEN b < a * (1 - bps / 1e4) THEN -1 ELSE 0 END"),
    "log_blend": ("a DOUBLE, b DOUBLE, weight DOUBLE", "DOUBLE", "exp(weight * CASE WHEN a = 0 THEN double('-Infinity') ELSE ln(a) END + (1 - weight) * CASE WHEN b = 0 THEN double('-Infinity') ELSE ln(b) END)"),
    "range_place": ("x DOUBLE, high DOUBLE, low DOUBLE", "DOUBLE", "CASE WHEN high > low THEN (x - low) / (high - low) ELSE 0.5D END"),
    "variance_ratio_class": ("ratio DOUBLE, tolerance DOUBLE", "STRING", "CASE WHEN ratio IS NULL THEN 'none' WHEN abs(ratio - 1) <= tolerance THEN 'scale-invariant' WHEN ratio < 1 THEN 'reverting' ELSE 'trending' END"),
    "agrees_with_exchange": ("estimated DOUBLE, reported DOUBLE", "BOOLEAN", "reported <> 0 AND abs(estimated - reported) <= 0.01 * abs(reported)"),
    "since_ms": ("text STRING, now_ms BIGINT", "BIGINT", "CASE WHEN text RLIKE '^[0-9]+[smhd]$' THEN now_ms - cast(substring(text, 1, length(text) - 1) AS BIGINT) * CASE right(text, 1) WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 86400000 END ELSE unix_millis(try_to_timestamp(text)) END"),
}


def register(spark: SparkSession) -> None:
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
