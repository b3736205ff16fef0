"""The scalar functions that queries in Spark SQL call by name: temporary SQL functions, so Catalyst plans them inline."""

from __future__ import annotations

from pyspark.sql import SparkSession

_NARROW5, _NARROW6 = "((({c}) * 31 + 127) div 255)", "((({c}) * 63 + 127) div 255)"

#: Name -> (parameters, type, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "gray8": ("r INT, g INT, b INT", "INT", "CAST(floor(0.212656D * r + 0.715158D * g + 0.072186D * b + 0.5D) AS INT)"),
    "rgb565": ("r INT, g INT, b INT", "INT", f"CAST({_NARROW5.format(c='r')} * 2048 + {_NARROW6.format(c='g')} * 32 + {_NARROW5.format(c='b')} AS INT)"),
    "argb": ("r INT, g INT, b INT, a INT", "BIGINT", "CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b"),
    "color_distance": ("r INT, g INT, b INT, s INT, t INT, u INT", "INT", "2 * (r - s) * (r - s) + 4 * (g - t) * (g - t) + 3 * (b - u) * (b - u)"),
    "base62_pair": ("n BIGINT", "STRING", "concat(substring('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(n div 62 AS INT) + 1, 1), substring('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(n % 62 AS INT) + 1, 1))"),
    "cache_key": ("query STRING", "STRING", "md5(query)"),
    "body_base64": ("body BINARY", "STRING", "regexp_replace(base64(body), '[\\r\\n]', '')"),
    "body_hex": ("body BINARY", "STRING", "lower(hex(body))"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
