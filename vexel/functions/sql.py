"""The same functions for SQL text. They are SQL bodies, so the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_A, _AB = "a ARRAY<DOUBLE>", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_SUM = "aggregate({}, 0D, (s, x) -> s + x)"
_DOT = _SUM.format("zip_with(a, b, (x, y) -> x * y)")
_SQUARE = _SUM.format("transform({}, x -> x * x)")
_COSINE = f"CASE WHEN size(a) <> size(b) THEN 0D ELSE coalesce(try_divide({_DOT}, nullif(sqrt({_SQUARE.format('a')} * {_SQUARE.format('b')}), 0D)), 0D) END"
_L2 = f"CASE WHEN size(a) <> size(b) THEN 0D ELSE sqrt({_SUM.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')}) END"
_L1 = f"CASE WHEN size(a) <> size(b) THEN 0D ELSE {_SUM.format('zip_with(a, b, (x, y) -> abs(x - y))')} END"
_SAFE_DOT = f"CASE WHEN size(a) <> size(b) THEN 0D ELSE {_DOT} END"
_NEAR = "CASE WHEN size(a) <> size(b) THEN false ELSE forall(zip_with(a, b, (x, y) -> abs(x - y)), d -> isnan(d) OR d <= {}) END"

FUNCTIONS = {
    "vec_dims": (_A, "INT", "size(a)"),
    "vec_dot": (_AB, "DOUBLE", _SAFE_DOT),
    "vec_norm": (_A, "DOUBLE", f"sqrt({_SQUARE.format('a')})"),
    "vec_normalize": (_A, "ARRAY<DOUBLE>", f"CASE WHEN {_SQUARE.format('a')} <> 0 THEN transform(a, x -> x / sqrt({_SQUARE.format('a')})) END"),
    "vec_add": (_AB, "ARRAY<DOUBLE>", "CASE WHEN size(a) = size(b) THEN zip_with(a, b, (x, y) -> x + y) END"),
    "vec_sub": (_AB, "ARRAY<DOUBLE>", "CASE WHEN size(a) = size(b) THEN zip_with(a, b, (x, y) -> x - y) END"),
    "vec_scale": (_A + ", f DOUBLE", "ARRAY<DOUBLE>", "transform(a, x -> x * f)"),
    "vec_equal": (_AB, "BOOLEAN", _NEAR.format("1e-6D")),
    "vec_equal_eps": (_AB + ", eps DOUBLE", "BOOLEAN", _NEAR.format("eps")),
    "vec_cosine": (_AB, "DOUBLE", _COSINE),
    "vec_cosine_distance": (_AB, "DOUBLE", f"1D - {_COSINE}"),
    "vec_euclidean": (_AB, "DOUBLE", _L2),
    "vec_manhattan": (_AB, "DOUBLE", _L1),
    "vec_distance": (_AB + ", metric INT", "DOUBLE", f"CASE metric WHEN 0 THEN 1D - {_COSINE} WHEN 1 THEN {_L2} WHEN 2 THEN {_L1} WHEN 3 THEN {_SAFE_DOT} ELSE 0D END"),
    "text_tokens": ("t STRING", "ARRAY<STRING>", r"filter(split(lower(translate(t, 'İΣ', 'iσ')), r'[^\p{L}\p{Nd}]+'), x -> octet_length(x) >= 2)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make them temporary functions of the session; their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
