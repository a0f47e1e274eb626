"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

GENERATIONS = T.StructType(
    [
        T.StructField("run_key", T.StringType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("config", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("stack_id", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("n_output_tokens", T.IntegerType()),
        T.StructField("output_bytes", T.IntegerType()),
        T.StructField("answer_gold", T.ArrayType(T.StringType())),
        T.StructField("correct", T.BooleanType()),
        T.StructField("drift", T.DoubleType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("meta", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
STACKS = T.StructType(
    [
        T.StructField("stack_id", T.StringType(), False),
        T.StructField("description", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)
EXPECTED = T.StructType([T.StructField("label", T.StringType(), False), T.StructField("want", T.DoubleType())])
PERCENTILES = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("model", "lang")),
        *(T.StructField(n, T.LongType()) for n in ("n", "Q50", "Q90", "Qmax")),
        T.StructField("source", T.StringType()),
    ]
)
