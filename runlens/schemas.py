"""Explicit schemas. Open JSON fields are kept as JSON text and read by functions.json."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, INT, DBL, BOOL, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TOKENS = _struct(("prompt", INT), ("completion", INT), ("prompt_cached", INT))

EVENT = _struct(
    ("type", STR), ("event", STR), ("level", STR), ("run_id", STR), ("parent_run_id", STR),
    ("timestamp", STR), ("name", STR), ("input", STR), ("output", STR), ("tags", STR),
    ("message", STR), ("extra", STR), ("feedback", STR), ("metadata", STR), ("params", STR),
    ("error", STR), ("template_id", STR), ("template_version_id", STR), ("user_id", STR),
    ("user_props", STR), ("tokens_usage", TOKENS), ("app_id", STR), ("runtime", STR),
    ("thread_tags", STR),
)

RUN = _struct(
    ("id", STR), ("project_id", STR), ("type", STR), ("name", STR), ("status", STR),
    ("created_at", TS), ("ended_at", TS), ("parent_run_id", STR), ("external_user_id", LONG),
    ("input", STR), ("output", STR), ("error", STR), ("params", STR), ("metadata", STR),
    ("feedback", STR), ("tags", T.ArrayType(STR)), ("prompt_tokens", INT),
    ("completion_tokens", INT), ("cached_prompt_tokens", INT), ("cost", DBL),
    ("template_version_id", INT), ("sibling_run_id", STR), ("runtime", STR),
    ("is_public", BOOL), ("is_deleted", BOOL),
)

EXTERNAL_USER = _struct(
    ("id", LONG), ("project_id", STR), ("external_id", STR), ("created_at", TS),
    ("last_seen", TS), ("props", STR),
)

EVALUATION_RESULT = _struct(("run_id", STR), ("evaluator_id", STR), ("result", STR))

MODEL_MAPPING = _struct(
    ("id", LONG), ("name", STR), ("pattern", STR), ("unit", STR), ("input_cost", DBL),
    ("output_cost", DBL), ("input_caching_cost_reduction", DBL), ("start_date", TS),
    ("org_id", STR),
)

ANY_VALUE = _struct(
    ("string_value", STR), ("bool_value", BOOL), ("int_value", LONG), ("double_value", DBL),
    ("array_value", STR), ("kvlist_value", STR), ("bytes_value", T.BinaryType()),
)

KEY_VALUE = _struct(("key", STR), ("value", ANY_VALUE))

SPAN = _struct(
    ("trace_id", STR), ("span_id", STR), ("parent_span_id", STR),
    ("start_time_unix_nano", LONG), ("end_time_unix_nano", LONG),
    ("attributes", T.ArrayType(KEY_VALUE)), ("events", STR),
)

MESSAGE_DDL = (
    "array<struct<role:string,content:string,name:string,toolCalls:string,tool_calls:string,"
    "functionCall:string,function_call:string>>"
)
