"""OpenTelemetry span and log tables (already decoded) → events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import plain_string
from ..operators.clean import run_uuid
from ..operators.skew import ordered_lists

MAX_EVENT_CHARS = 1_000_000
MAX_FIELD_CHARS = 100_000

# fixed values: operation name → run type
OPERATION_TYPES = {
    "chat": "llm", "text_completion": "llm", "generate_content": "llm", "embeddings": "embed",
    "execute_tool": "tool", "create_agent": "agent", "invoke_agent": "agent",
}

# fixed values: attribute → metadata key
NAMED_ATTRIBUTES = {
    "gen_ai.system": "system", "gen_ai.conversation.id": "conversation_id", "gen_ai.tool.call.id": "tool_call_id",
    "gen_ai.tool.name": "tool_name", "gen_ai.tool.description": "tool_description", "gen_ai.tool.type": "tool_type",
    "gen_ai.response.model": "model_response", "gen_ai.response.finish_reasons": "finish_reasons", "gen_ai.response.id": "response_id",
}
REQUEST, RESPONSE, USAGE = "gen_ai.request.", "gen_ai.response.", "gen_ai.usage."
PYDANTIC, LOGFIRE = "pydantic_ai.", "logfire."
TOKEN_KEYS = ("input_tokens", "output_tokens", "prompt_tokens_cached")


def json_string(text: Column) -> Column:
    """A text as a JSON string literal."""
    one = F.to_json(F.array(text))
    return one.substr(F.lit(2), F.length(one) - 2)


def any_value(v: Column) -> Column:
    """Any-value struct → JSON text; strings that are JSON themselves are taken as JSON."""
    s = v["string_value"]
    # parsing plain words would raise and recover once per attribute, so only candidates are tried
    candidate = s.rlike(r'^\s*([\[{"0-9-]|true|false|null)')
    return F.coalesce(
        F.when(s.isNotNull(), F.when(candidate & F.try_parse_json(s).isNotNull(), s).otherwise(json_string(s))),
        v["bool_value"].cast("string"),
        v["int_value"].cast("string"),
        v["double_value"].cast("string"),
        v["array_value"],
        v["kvlist_value"],
    )


def attribute_map(attributes: Column | str = "attributes") -> Column:
    """array<struct<key,value>> → map of JSON texts; the last of equal keys wins."""
    col = F.col(attributes) if isinstance(attributes, str) else attributes
    entries = F.transform(col, lambda kv: F.struct(kv["key"], any_value(kv["value"])))
    return F.map_from_entries(F.filter(entries, lambda e: e["col2"].isNotNull()))


def _after(key: Column, prefix: str) -> Column:
    return F.substring(key, len(prefix) + 1, 10_000)


def _json_of(m: Column) -> Column:
    """Map of JSON texts → JSON object text, null when empty. The values are JSON already and are only joined."""
    escaped = lambda k: F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(F.lit('"'), escaped(e["key"]), F.lit('":'), e["value"]))
    return F.when(F.size(m) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def params_of(attrs: Column) -> Column:
    picked = F.map_filter(attrs, lambda k, v: k.startswith(REQUEST))
    name = lambda k: F.when(_after(k, REQUEST) == "stop_sequences", F.lit("stop")).otherwise(_after(k, REQUEST))
    return _json_of(F.transform_keys(picked, lambda k, v: name(k)))


def _is_binary(v: Column) -> Column:
    """A data URL or an over-long text; the text is decoded only when its length leaves a doubt."""
    too_long = (F.length(v) > MAX_FIELD_CHARS) & (F.length(plain_string(v)) > MAX_FIELD_CHARS)
    return v.startswith('"') & (v.startswith('"data:') | too_long)


def _shortened(v: Column) -> Column:
    note = F.concat(F.lit('{"truncated":true,"original_size":'), F.length(v).cast("string"), F.lit("}"))
    return F.when(F.substring(v, 1, 1).isin("{", "[") & (F.length(v) > MAX_FIELD_CHARS), note).otherwise(v)


def metadata_of(attrs: Column) -> Column:
    """Response, usage, vendor and unknown attributes under metadata; binary values left out."""
    named = F.create_map(*[F.lit(x) for kv in NAMED_ATTRIBUTES.items() for x in kv])
    fixed = lambda k: F.try_element_at(named, k)
    token = lambda k: k.startswith(USAGE) & _after(k, USAGE).isin(*TOKEN_KEYS)
    known = lambda k: k.startswith("gen_ai.") | k.startswith(PYDANTIC)
    keep = lambda k, v: ~(
        k.startswith(REQUEST) | token(k) | k.isin("gen_ai.operation.name", "error.type", "error.message", "error.stack")
    ) & (known(k) | ~_is_binary(v))
    under = lambda k, p, tag: F.concat(F.lit(tag), F.replace(_after(k, p), F.lit("."), F.lit("_")))
    rename = lambda k: (
        F.when(fixed(k).isNotNull(), fixed(k))
        .when(k.startswith(RESPONSE), _after(k, RESPONSE))
        .when(k.startswith(USAGE), _after(k, USAGE))
        .when(k.startswith(PYDANTIC), under(k, PYDANTIC, "pydantic_"))
        .when(k.startswith(LOGFIRE), under(k, LOGFIRE, "logfire_"))
        .otherwise(k)
    )
    short = F.transform_values(F.map_filter(attrs, keep), lambda k, v: F.when(known(k), v).otherwise(_shortened(v)))
    return _json_of(F.transform_keys(short, lambda k, v: rename(k)))


def text_at(attrs: Column, key: str) -> Column:
    return plain_string(F.try_element_at(attrs, F.lit(key)))


def usage_of(attrs: Column) -> Column:
    n = lambda k: text_at(attrs, USAGE + k).cast("int")
    return F.struct(n("input_tokens").alias("prompt"), n("output_tokens").alias("completion"), n("prompt_tokens_cached").alias("prompt_cached"))


def error_of(attrs: Column) -> Column:
    parts = F.struct(
        text_at(attrs, "error.type").alias("code"), text_at(attrs, "error.message").alias("message"), text_at(attrs, "error.stack").alias("stack")
    )
    any_part = F.coalesce(parts["code"], parts["message"], parts["stack"]).isNotNull()
    return F.when(any_part, F.to_json(parts))


def model_of(attrs: Column) -> Column:
    raw = F.coalesce(text_at(attrs, REQUEST + "model"), text_at(attrs, RESPONSE + "model"))
    return F.regexp_replace(raw, "^((?:(?!models/).)*)models/", "$1")


def with_attributes(df: DataFrame) -> DataFrame:
    """Adds name, params, metadata, tokens_usage and error from the attributes."""
    a = attribute_map()
    d = df.withColumn("attrs", a)
    c = F.col("attrs")
    return (
        d.withColumn("name", model_of(c)).withColumn("params", params_of(c)).withColumn("metadata", metadata_of(c))
        .withColumn("tokens_usage", usage_of(c)).withColumn("error", error_of(c))
    )


def _millis(ns: str) -> Column:
    return F.timestamp_millis(F.floor(F.col(ns) / 1_000_000))


def span_type(attrs: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in OPERATION_TYPES.items() for x in kv])
    by_op = F.try_element_at(types, F.coalesce(text_at(attrs, "gen_ai.operation.name"), F.lit("")))
    return (
        F.when(F.try_element_at(attrs, F.lit("gen_ai.tool.name")).isNotNull(), "tool")
        .when(F.try_element_at(attrs, F.lit("agent_name")).isNotNull(), "agent")
        .when(by_op.isin("llm", "agent", "tool"), by_op)
        .otherwise("chain")
    )


def _tool_input(attrs: Column) -> Column:
    """Arguments named by the tool's JSON schema when any are present, else tool_arguments."""
    wanted = F.json_object_keys(F.get_json_object(F.try_element_at(attrs, F.lit("attributes_json_schema")), "$.properties"))
    picked = F.map_filter(attrs, lambda k, v: F.array_contains(wanted, k))
    return F.coalesce(_json_of(picked), F.try_element_at(attrs, F.lit("tool_arguments")))


def spans_to_events(spans: DataFrame) -> DataFrame:
    """Each span becomes a start and an end event."""
    s = spans.withColumn("attrs", attribute_map())
    a = F.col("attrs")
    s = s.withColumn("type", span_type(a)).withColumn("evs", F.from_json(F.coalesce(F.try_element_at(a, F.lit("events")), "events"), "array<string>"))
    evs, kind = F.col("evs"), F.col("type")
    at = lambda k: F.try_element_at(a, F.lit(k))
    many = F.size(evs) > 0
    listed = lambda arr: F.concat(F.lit("["), F.array_join(arr, ","), F.lit("]"))
    name = (
        F.when(kind == "llm", text_at(a, REQUEST + "model")).when(kind == "agent", F.coalesce(text_at(a, "agent_name"), F.lit("Agent")))
        .when(kind == "tool", text_at(a, "gen_ai.tool.name")).otherwise(text_at(a, "span_name"))
    )
    tools = F.concat(F.lit('{"tools":'), at("tools"), F.lit("}"))
    input_ = (
        F.when(kind == "llm", F.when(many, listed(F.slice(evs, F.lit(1), F.greatest(F.size(evs) - 1, F.lit(0))))))
        .when(kind == "agent", at("all_messages_events")).when(kind == "tool", _tool_input(a)).otherwise(F.coalesce(tools, F.lit("{}")))
    )
    output = (
        F.when(kind == "llm", F.when(many, F.get_json_object(F.element_at(evs, -1), "$.message"))).when(kind == "agent", at("final_result"))
        .when(kind == "tool", F.coalesce(F.when(many, listed(evs)), at("tool_output")))
    )
    call = F.when(kind == "chain", at("gen_ai.tool.call.id"))
    request = params_of(F.map_filter(a, lambda k, v: _after(k, REQUEST) != "model"))
    nothing = F.lit(None).cast("string")
    usage = F.when(kind == "llm", usage_of(a))
    start = F.struct(
        F.lit("start").alias("event"), _millis("start_time_unix_nano").alias("ts"), input_.alias("input"), nothing.alias("output"),
        F.when(kind == "llm", request).alias("params"), F.lit(None).cast(usage_type()).alias("tokens_usage"),
        F.when(call.isNotNull(), F.concat(F.lit('{"call_id":'), call, F.lit("}"))).alias("metadata"),
    )
    end = F.struct(
        F.lit("end").alias("event"), _millis("end_time_unix_nano").alias("ts"), nothing.alias("input"), output.alias("output"),
        nothing.alias("params"), usage.alias("tokens_usage"), nothing.alias("metadata"),
    )
    base = s.select(
        F.col("span_id").alias("run_id"), F.nullif(F.col("parent_span_id"), F.lit("")).alias("parent_run_id"), "type", name.alias("name"),
        F.explode(F.array(start, end)).alias("e"),
    )
    return base.select("run_id", "parent_run_id", "type", "name", "e.*")


def usage_type() -> str:
    return "struct<prompt:int,completion:int,prompt_cached:int>"


def logs_to_events(logs: DataFrame) -> DataFrame:
    """gen_ai.* log records → tool, llm, message or log events."""
    d = with_attributes(logs.where("time_unix_nano is not null and name like 'gen_ai.%'").withColumnRenamed("name", "log_name"))
    n, a = F.col("log_name"), F.col("attrs")
    is_tool, is_choice = n == "gen_ai.tool.message", n == "gen_ai.choice"
    is_message = n.isin("gen_ai.system.message", "gen_ai.user.message", "gen_ai.assistant.message")
    finish = text_at(a, "gen_ai.choice.finish_reason")
    last = F.element_at(F.split(n, "[.]"), -1)
    span = F.nullif(F.col("span_id"), F.lit(""))
    kind = F.when(is_tool, "tool").when(is_choice, "llm").when(is_message, "message").otherwise("log")
    event = (
        F.when(is_tool, "complete").when(is_choice, F.when(finish.isNotNull(), "end").otherwise("stream"))
        .when(is_message, F.split(n, "[.]")[1]).otherwise(last)
    )
    own = F.coalesce(F.when(is_tool, text_at(a, "gen_ai.tool.call.id")), span, F.sha2(F.concat_ws("|", "trace_id", "time_unix_nano", "log_name"), 256))
    body = F.col("body")
    return d.select(
        kind.alias("type"), event.alias("event"), run_uuid(own).alias("run_id"), F.when(is_tool, run_uuid(span)).alias("parent_run_id"),
        _millis("time_unix_nano").alias("ts"), F.coalesce(F.when(is_tool, text_at(a, "gen_ai.tool.name")), "name").alias("name"),
        F.when(is_tool | is_choice, body).alias("output"), F.when(~(is_tool | is_choice), body).alias("message"), "metadata", "params", "tokens_usage", "error",
    )


def guard_size(events: DataFrame, max_event: int = MAX_EVENT_CHARS, max_field: int = MAX_FIELD_CHARS) -> DataFrame:
    """Oversized events: long input, output and metadata are cut; what stays too long is marked."""
    size = lambda: F.length(F.to_json(F.struct("input", "output", "metadata")))
    d = events.withColumn("_size", size())
    big = F.col("_size") > max_event
    for c in ("input", "output", "metadata"):
        note = F.concat(F.lit('{"truncated":true,"original_size":'), F.length(c).cast("string"), F.lit("}"))
        head = F.concat(F.substring(c, 1, max_field), F.lit("... [truncated "), (F.length(c) - max_field).cast("string"), F.lit(" chars]"))
        cut = F.when(F.substring(c, 1, 1).isin("{", "["), note).otherwise(head)
        d = d.withColumn(c, F.when(big & (F.length(c) > max_field), cut).otherwise(F.col(c)))
    still = big & (size() > max_event)
    mark = F.concat(F.lit('{"truncated":true,"original_size":'), F.col("_size").cast("string"), F.lit("}"))
    return d.withColumn("metadata", F.when(still, mark).otherwise(F.col("metadata"))).withColumn("truncated", big).drop("_size")


def tool_calls(events: DataFrame) -> DataFrame:
    """Long form: one row per tool child with call id and name (parent_run_id, call_id, name, arguments, result)."""
    from ..functions.json import get_text

    rows = events.where("type = 'tool' and parent_run_id is not null")
    return rows.select(
        "parent_run_id", get_text("metadata", "tool_call_id").alias("call_id"), get_text("metadata", "tool_name").alias("tool"),
        F.coalesce(get_text("metadata", "tool_arguments"), "input").alias("arguments"), F.col("output").alias("result"), "ts",
    ).where("call_id is not null and tool is not null")


def roll_up_tool_calls(events: DataFrame) -> DataFrame:
    """Put tool calls into output.tool_calls of the parent's end event; ``tool_calls`` has them as rows."""
    calls = tool_calls(events).withColumnRenamed("parent_run_id", "run_id")
    item = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), "arguments", "result"))
    lists = ordered_lists(calls, ["run_id"], item, F.struct("ts", "call_id"), "tool_calls")
    joined = events.join(lists, "run_id", "left")
    fits = (F.col("event") == "end") & F.col("tool_calls").isNotNull() & (F.col("output").isNull() | F.col("output").startswith("{"))
    body = F.concat(F.lit('{"tool_calls":['), F.array_join("tool_calls", ","), F.lit("]"))
    merged = F.when(F.col("output").isNull() | (F.trim("output") == "{}"), F.concat(body, F.lit("}"))).otherwise(
        F.concat(body, F.lit(","), F.substring(F.ltrim("output"), 2, 2_000_000_000))
    )
    return joined.withColumn("output", F.when(fits, merged).otherwise(F.col("output"))).drop("tool_calls")
