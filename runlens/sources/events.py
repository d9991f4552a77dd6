"""Event source: JSON lines, arrays or envelopes → one typed row per event, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT, TOKENS


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _spellings(name: str) -> list[str]:
    """A field may come as snake_case, camelCase or kebab-case."""
    return list(dict.fromkeys([name, _camel(name), name.replace("_", "-")]))


def _wire_schema() -> T.StructType:
    usage = T.StructType([T.StructField(n, T.IntegerType()) for f in TOKENS.fields for n in _spellings(f.name)])
    return T.StructType(
        [T.StructField(n, usage if f.name == "tokens_usage" else T.StringType()) for f in EVENT.fields for n in _spellings(f.name)]
    )


WIRE = _wire_schema()


def _pick(node: Column, name: str) -> Column:
    return F.coalesce(*[node[n] for n in _spellings(name)])


def _event(node: Column) -> list[Column]:
    cols = []
    for f in EVENT.fields:
        value = _pick(node, f.name)
        if f.name == "tokens_usage":
            value = F.when(value.isNotNull(), F.struct(*[_pick(value, t.name).alias(t.name) for t in TOKENS.fields]))
        cols.append(value.alias(f.name))
    return cols


def _nested_items(value: Column) -> Column:
    """Envelopes and nested arrays → array of event texts."""
    body = F.coalesce(F.get_json_object(value, "$.events"), value)
    listed = F.when(F.substring(F.ltrim(body), 1, 1) == "[", F.from_json(body, "array<string>")).otherwise(F.array(body))
    return F.transform(listed, lambda e: F.when(F.substring(F.ltrim(e), 1, 1) == "[", F.get_json_object(e, "$[0]")).otherwise(e))


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of JSON text (one event, an array, an ``events`` envelope, one-element nested arrays) → typed
    events with snake_case names. Plain events and arrays are parsed once, straight into their columns."""
    text = F.col(value)
    plain = F.from_json(text, T.ArrayType(WIRE))
    lacks = lambda n: n.isNull() | (_pick(n, "type").isNull() & _pick(n, "event").isNull() & _pick(n, "run_id").isNull())
    # whatever does not look like events on the first try is unwrapped the long way
    items = lines.select(text.alias("_t"), plain.alias("_plain"))
    odd = F.col("_plain").isNull() | F.exists("_plain", lacks)
    unwrapped = F.transform(_nested_items(F.col("_t")), lambda t: F.from_json(t, WIRE))
    nodes = items.select(F.explode(F.when(odd, unwrapped).otherwise(F.col("_plain"))).alias("_e"))
    return nodes.select(*_event(F.col("_e")))


def read_events(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Files of JSON lines; each line may hold one event, an array of events, or an envelope."""
    if not stream:
        return parse_events(spark.read.text(path))
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_events(reader.text(path))


def event_rank(event: Column | str = "event") -> Column:
    """At equal time a start comes first, then an end, then the rest."""
    e = F.col(event) if isinstance(event, str) else event
    return F.when(e == "start", 0).when(e.isin("end", "error"), 1).otherwise(2)


def sequence_key(ts: str = "ts", arrival: Column | None = None) -> Column:
    """Total order of the events of one run: (time, start < end < rest, arrival)."""
    tie = arrival if arrival is not None else F.lit(0)
    return F.struct(F.col(ts).alias("t"), event_rank().alias("r"), tie.alias("a"))
