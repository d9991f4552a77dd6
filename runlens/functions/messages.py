"""Chat messages: parsing, last text, validity, previews, text extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MESSAGE_DDL

REDACTED = "__NOT_INGESTED__"
PREVIEW_CHARS = 100


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_container(col: Column | str) -> Column:
    """The text is a JSON array or object that parses."""
    c = _c(col)
    return F.substring(F.ltrim(c), 1, 1).isin("[", "{") & F.try_parse_json(c).isNotNull()


def plain_string(col: Column | str) -> Column:
    """A JSON string literal without its quotes, else the text itself."""
    c = _c(col)
    quoted = F.substring(c, 1, 1) == '"'
    return F.when(quoted, F.coalesce(F.get_json_object(F.concat(F.lit("["), c, F.lit("]")), "$[0]"), c)).otherwise(c)


def parse(col: Column | str) -> Column:
    """Message array; a single object gives one message, anything else null."""
    c = _c(col)
    return F.when(F.substring(F.ltrim(c), 1, 1).isin("[", "{"), F.from_json(c, MESSAGE_DDL))


def is_message(m: Column) -> Column:
    body = F.coalesce(
        F.nullif(m["content"], F.lit("")), m["toolCalls"], m["tool_calls"], m["functionCall"], m["function_call"]
    )
    return F.coalesce((m["role"] != "") & body.isNotNull(), F.lit(False))


def valid_messages(col: Column | str) -> Column:
    """The messages when every one is a chat message, else null."""
    msgs = parse(col)
    return F.when((F.size(msgs) > 0) & F.forall(msgs, is_message), msgs)


def last_text(col: Column | str) -> Column:
    """Content of the last message; a plain string stays; other JSON stays as text."""
    c = _c(col)
    msgs = parse(c)
    first_ok = F.coalesce(is_message(F.get(msgs, F.lit(0))), F.lit(False))
    return F.when(first_ok, F.element_at(msgs, -1)["content"]).when(
        F.substring(c, 1, 1) == '"', plain_string(c)
    ).otherwise(c)


def unwrap(col: Column | str, key: str) -> Column:
    """``{"input": x}`` with that one key → x."""
    c = _c(col)
    keys = F.json_object_keys(c)
    return F.when((F.size(keys) == 1) & (keys[0] == key), F.get_json_object(c, f"$.{key}")).otherwise(c)


def preview(col: Column | str, key: str = "input") -> Column:
    return F.substring(last_text(unwrap(col, key)), 1, PREVIEW_CHARS)


def texts(col: Column | str) -> Column:
    """One text per message: content, else its JSON; redacted or null input gives empty text."""
    c = _c(col)
    msgs = parse(c)
    per_message = F.transform(
        msgs, lambda m: F.coalesce(m["content"], F.to_json(m), F.lit(""))
    )
    return (
        F.when(c.isNull() | (plain_string(c) == REDACTED), F.array(F.lit("")))
        .when(msgs.isNotNull(), per_message)
        .otherwise(F.array(plain_string(c)))
    )


def content_text(col: Column | str) -> Column:
    """All message texts joined by a space."""
    return F.array_join(texts(col), " ")
