"""JSON text helpers: typed containment, key tests, path arrays, merging."""

from __future__ import annotations

import json as _json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def path_of(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def get_text(col: Column | str, key: str) -> Column:
    """``->>``: the value as text; JSON null gives SQL null."""
    return F.get_json_object(_c(col), path_of(key))


def get_path(col: Column | str, *keys: str) -> Column:
    return F.get_json_object(_c(col), "$" + "".join("['" + k + "']" for k in keys))


def get_typed(col: Column | str, key: str, ddl: str) -> Column:
    """Value at ``key`` cast to ``ddl``, null when it does not fit."""
    return F.try_variant_get(F.try_parse_json(_c(col)), path_of(key), ddl)


def has_key(col: Column | str, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_c(col)), key), F.lit(False))


def type_at(col: Column | str, key: str) -> Column:
    """Variant type name at ``key``: STRING, BOOLEAN, BIGINT, DECIMAL(…), DOUBLE, VOID, ARRAY…, OBJECT…"""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(_c(col)), path_of(key), "variant"))


def contains_value(col: Column | str, key: str, value) -> Column:
    """``@> {key: value}`` with JSON typing: "1" and 1 differ."""
    kind = type_at(col, key)
    text = get_text(col, key)
    if value is None:
        hit = kind == "VOID"
    elif isinstance(value, bool):
        hit = (kind == "BOOLEAN") & (text == str(value).lower())
    elif isinstance(value, (int, float)):
        number = get_typed(col, key, "double")
        hit = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|INT|FLOAT)") & (number == F.lit(float(value)))
    elif isinstance(value, (dict, list)):
        wanted = _json.dumps(value, separators=(",", ":"), sort_keys=True)
        hit = F.to_json(F.try_parse_json(text)) == F.to_json(F.parse_json(F.lit(wanted)))
    else:
        hit = (kind == "STRING") & (text == F.lit(str(value)))
    return F.coalesce(hit, F.lit(False))


def path_array(col: Column | str, array_key: str, element: str = "string") -> Column:
    """``$.array_key[*]`` as an array of JSON texts, or of ``element`` when given."""
    return F.from_json(get_text(col, array_key), f"array<{element}>")


def is_array_at(col: Column | str, key: str) -> Column:
    return F.coalesce(get_text(col, key).startswith("["), F.lit(False))


def as_map(col: Column | str) -> Column:
    """Object text → map of key to raw value text."""
    return F.from_json(_c(col), "map<string,string>")


def as_variant_map(col: Column | str) -> Column:
    return F.from_json(_c(col), "map<string,variant>")


def merge(*cols: Column) -> Column:
    """Shallow ``||``: later keys win. Null arguments are left out; all null gives null."""
    maps = [F.coalesce(as_variant_map(c), F.expr("cast(map() as map<string,variant>)")) for c in cols]
    merged = F.map_concat(*maps)
    any_set = F.coalesce(*cols).isNotNull()
    return F.when(any_set, F.to_json(merged))


def without_key(col: Column | str, *keys: str) -> Column:
    m = as_variant_map(col)
    return F.to_json(F.map_filter(m, lambda k, v: ~k.isin(*keys)))


def is_json(col: Column | str) -> Column:
    return F.try_parse_json(_c(col)).isNotNull()
