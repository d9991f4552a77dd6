"""Values that a filter on user properties compares with."""

from __future__ import annotations

import json


def _as_object(given) -> dict:
    """The object that was given, itself or as JSON text; {} for anything else."""
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError:
            return {}
    return given if isinstance(given, dict) else {}


def normalize_value(value):
    """Plain text is trimmed and stays text, whatever it looks like. A wrapped value {"type": …, "value": …}, as an object or as
    JSON text, gives its value, and {"type": "null"} gives None. Everything else passes unchanged."""
    given = value.strip() if isinstance(value, str) else value
    wrapped = _as_object(given)
    kind = wrapped.get("type")
    if kind == "null":
        return None
    return wrapped["value"] if isinstance(kind, str) and "value" in wrapped else given
