"""A typed clause list → filter tree → filtered runs.

Clauses have one of three shapes, listed in ``SHAPES``: a comparison of one quantity, a choice among listed values, or a
key with its value. Whatever a clause lacks is reported as {"clause": id, "code": reason, …} and restricts nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .filters import COMPARE_ZERO, Tables, filter_runs

# fixed values: seconds per unit
UNIT_SECONDS = {"milliseconds": 0.001, "ms": 0.001, "seconds": 1, "minutes": 60, "hours": 3600}


class Unusable(Exception):
    """A clause that gives no leaf: its code and what to say with it."""

    def __init__(self, code: str, **more):
        super().__init__(code)
        self.report = {"code": code, **more}


def _listed(clause: dict) -> list:
    many = clause.get("values") or [clause.get("value")]
    return [v for v in many if v is not None]


def _quantity(clause: dict, given) -> int | float:
    try:
        n = float(given) * (UNIT_SECONDS.get(clause["unit"], 1) if clause.get("unit") else 1)
    except (TypeError, ValueError):
        raise Unusable("not_a_number", value=given) from None
    if not math.isfinite(n):
        raise Unusable("not_a_number", value=given)
    return int(n) if n.is_integer() else n


def _instant(clause: dict, given) -> str:
    if not given:
        raise Unusable("no_instant")
    return given


@dataclass(frozen=True)
class Compared:
    """``operand`` reads one bound; a ``between`` becomes the two strict comparisons around it."""

    operand: Callable = _quantity
    source: tuple[str, str] = ("value", "range")
    extra: dict = field(default_factory=dict)

    def leaves(self, name: str, clause: dict, allowed: Iterable[str]) -> list:
        op, (single, pair) = clause.get("op", "gt"), self.source
        if op == "between":
            bounds = clause.get(pair)
            if not isinstance(bounds, (list, tuple)) or len(bounds) != 2:
                raise Unusable("two_bounds_needed")
            asked = list(zip(("gt", "lt"), bounds, strict=True))
        elif op in COMPARE_ZERO:
            asked = [(op, clause.get(single) if clause.get(single) is not None else clause.get("value"))]
        else:
            raise Unusable("unknown_operator", operator=op)
        further = {k: clause.get(k, v) for k, v in self.extra.items()}
        nodes = [{"id": name, "params": {**further, "operator": o, name: self.operand(clause, x)}} for o, x in asked]
        return nodes if len(nodes) == 1 else [["AND", *nodes]]


@dataclass(frozen=True)
class Chosen:
    """The listed values go to ``param``, all or the first; ``matches`` says which allowed value a listed one stands for."""

    param: str
    first: bool = False
    default: tuple = ()
    extra: dict = field(default_factory=dict)
    source: Callable = _listed
    matches: Callable[[str, str], bool] = str.__eq__

    def leaves(self, name: str, clause: dict, allowed: Iterable[str]) -> list:
        wanted = [v if isinstance(v, str) else str(v) for v in self.source(clause)] or list(self.default)
        if not wanted:
            raise Unusable("no_value")
        if allowed:
            strange = [w for w in wanted if not any(self.matches(a, w) for a in allowed)]
            wanted = [a for a in allowed if any(self.matches(a, w) for w in wanted)]
            if strange:
                clause.setdefault("_reports", []).append({"code": "not_allowed", "values": strange})
            if not wanted:
                return []
        return [{"id": name, "params": {**{k: clause.get(k, v) for k, v in self.extra.items()}, self.param: wanted[0] if self.first else wanted}}]


@dataclass(frozen=True)
class Keyed:
    """A key and its value, named or as the two listed values."""

    def leaves(self, name: str, clause: dict, allowed: Iterable[str]) -> list:
        rest = list(clause.get("values") or [])
        key = clause.get("key") or (rest.pop(0) if rest else None)
        value = clause.get("value") if clause.get("value") is not None else (rest[-1] if rest else None)
        if not key or value is None:
            raise Unusable("key_and_value_needed")
        return [{"id": name, "params": {"key": str(key), "value": value}}]


def _thumbs(clause: dict) -> list[str]:
    return [json.dumps({"thumb": None if t == "null" else t}, separators=(",", ":")) for t in clause.get("thumbs") or []]


def _flag(clause: dict) -> list:
    return [clause["flag"]] if clause.get("flag") else _listed(clause)


_ANY = {"field": "any"}
SHAPES = {
    "cost": Compared(),
    "date": Compared(_instant, ("iso", "iso")),
    "duration": Compared(),
    "tokens": Compared(extra={"field": "total"}),
    "metadata": Keyed(),
    "feedback": Chosen("types", source=_thumbs),
    "intents": Chosen("intents"),
    "languages": Chosen("codes", extra=_ANY),
    "models": Chosen("models", matches=str.startswith),
    "pii": Chosen("containsPii", first=True, default=("true",), source=_flag),
    "retrievers": Chosen("retrieverName", first=True),
    "status": Chosen("status", first=True),
    "tags": Chosen("tags"),
    "templates": Chosen("templates"),
    "tools": Chosen("toolName", first=True),
    "topics": Chosen("topics", extra=_ANY),
    "toxicity": Chosen("type", first=True, default=("toxic",), extra=_ANY),
    "type": Chosen("type", first=True),
    "users": Chosen("users"),
}


def compile_plan(plan: dict, allowed: dict[str, list[str]] | None = None) -> tuple[list, list]:
    """(filter tree, reports)."""
    reports = list(plan.get("unmatched") or [])

    def nodes(clauses: Iterable[dict]) -> list:
        out = []
        for given in clauses:
            clause, name = dict(given), given.get("id")
            try:
                if name not in SHAPES:
                    raise Unusable("unknown_filter")
                out += SHAPES[name].leaves(name, clause, (allowed or {}).get(name) or ())
            except Unusable as missing:
                clause.setdefault("_reports", []).append(missing.report)
            reports.extend({"clause": name, **r} for r in clause.get("_reports", ()))
        return out

    tree = nodes(plan.get("clauses") or [])
    tree += [[g["op"], *inner] for g in plan.get("groups") or [] if (inner := nodes(g["clauses"]))]
    return ["OR" if plan.get("op") == "OR" and len(tree) > 1 else "AND", *tree], reports


def filter_by_plan(runs: DataFrame, plan: dict, allowed=None, tables: Tables | None = None) -> tuple[DataFrame, list]:
    logic, reports = compile_plan(plan, allowed)
    return filter_runs(runs, logic, tables), reports
