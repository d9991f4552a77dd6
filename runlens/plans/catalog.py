"""Imports every family so that its queries are registered."""

from __future__ import annotations

from . import datasets, filters, ingest, pricing, relations, series, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
