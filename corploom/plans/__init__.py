"""The library's queries over the tables; importing a module of this package registers its queries."""

from __future__ import annotations

from . import corpus, dedup, files, listings, logs, reports, surface, tables, vectors
from .dedup import flagship
from .registry import ORACLES, QUERIES


def all_queries():
    return QUERIES


def all_oracles():
    return ORACLES
