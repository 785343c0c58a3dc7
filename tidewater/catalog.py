"""Imports every module that registers queries."""

from __future__ import annotations

from .operators import compaction, deltas, doc_recall, fusion, graph, joins, leaders, log_tiers, minhash, monitors, pages, ranking, recall, relational, retrieval, rules, sessions, shapes, signals, stats, text, windows  # noqa: F401
from .plans import queries as _plans, versions as _versions  # noqa: F401
from .registry import ORACLES, QUERIES
from .sources import event_export as _export, hosts as _hosts, importers as _importers  # noqa: F401
from .sources import queries as _sources  # noqa: F401
from .streaming import folds, tail  # noqa: F401


def queries():
    return QUERIES


def oracles():
    return ORACLES
