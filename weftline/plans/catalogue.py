"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from ..operators import access, analytics, answers, conversation, feedback, graph, loading, pages, passages, presentation, retrieval, semantic, steps, stored_graph, structure, versions
from ..streaming import feedback as stream_feedback
from ..streaming import windows
from .registry import Query

_MODULES = [analytics, graph, stored_graph, structure, pages, passages, semantic, retrieval, answers, versions, access, feedback, conversation, steps, presentation, loading, windows, stream_feedback]


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, f in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.registry.sql.items()}
