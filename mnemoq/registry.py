"""The engine's own queries, by name, and their DuckDB twins."""

from __future__ import annotations

from mnemoq.functions import commands, shell, text
from mnemoq.operators import graph, memory, postings, redirect, rendering, retrieval, telemetry
from mnemoq.sources import event_log, sweep, symbol_index, transcripts, vectors
from mnemoq.streaming import budgets, metrics

FLAGSHIP = "e16_rrf_hybrid"
_MODULES = (telemetry, retrieval, postings, graph, text, commands, shell, transcripts, memory, symbol_index, rendering, vectors, sweep, event_log, redirect, budgets, metrics)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
