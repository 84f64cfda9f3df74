"""tracewise: trace analytics, regression detection, root-cause attribution,
answer evaluation and retrieval-quality jobs for question-answering systems,
written as plain Spark DataFrame operators.

Layout
------
sources/    readers for the event log, tables, corpus and lookup sets
functions/  column-level helpers (tokens, time floors, exact rounding, text)
operators/  DataFrame -> DataFrame operators (traces, metrics, detection, ...)
plans/      the registered queries over the test tables and their SQL oracles
streaming/  Structured Streaming forms of trace assembly and metric windows
"""

from tracewise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
