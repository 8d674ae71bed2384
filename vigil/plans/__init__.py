"""Registered queries over the given tables, with their checking SQL."""

from vigil.plans import (  # noqa: F401
    detect_queries,
    ingest_queries,
    parse_queries,
    pipeline_queries,
    port_queries,
    response_queries,
    stream_queries,
)
