"""Structured Streaming forms of the operators that react to events."""
from folioflow.streaming.events import (
    debounce, debounce_stream, incremental_scan, read_extracted, scan_changes, stream_extract, supersede, supersede_stream,
)

__all__ = [
    "debounce", "debounce_stream", "incremental_scan", "read_extracted", "scan_changes", "stream_extract", "supersede", "supersede_stream",
]
