"""Evidence mapping over tables and streams of semi-structured alerts.

Sub-packages
    functions  Column -> Column expressions (text, URLs, time, JSON, eligibility)
    operators  DataFrame -> DataFrame operators
    sources    readers and writers
    streaming  the same rules over Structured Streaming
    plans      bindings of every operator to the driver tables, with SQL checks
"""

from evimap.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
