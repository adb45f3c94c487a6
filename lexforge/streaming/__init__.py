"""Streaming: the reference system has none, so this is an extra beside it.

``settle`` keeps the first delivery of each key within a watermark, which is what a stream
of late and repeated rows needs before it is appended to a table; batch reads settle
re-deliveries with ``runtime.latest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def settle(stream: DataFrame, keys: list[str], at: str = "received_at", late: str = "2 days") -> DataFrame:
    """The stream with one row per key; state older than the watermark is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
