"""Routing of captured binary frames, without decoding their payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes, and the data header of start LSN, end LSN and time.
DATA_BYTE, KEEPALIVE_BYTE = "w", "k"
SHORTEST_BODY, HEADER_BYTES = 8, 24


def _header_number(frame: Column, start: int) -> Column:
    return F.conv(F.hex(F.substring(frame, start, 8)), 16, 10).cast("decimal(20,0)")


def route_frames(frames: DataFrame) -> DataFrame:
    """Add the outcome of each frame and, for whole data frames, header and payload.

    Tests run in this order: empty, first byte, body length, payload length.
    """
    frame = F.col("frame")
    first = F.substring(frame, 1, 1)
    body = F.length(frame) - 1
    is_data = first == F.lit(DATA_BYTE).cast("binary")
    outcome = (
        F.when(F.length(frame) == 0, "empty_frame")
        .when(first == F.lit(KEEPALIVE_BYTE).cast("binary"), "keepalive")
        .when(~is_data, "unknown")
        .when(body < SHORTEST_BODY, "short_lt8")
        .when(body < HEADER_BYTES, "short_lt24")
        .when(body == HEADER_BYTES, "empty_payload")
        .otherwise("payload")
    )
    whole = is_data & (body >= HEADER_BYTES)
    return frames.select(
        "*",
        outcome.alias("outcome"),
        F.when(whole, _header_number(frame, 2)).alias("wal_start"),
        F.when(whole, _header_number(frame, 10)).alias("wal_end"),
        F.when(whole, _header_number(frame, 18)).alias("sent_at"),
        # From after the header to the end; ``substring`` cuts at the frame's end.
        F.when(is_data & (body > HEADER_BYTES), F.substring(frame, HEADER_BYTES + 2, 2147483647)).alias("payload"),
    )
