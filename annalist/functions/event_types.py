"""The four named event types. The type column itself stays an open string."""

from __future__ import annotations

from pyspark.sql import Column

# Fixed values.
CREATED = "created"
UPDATED = "updated"
DELETED = "deleted"
REPLAYED = "replayed"
NAMED_EVENT_TYPES = (CREATED, UPDATED, DELETED, REPLAYED)


def is_named(event_type: Column) -> Column:
    return event_type.isin(*NAMED_EVENT_TYPES)
