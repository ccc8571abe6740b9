"""Identifiers for trails and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_id() -> Column:
    """Random UUID text. Not repeatable: a recomputed task draws new values, so
    write the result down before using it twice."""
    return F.uuid()


def stable_id(*parts: Column) -> Column:
    """Repeatable id: the same parts always give the same text, on any retry."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def batch_id(run: str, batch: int) -> Column:
    """The same UUID text for every attempt at a batch."""
    digest = F.md5(F.lit(f"{run}|{batch}").cast("binary"))
    cut = [F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)
