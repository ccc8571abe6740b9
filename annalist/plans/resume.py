"""Restarting the capture at the stored checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column

from annalist.operators.buckets import DEFAULT_BITS
from annalist.operators.checkpoints import stored_positions
from annalist.plans.capture import capture_batch
from annalist.sources.log_index import LogIndex
from annalist.sources.store import Store


def resume_capture(store: Store, index: LogIndex, bits: int = DEFAULT_BITS, clock: Column | None = None, run: str | None = None) -> str:
    """Store what a landed log holds from the stored checkpoints on, as a run of its own.

    Each slot begins with the first transaction that reaches its checkpoint, which comes
    again and is not stored twice; relations are known as of there. Only the files from
    there on are opened. A slot without a checkpoint is read whole. Returns the run's name;
    calling it again with that name does nothing.
    """
    name = run or f"resume-{uuid.uuid4().hex}"
    index.refresh()
    capture_batch(store, index.resumed_messages(stored_positions(store.checkpoints())), 0, bits, clock, name)
    return name
