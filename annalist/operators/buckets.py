"""Ordered state over long logs, split into position buckets.

What a row sees may depend on everything before it in its slot, and one slot may
hold a large share of all rows. A window over the whole slot would put that slot
into one task, so positions are cut into buckets of ``2^bits`` and

1. each (key, bucket) is reduced to its first and last value (partial
   aggregation, one row per bucket),
2. windows over those few rows find the value carried into each bucket: one within runs
   of ``2^RUN_BITS`` buckets, one over the runs, so no task sees all buckets of a key,
3. that value enters the bucket as a *seed row* just outside its positions, so a
   window over (key, bucket) sees it like any other row.

Positions are unique per slot, so no bucket holds more than ``2^bits`` rows. The
full log is shuffled once, by (key, bucket); seeds need no join with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
SEED = "_seed"
RUN = "_run"
DEFAULT_BITS = 17
RUN_BITS = 12

BEFORE_ROW = (Window.unboundedPreceding, -1)


def bucket_of(position: Column, bits: int) -> Column:
    return F.shiftright(position, bits)


def below(bucket: Column, bits: int) -> Column:
    """The position just before a bucket's first one."""
    return F.shiftleft(bucket, bits) - 1


def above(bucket: Column, bits: int) -> Column:
    """The position just after a bucket's last one."""
    return F.shiftleft(bucket + 1, bits)


def _latest(name: str) -> Column:
    return F.last(name, ignorenulls=True)


def _carried(edges: DataFrame, keys: Sequence[str], name: str, order: Column, back: Column, taken=_latest) -> DataFrame:
    """keys, run, and as ``<name>_run`` the value of ``name`` carried into the run."""
    runs = edges.groupBy(*keys, RUN).agg(back.alias(name))
    over_runs = Window.partitionBy(*keys).orderBy(order).rowsBetween(*BEFORE_ROW)
    return runs.select(*keys, RUN, taken(name).over(over_runs).alias(f"{name}_run"))


def carries(
    rows: DataFrame, keys: Sequence[str], position: str, value: Column, bits: int, closing: bool = False, run_bits: int | None = None, peak: bool = False
) -> DataFrame:
    """Per (keys, bucket): the last value in earlier buckets as ``from_before`` and, if
    ``closing``, the first in later ones as ``from_after``.

    Values grow with the position: numbers that do, which aggregate fastest, or structs
    led by one. NULL values do not count. One row per bucket that has any row. With ``peak``
    values may fall, and ``from_before`` is the largest of all earlier buckets.
    """
    taken = F.max if peak else _latest
    run_bits = RUN_BITS if run_bits is None else run_bits
    ends = [F.max(value).alias("newest")] + ([F.min(value).alias("oldest")] if closing else [])
    edges = (
        rows.withColumn(BUCKET, bucket_of(F.col(position), bits))
        .groupBy(*keys, BUCKET)
        .agg(*ends)
        .withColumn(RUN, bucket_of(F.col(BUCKET), run_bits))
    )
    out = edges.join(_carried(edges, keys, "newest", F.asc(RUN), F.max("newest"), taken), [*keys, RUN])
    earlier = Window.partitionBy(*keys, RUN).orderBy(F.asc(BUCKET)).rowsBetween(*BEFORE_ROW)
    within = taken("newest").over(earlier)
    before = F.greatest(within, "newest_run") if peak else F.coalesce(within, F.col("newest_run"))
    found = [before.alias("from_before")]
    if closing:
        out = out.join(_carried(edges, keys, "oldest", F.desc(RUN), F.min("oldest")), [*keys, RUN])
        later = Window.partitionBy(*keys, RUN).orderBy(F.desc(BUCKET)).rowsBetween(*BEFORE_ROW)
        found.append(F.coalesce(F.last("oldest", ignorenulls=True).over(later), F.col("oldest_run")).alias("from_after"))
    return out.select(*keys, BUCKET, *found)


def seeds(
    carried: DataFrame, keys: Sequence[str], position: str, name: str, bits: int, closing: bool = False
) -> DataFrame:
    """Seed rows holding the carried values, below and (if ``closing``) above each bucket."""
    ends = [F.struct(below(F.col(BUCKET), bits).alias(position), F.col("from_before").alias(name))]
    if closing:
        ends.append(F.struct(above(F.col(BUCKET), bits).alias(position), F.col("from_after").alias(name)))
    present = F.filter(F.array(*ends), lambda end: end[name].isNotNull())
    return carried.select(*keys, BUCKET, F.explode(present).alias("end")).select(
        *keys, BUCKET, "end.*", F.lit(True).alias(SEED)
    )


def last_before(name: str, position: str, *groups: str) -> Column:
    """Last non-null ``name`` strictly before the row, within the groups."""
    window = Window.partitionBy(*groups).orderBy(F.asc(position)).rowsBetween(*BEFORE_ROW)
    return F.last(name, ignorenulls=True).over(window)


def first_after(name: str, position: str, *groups: str) -> Column:
    """First non-null ``name`` strictly after the row; a growing frame on descending order."""
    window = Window.partitionBy(*groups).orderBy(F.desc(position)).rowsBetween(*BEFORE_ROW)
    return F.last(name, ignorenulls=True).over(window)
