"""Which batches may hold a commit position: ranges per slot, and a Bloom filter per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import schemas

# A bitmap of Spark's bitmap functions holds this many bits.
BLOCK_BITS = 15
BITS_PER_POSITION, HASHES = 12, 4

POSITIONS = schemas.table(
    attempt=schemas.TEXT,
    slot=schemas.TEXT,
    low=schemas.LSN_NUMBER,
    high=schemas.LSN_NUMBER,
    block=schemas.LONG,
    blocks=schemas.LONG,
    bitmap=schemas.BYTES,
)


def _with_bits(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each (slot, commit_lsn_num) with the bits it sets: block and place in the block."""
    hashes = F.array(*[F.xxhash64("slot", "commit_lsn_num", F.lit(i)) for i in range(HASHES)])
    bit = F.pmod(F.col("hash"), F.shiftleft(blocks, BLOCK_BITS))
    return rows.withColumn("hash", F.explode(hashes)).select(
        "*", F.shiftright(bit, BLOCK_BITS).alias("block"), bit.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("bit")
    )


def position_filter(stored: DataFrame, attempt: str) -> DataFrame:
    """What is kept of a batch's positions (slot, commit_lsn_num): the range of each slot, and
    the bitmaps of one filter for all. Bits are collected map-side."""
    n = stored.count()
    blocks = F.lit(1 << max(0, (BITS_PER_POSITION * n - 1) >> BLOCK_BITS).bit_length()).cast("bigint")
    ranges = stored.groupBy("slot").agg(F.min("commit_lsn_num").alias("low"), F.max("commit_lsn_num").alias("high"))
    bitmaps = _with_bits(stored.select("slot", "commit_lsn_num"), blocks).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    both = ranges.unionByName(bitmaps.withColumn("blocks", blocks), allowMissingColumns=True)
    fields = POSITIONS.fields[1:]
    return both.select(F.lit(attempt).alias("attempt"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def attempts_holding(suspects: DataFrame, filters: DataFrame) -> DataFrame:
    """The attempts that may hold any of the positions (slot, commit_lsn_num); none that does
    is left out. ``filters``: the positions tables of all attempts."""
    ranges = filters.where(F.col("slot").isNotNull()).select("attempt", "slot", "low", "high")
    sizes = filters.where(F.col("slot").isNull()).groupBy("attempt").agg(F.max("blocks").alias("blocks"))
    near = (
        suspects.select("slot", "commit_lsn_num")
        .join(ranges, "slot")
        .where(F.col("commit_lsn_num").between(F.col("low"), F.col("high")))
        .join(sizes, "attempt")
        .select("attempt", "slot", "commit_lsn_num", "blocks")
    )
    bits = _with_bits(near, F.col("blocks"))
    maps = filters.where(F.col("slot").isNull()).select("attempt", "block", "bitmap")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    found = bits.join(maps, ["attempt", "block"]).where(is_set)
    whole = found.groupBy("attempt", "slot", "commit_lsn_num").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES)
    return whole.select("attempt").distinct()
