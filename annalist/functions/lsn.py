"""Log positions (LSN): ``HI/LO`` hex text outside, an unsigned 64-bit number inside.

The number is DECIMAL(20,0) because BIGINT overflows from ``80000000/0`` on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LSN_PATTERN = r"\A[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\z"
LSN_NUM_TYPE = "decimal(20,0)"


def is_lsn(text: Column) -> Column:
    """True when the text is a well-formed position; NULL stays NULL."""
    return text.rlike(LSN_PATTERN)


def lsn_to_num(text: Column) -> Column:
    """Numeric value of a position text; NULL when the text is malformed."""
    # ``conv`` reads up to 16 hex digits as one unsigned 64-bit number.
    digits = F.concat(F.substring_index(text, "/", 1), F.lpad(F.substring_index(text, "/", -1), 8, "0"))
    return F.when(is_lsn(text), F.conv(digits, 16, 10).cast(LSN_NUM_TYPE))


def lsn_to_num_strict(text: Column) -> Column:
    """Like :func:`lsn_to_num`, but malformed text fails the job; NULL stays NULL."""
    message = F.concat(F.lit("malformed LSN: "), text)
    return F.when(text.isNotNull() & ~is_lsn(text), F.raise_error(message).cast(LSN_NUM_TYPE)).otherwise(
        lsn_to_num(text)
    )


def num_to_lsn(number: Column) -> Column:
    """Upper-case ``HI/LO`` text without padding, for any value in [0, 2^64).

    A larger number is no position; its text has a longer ``HI``, which :func:`is_lsn` refuses.
    """
    # What fits is taken apart by the bit functions, the rest by decimal arithmetic.
    bits = number.try_cast("bigint")
    wide, step = number.cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(10,0)")
    low = (wide % step).cast("bigint")
    high = ((wide - low) / step).cast("bigint")
    return F.when(
        bits.isNotNull(),
        F.concat(F.hex(F.shiftrightunsigned(bits, 32)), F.lit("/"), F.hex(bits.bitwiseAND(F.lit(0xFFFFFFFF)))),
    ).otherwise(F.concat(F.hex(high), F.lit("/"), F.hex(low)))
