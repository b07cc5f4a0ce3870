"""A broadcast bit set of keys: rows that can't match are left out before a join shuffles them.

The set's size follows the counted keys, ``SPARSE`` bits for each, up to ``MOST_BITS`` (16 MB). With more keys than
that can tell apart no set is made and all rows pass: the join decides alone, which is right and only slower. Rows
without a key of the set may pass in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import fresh

#: Bits in one row of a set, bits for each key, and bits of a set at most.
PIECE, SPARSE, MOST_BITS = 1 << 15, 16, 1 << 27


class BitSet:
    """The pieces of a set, to be broadcast; ``table`` is None where the keys are too many for one."""

    def __init__(self, table: DataFrame | None, bits: int):
        self.table, self.bits = table, bits


def _column(key: Column | str) -> Column:
    return F.col(key) if isinstance(key, str) else key


def _place(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(bits))


def bits_of(df: DataFrame, *keys: Column | str) -> BitSet:
    """The bit set of a table's keys. The table is read twice, first to be counted: give one that is checkpointed."""
    n = df.count()
    if SPARSE * n > 4 * MOST_BITS:
        return BitSet(None, 0)
    bits = min(MOST_BITS, max(PIECE, 1 << (SPARSE * n).bit_length()))
    placed = df.select(_place([_column(k) for k in keys], bits).alias("p")).distinct()
    pieces = placed.groupBy(F.floor(F.col("p") / PIECE).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(PIECE))).alias("bits"))
    return BitSet(pieces, bits)


def with_maybe(df: DataFrame, held: BitSet, name: str, *keys: Column | str) -> DataFrame:
    """``df`` and a boolean column ``name``: false where the key is surely not in the set."""
    if held.table is None:
        return df.withColumn(name, F.lit(True))
    p, piece, bits = fresh([*df.columns, name], "p", "piece", "bits")
    joined = df.withColumn(p, _place([_column(k) for k in keys], held.bits)).join(F.broadcast(held.table.toDF(piece, bits)), F.floor(F.col(p) / PIECE).cast("int") == F.col(piece), "left")
    at = F.pmod(p, F.lit(PIECE)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, 1)), 16, 10).cast("long")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))).drop(p, piece, bits)


def maybe_in(df: DataFrame, held: BitSet, *keys: Column | str) -> DataFrame:
    """The rows whose key may be in the set."""
    if held.table is None:
        return df
    (name,) = fresh(df.columns, "maybe")
    return with_maybe(df, held, name, *keys).where(F.col(name)).drop(name)
