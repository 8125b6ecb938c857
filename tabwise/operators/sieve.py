"""A bounded filter of keys: rows that cannot meet any key are dropped before a shuffle.

A key sets one bit of a fixed number of them.  The bits are a small table of words, at most BITS / 64
rows however many keys there are; it is broadcast, and rows whose bit is not set have no partner.  Rows
that pass may have none either, so an exact join follows.  With far more keys than bits nearly all rows
pass: the filter then saves nothing, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a filter; its table has at most a 64th of them as rows (about 16 MB of longs).
BITS = 1 << 26


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(77)), F.lit(bits))


def sieve(keys: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Table of (word, set_bits) of the keys in a column; null keys count as one key."""
    at = keys.select(_place(F.col(name), bits).alias("at"))
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(one).alias("set_bits"))


_HIT = "getbit(_sieve_bits, cast(_sieve_at % 64 as int)) = 1"


def _met(rows: DataFrame, key: Column, filter_table: DataFrame, bits: int, how: str) -> DataFrame:
    small = F.broadcast(filter_table.toDF("_sieve_word", "_sieve_bits"))  # at most bits / 64 rows
    return rows.withColumn("_sieve_at", _place(key, bits)).join(small, F.expr("_sieve_at div 64") == F.col("_sieve_word"), how)


def passing(rows: DataFrame, key: Column, filter_table: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose key may be among the filter's, with the columns they had."""
    return _met(rows, key, filter_table, bits, "inner").filter(_HIT).select(*(F.col(f"`{n}`") for n in rows.columns))


def stopped(rows: DataFrame, key: Column, filter_table: DataFrame, bits: int = BITS) -> DataFrame:
    """The other rows: their key is certainly not among the filter's."""
    return _met(rows, key, filter_table, bits, "left").filter(f"not coalesce({_HIT}, false)").select(*(F.col(f"`{n}`") for n in rows.columns))
