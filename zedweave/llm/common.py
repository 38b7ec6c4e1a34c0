"""What several operators of this package share: durable intermediates, row numbering, word counts."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zedweave.plans.store import Store as Scratch
from zedweave.plans.store import temporary

__all__ = ["ROWS_PER_BUCKET", "WORD", "Scratch", "boxed", "field", "freed", "marked", "number_rows", "temporary", "unboxed", "words_in"]

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows numbered by one task at a time, see number_rows.
ROWS_PER_BUCKET = 250_000

#: Bits of the bitmaps of marked: 2**20 rows of 64.
BITMAP = 1 << 26


_T = TypeVar("_T")


def freed(results: Iterator[_T]) -> Iterator[_T]:
    """What a task yields; at its end the memory that Arrow and the allocator hold on to goes back, for the Python worker stays and
    waits for other tasks beside a JVM that may need it."""
    yield from results
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)


def boxed(df: DataFrame) -> DataFrame:
    """All columns as one struct column `row`, so that none clashes with a name used beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def field(name: str) -> Column:
    return F.col(f"row.`{name}`")


def unboxed(df: DataFrame, columns: list[str], replaced: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `row`, some replaced."""
    return df.select(*[(replaced or {}).get(c, field(c)).alias(c) for c in columns])


def marked(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with `_hit`: false only where the value of key, a 64-bit hash, is surely not among keys (a column `_m` of such).

    A bitmap of BITMAP bits is broadcast, in BITMAP / 64 rows at most whatever the keys' number, so that rows without a match
    needn't be shuffled to find out. With very many keys it says yes to most.
    """
    bit = lambda c: F.pmod(F.col(c), F.lit(BITMAP).cast("long"))
    words = keys.select(bit("_m").alias("b")).groupBy(F.shiftright("b", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("_bits"))
    df = df.withColumn("_b", bit(key)).join(F.broadcast(words), F.shiftright("_b", 6) == F.col("_word"), "left")
    return df.withColumn("_hit", F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_b % 64 as int)) & 1 = 1"), F.lit(False))).drop("_b", "_word", "_bits")


def words_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def number_rows(df: DataFrame, by: list[str], order: list[str], salt: str, total: int, out: str = "number") -> DataFrame:
    """Adds a gapless number from 0 within each value of `by`, without bringing such a group to one task.

    Rows are dealt over hash buckets, ranked within (by, bucket) and offset by the prefix sums of the
    buckets' counts. df must be a saved table, so that a task that runs again sees the same rows; salt, a
    column stored in it, tells apart rows that agree in `order`, so that many of these fill many buckets.
    """
    n = max(64, -(-total // ROWS_PER_BUCKET))
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order, salt), F.lit(n)))
    counts = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order, salt)) - 1)
    on = F.col("_b") == F.col("_bb")
    for c in by:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    return ranked.join(base, on).withColumn(out, (F.col("_base") + F.col("_r")).cast("long")).drop("_b", "_bb", "_base", "_r", *[f"_by_{c}" for c in by])
