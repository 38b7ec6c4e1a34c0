"""A Bloom filter of rows: finds most rows of a large table that aren't in a small one, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

#: Rows of one filter, filters at most, and bits a row.
ROWS, FILTERS, BITS = 4_000_000, 8, 10


def fits(rows: int) -> bool:
    return rows <= ROWS * FILTERS


def sieve(df: DataFrame, rows: int, columns: list[str]) -> Column:
    """A condition on columns of these names and types: true for every row that df has, and for about 1 % of all others."""
    call = InternalFunction._invoke_internal_function_over_columns
    long = lambda n: F.lit(n).cast("bigint")
    h, n = F.xxhash64(*[F.col(f"`{c}`") for c in columns]), -(-rows // ROWS)
    each = max(1000, -(-rows // n))
    slot = F.pmod(h, F.lit(n))
    made = df.select(h.alias("h"), slot.alias("k")).groupBy("k").agg(call("bloom_filter_agg", F.col("h"), long(each), long(BITS * each)).alias("bits")).collect()
    out = F.lit(False)
    for r in made:
        out = out | (slot == r["k"]) & _might_contain(df, F.lit(bytes(r["bits"])), h)
    return out


def _might_contain(df: DataFrame, bits: Column, h: Column) -> Column:
    """Spark's own test of its joins' filters, which has no name to call it by."""
    jvm = df.sparkSession._jvm.org.apache.spark.sql
    made, of = jvm.classic.ExpressionUtils, jvm.catalyst.expressions.BloomFilterMightContain
    return type(h)(made.column(of(made.expression(bits._jc), made.expression(h._jc))))
