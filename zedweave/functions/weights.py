"""Weight types beyond one integer, and sums carried by weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from zedweave.plans.weights import INTEGER, WeightType

#: (count, sum): for means that are maintained by adding weights. A product scales both by an integer weight on the right.
COUNT_SUM = WeightType((("_w_count", "bigint"), ("_w_sum", "bigint")), product=lambda a, b: [a[0] * b[0], a[1] * b[0]])


def sum_by_weight(relation, keys: list[str], value: str, name: str = "total"):
    """SUM(value) by keys through the weight: groups whose sum is 0 aren't there."""
    w = F.col("_w") * F.expr(value)
    moved = relation.flat_map_dr(F.array(F.struct(*[F.col(f"`{k}`") for k in keys], w.cast("bigint").alias("_w"))))
    return moved.op_named("sum").counts(name)


def count_and_sum(relation, keys: list[str], value: str, count: str = "count", total: str = "total"):
    """COUNT and SUM(value) by keys through a weight of two parts; a group is gone when both are 0."""
    items = F.array(F.struct(*[F.col(f"`{k}`") for k in keys], F.col("_w").alias("_w_count"), (F.col("_w") * F.expr(value)).cast("bigint").alias("_w_sum")))
    return relation.flat_map_dr(items, weights=COUNT_SUM).counts(count, total)


__all__ = ["COUNT_SUM", "INTEGER", "WeightType", "count_and_sum", "sum_by_weight"]
