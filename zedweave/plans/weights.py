"""The algebra of signed weights.

A relation is a multiset whose rows carry a weight from an abelian group: one bigint column `_w`, or several
columns that are added component by component. Weights of equal rows add up; a row of weight zero isn't there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce as fold
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Product = Callable[[list[Column], list[Column]], list[Column]]


def integer_product(left: list[Column], right: list[Column]) -> list[Column]:
    return [left[0] * right[0]]


@dataclass(frozen=True)
class WeightType:
    """fields: (column, SQL type) of each component; names begin with `_w`. product: used by joins, may be absent."""

    fields: tuple[tuple[str, str], ...] = (("_w", "bigint"),)
    product: Product | None = None

    def __post_init__(self):
        if not self.fields or any(not n.startswith("_w") for n, _ in self.fields):
            raise ValueError("weight columns are named _w...")

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    @property
    def is_integer(self) -> bool:
        return self.fields == INTEGER.fields

    def ddl(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in self.fields)

    def sums(self) -> list[Column]:
        return [F.sum(n).cast(t).alias(n) for n, t in self.fields]

    def nonzero(self) -> Column:
        return fold(or_, [F.col(n) != F.lit(0) for n in self.names])

    def negated(self) -> dict[str, Column]:
        return {n: (-F.col(n)).cast(t) for n, t in self.fields}

    def multiplied(self, left: list[Column], right: list[Column]) -> list[Column]:
        if self.product is None:
            raise TypeError("these weights have no product; give the WeightType one")
        return [c.cast(t).alias(n) for c, (n, t) in zip(self.product(left, right), self.fields)]


INTEGER = WeightType(product=integer_product)


def data_columns(df: DataFrame, weights: WeightType) -> list[str]:
    return [c for c in df.columns if c not in weights.names]


def consolidated(df: DataFrame, weights: WeightType) -> DataFrame:
    """Equal rows merged, zero weights dropped. Partial sums are made before the shuffle."""
    return df.groupBy(*[F.col(f"`{c}`") for c in data_columns(df, weights)]).agg(*weights.sums()).where(weights.nonzero())


def with_ones(df: DataFrame) -> DataFrame:
    return df.withColumn("_w", F.lit(1).cast("bigint"))


def union(frames: list[DataFrame]) -> DataFrame:
    return fold(lambda a, b: a.unionByName(b), frames)
