"""Python functions on rows and groups, for what Column expressions can't say. Arrow batches, not row-at-a-time UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from zedweave.plans.weights import WeightType


def with_weights(schema: T.StructType, weights: WeightType) -> T.StructType:
    return T.StructType([*schema.fields, *T._parse_datatype_string(weights.ddl()).fields])


def per_row(fn: Callable, schema: T.StructType, weights_in: WeightType, weights: WeightType, sees_weight: bool) -> Callable[[DataFrame], DataFrame]:
    """fn(row dict) yields row tuples that keep the weight; with sees_weight fn(row dict, weight) yields (row tuple, weight)."""
    out = with_weights(schema, weights)
    names_in, names, single = weights_in.names, out.names, len(weights.names) == 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for b in it:
            made = []
            for row in b.to_pylist():
                w = tuple(row.pop(n) for n in names_in)
                if sees_weight:
                    for r, v in fn(row, w[0] if len(w) == 1 else w):
                        made.append(dict(zip(names, (*_tuple(r), *((v,) if single else v)))))
                else:
                    made += [dict(zip(names, (*_tuple(r), *w))) for r in fn(row)]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return lambda df: df.mapInArrow(batches, out)


def _tuple(r) -> tuple:
    return tuple(r) if isinstance(r, (tuple, list)) else (r,)


def framed(made, columns: list[str], weights: list[str]) -> pd.DataFrame:
    """The frame that a function has returned, or made of its map from rows to weights."""
    if isinstance(made, pd.DataFrame):
        return made.copy()
    rows = [(*_tuple(r), *_tuple(w)) for r, w in (made.items() if hasattr(made, "items") else made)]
    return pd.DataFrame(rows, columns=[*columns, *weights]) if rows else pd.DataFrame({c: [] for c in (*columns, *weights)})


def per_group(fn: Callable[[tuple, pd.DataFrame], Any], keys: list[str], schema: T.StructType, weights: WeightType) -> Callable[[DataFrame], DataFrame]:
    """fn(key, frame of the group's rows with weights) returns a frame of the columns besides the keys, and weights (else 1), or
    a map from rows to weights: a dict, SingletonMap, OptionMap or VecMap.

    A group comes to one task as a whole: that is what an opaque function of it needs.
    """
    out, columns, weight_names = with_weights(schema, weights), [n for n in schema.names if n not in keys], weights.names

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = framed(fn(key, rows), columns, weight_names)
        for k, v in zip(keys, key):
            made[k] = v if not isinstance(v, (list, dict)) else [v] * len(made)
        for n in weight_names:
            if n not in made:
                made[n] = 1
        return made[names]

    names = out.names

    def apply(df: DataFrame) -> DataFrame:
        return df.groupBy(*[F.col(f"`{k}`") for k in keys]).applyInPandas(run, out)

    return apply
