"""Graphs of a single stateful operator, on Spark's own streaming state.

State is kept for ever, as any row may be taken back at any time; there is no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Needed by keyed_reduce.
STATE_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def running_weights(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The weight of each key, for output mode "update": a row with `_w` = 0 says that the key is gone."""
    return stream.groupBy(*keys).agg(F.sum("_w").cast("bigint").alias("_w"))


class _KeyedReduce(StatefulProcessor):
    def __init__(self, columns: list[str], keys: list[str], row: T.StructType, out: T.StructType, fn: Callable):
        self.columns, self.keys, self.row, self.made, self.fn = columns, keys, row, out, fn

    def init(self, handle: StatefulProcessorHandle) -> None:
        weight = T.StructType([T.StructField("w", T.LongType())])
        self.rows = handle.getMapState("rows", self.row, weight)
        self.last = handle.getMapState("last", self.made, weight)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.row.names
        for part in rows:
            part = part.set_axis(self.columns, axis=1)  # names with a leading underscore arrive changed
            for r in part.to_dict("records"):
                x = tuple(r[n] for n in names)
                w = int(r["_w"]) + (self.rows.getValue(x)[0] if self.rows.containsKey(x) else 0)
                if w:
                    self.rows.updateValue(x, (w,))
                elif self.rows.containsKey(x):
                    self.rows.removeKey(x)
        group = [(tuple(k), w[0]) for k, w in self.rows.iterator()]
        new = dict(self.fn(key, group)) if group else {}
        old = {tuple(k): w[0] for k, w in self.last.iterator()}
        changed = {x: new.get(x, 0) - old.get(x, 0) for x in {**old, **new} if new.get(x, 0) != old.get(x, 0)}
        for x in changed:
            if x in new:
                self.last.updateValue(x, (new[x],))
            else:
                self.last.removeKey(x)
        if changed:
            out = pd.DataFrame([(*key, *x, w) for x, w in changed.items()], columns=[*self.keys, *self.made.names, "_w"])
            yield out

    def close(self) -> None:
        pass


def keyed_reduce(stream: DataFrame, keys: list[str], fn: Callable, schema: str | T.StructType) -> DataFrame:
    """A reduce over a stream of weighted rows, for output mode "update": the changes of its output.

    fn(key, [(values, weight), ...]) yields (row tuple of `schema`, weight) for each nonempty group.
    """
    made = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    row = T.StructType([f for f in stream.schema.fields if f.name not in (*keys, "_w")])
    out = T.StructType([*[stream.schema[k] for k in keys], *made.fields, T.StructField("_w", T.LongType())])
    return stream.groupBy(*keys).transformWithStateInPandas(_KeyedReduce(stream.columns, keys, row, made, fn), out, "Update", "None")
