"""Mutable inputs."""

from __future__ import annotations

from collections.abc import Iterable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zedweave.plans.nodes import ContextMismatch, Source
from zedweave.plans.weights import consolidated, union, with_ones

if TYPE_CHECKING:
    from zedweave.plans.context import Builder, Session

#: Logged changes after which those that everybody has read are merged.
LONG = 32


class Input:
    """Writes to a relation. Updates are buffered until commit; several holders may write to one Input."""

    def __init__(self, build: Builder, node: Source):
        self.build, self.node = build, node
        self._rows: dict[tuple, list] = {}
        self._frames: list[DataFrame] = []
        self._grows = True  # whether the frames hold positive weights only

    def _check(self, session: Session) -> None:
        if session.build is not self.build:
            raise ContextMismatch()

    def _row(self, x: Any) -> tuple:
        names = self.node.columns
        if isinstance(x, dict):
            if set(x) != set(names):
                raise ValueError(f"a row has {names}")
            x = tuple(x[n] for n in names)
        elif not isinstance(x, (tuple, list)):
            x = (x,)
        if len(x) != len(names):
            raise ValueError(f"a row has {names}")
        return tuple(x)

    def update(self, session: Session, row: Any, weight: int | tuple = 1) -> None:
        """Adds `weight` (a tuple for weights of several columns) to a row. Updates that cancel within a step vanish."""
        self._check(session)
        weight = weight if isinstance(weight, tuple) else (weight,)
        if len(weight) != len(self.node.weights.names):
            raise ValueError(f"a weight has {self.node.weights.names}")
        key = self._row(row)
        new = [a + b for a, b in zip(self._rows.get(key, [0] * len(weight)), weight)]
        if any(new):
            self._rows[key] = new
        else:
            self._rows.pop(key, None)

    def _unit(self, sign: int) -> int:
        if not self.node.weights.is_integer:
            raise TypeError("insert and delete need integer weights; use update")
        return sign

    def insert(self, session: Session, row: Any) -> None:
        self.update(session, row, self._unit(1))

    def delete(self, session: Session, row: Any) -> None:
        """The row need not be there: its weight may become negative."""
        self.update(session, row, self._unit(-1))

    def insert_all(self, session: Session, rows: Iterable) -> None:
        for r in rows:
            self.insert(session, r)

    def update_df(self, session: Session, df: DataFrame, positive: bool = False) -> None:
        """All rows of df with the weights in its weight columns. In snapshot mode df is planned with what reads it and
        must read alike each time; in delta mode it is saved at commit. positive: it has no other weights."""
        self._check(session)
        names, fields = self.node.weights.names, self.node.weights.fields
        if missing := [c for c in [*self.node.columns, *names] if c not in df.columns]:
            raise ValueError(f"df lacks {missing}")
        columns = []
        for f in self.node.schema.fields:
            c = F.col(f"`{f.name}`").cast(f.dataType)
            columns.append((c if f.nullable else F.coalesce(c, F.raise_error(F.lit(f"null in {f.name}")).cast(f.dataType))).alias(f.name))
        self._grows = self._grows and positive
        self._frames.append(df.select(*columns, *[F.col(n).cast(t).alias(n) for n, t in fields]))

    def insert_df(self, session: Session, df: DataFrame) -> None:
        self._unit(1)
        self.update_df(session, with_ones(df), positive=True)

    def delete_df(self, session: Session, df: DataFrame) -> None:
        self._unit(-1)
        self.update_df(session, df.withColumn("_w", F.lit(-1).cast("bigint")))

    def close_step(self, session: Session) -> None:
        """Called by commit: moves the buffer to the log."""
        parts, self._frames, grows, self._grows = self._frames, [], self._grows and self.node.weights.is_integer, True
        if self._rows:
            grows = grows and all(w[0] > 0 for w in self._rows.values())
            schema = T.StructType([*self.node.schema.fields, *T._parse_datatype_string(self.node.weights.ddl()).fields])
            parts.append(session.spark.createDataFrame([(*k, *w) for k, w in self._rows.items()], schema))
            self._rows = {}
        if not parts:
            return
        df = union(parts)
        if session.mode == "delta":
            df = session.store.save(consolidated(df, self.node.weights))
        log = self.node.log
        log.append((session.step, df, grows))
        if len(log) > LONG:
            old = [x for x in log if x[0] <= session.read_upto()]
            if len(old) > 1:
                merged = session.store.save(consolidated(union([f for _, f, _ in old]), self.node.weights))
                self.node.log = [(old[-1][0], merged, all(p for _, _, p in old)), *[x for x in log if x[0] > old[-1][0]]]
