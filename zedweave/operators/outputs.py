"""Outputs: what a session reads."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zedweave.plans.nodes import ContextMismatch, Node, checked_keys
from zedweave.plans.weights import consolidated

if TYPE_CHECKING:
    from zedweave.plans.context import Builder, Session

KINDS = ("rows", "ordered", "nested", "nested_ordered", "mapping")

#: Repeats of a row that are made at a time.
BLOCK = 1 << 16


class Output:
    def __init__(self, build: Builder, node: Node):
        if node.scope is not build:  # also relations of recursive scopes, which have to leave first
            raise ContextMismatch()
        if build.frozen:
            raise RuntimeError("the plan is frozen: begin() has been called")
        self.build, self.node = build, node
        build.outputs.append(self)

    def _frame(self, session: Session) -> DataFrame:
        if session.build is not self.build:
            raise ContextMismatch()
        return session.frame(self.node)


class Arrangement(Output):
    """The maintained contents of a relation."""

    def __init__(self, build: Builder, node: Node, kind: str = "rows", keys: list[str] | list[list[str]] = ()):
        """keys: columns, or for nested kinds a list of columns for each level of maps from the outermost on."""
        super().__init__(build, node)
        if kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")
        if kind not in ("rows", "ordered") and not keys:
            raise ValueError(f"{kind} needs keys")
        levels = [list(k) for k in keys] if any(not isinstance(k, str) for k in keys) else [list(keys)]
        if kind == "mapping" and len(levels) > 1:
            raise ValueError("a mapping has one level of keys")
        self.kind, self.levels, self.keys = kind, levels, checked_keys(node, [c for k in levels for c in k])
        if len(set(self.keys)) < len(self.keys):
            raise ValueError(f"keys repeat: {self.keys}")

    def read(self, session: Session) -> DataFrame:
        """As of the last commit, consolidated.

        rows: the columns and the weight. ordered: the same, sorted by the columns. nested: a row for each key
        with a map `contents`, from the other columns to their weight, or with more levels of keys from the next level's
        keys to such a map, and so on. nested_ordered: the same with arrays of (key, contents) in place of maps, sorted by key,
        and rows sorted too. mapping: as rows, failing unless keys are unique with weight 1, without the weight.
        """
        df = self._frame(session)
        if self.kind == "ordered":
            return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in self.node.columns])
        if self.kind.startswith("nested"):
            return nested(df, self.node, self.levels, self.kind == "nested_ordered")
        return mapped(df, self.keys) if self.kind == "mapping" else df

    def changes(self, session: Session) -> DataFrame:
        """In delta mode: the rows and weights that the last step read has added."""
        self._frame(session)
        return session.changes(self.node)

    def rows(self, session: Session) -> DataFrame:
        """The rows without weights, each as often as its weight says; a negative weight fails."""
        if session.build is not self.build:
            raise ContextMismatch()
        if session.mode == "snapshot" and self.node.positive and self.node.weights.is_integer:
            df = session.snapshot().frame(self.node)  # repeats needn't be merged to be counted
        else:
            df = self._frame(session)
        columns = [F.col(f"`{c}`") for c in self.node.columns]
        if self.node.unit:
            return df.select(*columns)
        n = F.when(F.col("_w") < 0, F.raise_error(F.lit("a row has a negative weight")).cast("bigint")).otherwise(F.col("_w"))
        # by blocks, so that no row of a large weight becomes one long array
        df = df.where("_w <> 0").select(*columns, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / BLOCK))).alias("_b"))
        return df.select(*columns, F.explode(F.array_repeat(F.lit(0), F.least(F.lit(BLOCK), F.col("_n") - F.col("_b") * BLOCK).cast("int"))).alias("_i")).drop("_i")

    def to_dict(self, session: Session) -> dict:
        """For small results: from rows (tuples) to weights."""
        names, w = self.node.columns, self.node.weights.names
        return {tuple(r[n] for n in names): r[w[0]] if len(w) == 1 else tuple(r[n] for n in w) for r in self._frame(session).collect()}


def nested(df: DataFrame, node: Node, levels: list[list[str]], ordered: bool = False) -> DataFrame:
    """Rows by the first level's keys. All levels are grouped in one exchange, by the first."""
    keys = [c for k in levels for c in k]
    rest = [c for c in node.columns if c not in keys]
    contents = F.col("_w") if len(node.weights.names) == 1 else F.struct(*node.weights.names)
    if len(levels) > 1:
        df = df.repartition(*[F.col(f"`{k}`") for k in levels[0]])
    for depth in range(len(levels), 0, -1):
        below = rest if depth == len(levels) else levels[depth]
        key = F.struct(*[F.col(f"`{c}`") for c in below]) if below else F.lit(True)
        entries = F.collect_list(F.struct(key.alias("key"), contents.alias("contents")))
        upto = [F.col(f"`{c}`") for k in levels[:depth] for c in k]
        df = df.groupBy(*upto).agg((F.array_sort(entries) if ordered else F.map_from_entries(entries)).alias("contents"))
        contents = F.col("contents")
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in levels[0]]) if ordered else df


def mapped(df: DataFrame, keys: list[str]) -> DataFrame:
    """df without weights; fails unless each key has one row of weight 1."""
    values = [c for c in df.columns if c not in keys and c != "_w"]
    one = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("_n"), F.max("_w").alias("_x"), F.first(F.struct(F.lit(1).alias("_one"), *[F.col(f"`{v}`") for v in values])).alias("_v"))
    ok = F.when((F.col("_n") == 1) & (F.col("_x") == 1), F.lit(True)).otherwise(F.raise_error(F.lit("a key hasn't exactly one value of weight 1")).cast("boolean"))
    return one.where(ok).select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"_v.`{v}`").alias(v) for v in values])


class Mapping(Output):
    """A relation checked to be one-to-one, read as a map."""

    def __init__(self, build: Builder, node: Node, keys: list[str]):
        super().__init__(build, node)
        self.keys = keys

    def read(self, session: Session) -> DataFrame:
        return self._frame(session).drop("_w")

    def to_dict(self, session: Session) -> dict:
        values = [c for c in self.node.columns if c not in self.keys]
        return {tuple(r[k] for k in self.keys): tuple(r[v] for v in values) for r in self.read(session).collect()}


class ReduceOutput(Output):
    """A reduce's results by key; keys whose function returned nothing are listed with an empty map."""

    def read(self, session: Session) -> DataFrame:
        out = nested(self._frame(session), self.node, [self.node.keys])
        dep = self.node.deps[0]
        if self.node.insertions:  # least, greatest and distinct rows: every group has some
            return out
        held = session.maintained(dep)
        keys = (held if dep.positive else consolidated(held, dep.weights)).select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in self.node.keys]).distinct()
        on = F.lit(True)
        for k in self.node.keys:
            on = on & F.col(f"_r_{k}").eqNullSafe(F.col(f"`{k}`"))
        kind = out.schema["contents"].dataType
        none = F.map_from_arrays(F.array().cast(f"array<{kind.keyType.simpleString()}>"), F.array().cast(f"array<{kind.valueType.simpleString()}>"))
        return keys.join(out, on, "left").select(*[F.col(f"_r_{k}").alias(k) for k in self.node.keys], F.coalesce("contents", none).alias("contents"))
