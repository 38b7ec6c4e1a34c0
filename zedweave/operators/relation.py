"""Relations: the operators a plan is composed of.

Column expressions come first (SQL text or Column); Python callables are accepted where noted and run in
Arrow batches. Key arguments are column names, or pairs (left name, right name) for binary operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from zedweave.operators.opaque import per_group, per_row
from zedweave.operators.outputs import Arrangement, Mapping, ReduceOutput, mapped
from zedweave.plans.context import Builder, Finalizer, SubContext, struct_type
from zedweave.plans.nodes import AntiJoin, Concat, ContextMismatch, Enter, Join, Leave, Linear, Node, Reduce, Triangles, checked_keys
from zedweave.plans.weights import INTEGER, WeightType, consolidated, data_columns, with_ones


def _names(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _column(c: str | Column) -> Column:
    return F.expr(c) if isinstance(c, str) else c


class Relation:
    """An immutable handle on a node; using one several times shares its definition."""

    def __init__(self, node: Node):
        self.node = node

    @property
    def columns(self) -> list[str]:
        return self.node.columns

    @property
    def schema(self) -> T.StructType:
        return self.node.schema

    def _linear(self, op: str, fn: Callable[[DataFrame], DataFrame], unit: bool = False, keeps_sign: bool = True, weights: WeightType | None = None, schema: T.StructType | None = None) -> Relation:
        return Relation(Linear(self.node, op, fn, weights, unit and self.node.unit, keeps_sign, schema))

    # projection, filter, weights

    def map(self, *columns: str | Column | Callable, schema: str | T.StructType | None = None, injective: bool = False, **named: str | Column) -> Relation:
        """New rows from each row: names or Columns, and name=expression. Weights stay; rows that become equal merge.

        injective: no two rows become equal (so rows known to be distinct stay so).
        map(fn, schema=...): fn takes a dict and returns a tuple.
        """
        if len(columns) == 1 and callable(columns[0]) and not isinstance(columns[0], Column):
            return self._python_map(columns[0], struct_type(schema), "map", many=False)
        made = [F.col(f"`{c}`") if isinstance(c, str) and c in self.columns else _column(c) for c in columns]
        made += [_column(c).alias(n) for n, c in named.items()]
        return self._linear("map", lambda df: df.select(*made, *self.node.weights.names), unit=injective)

    def hmap(self, *columns, **named) -> Relation:
        """map, hidden in dump_dot."""
        return self.map(*columns, **named).hidden()

    def _python_map(self, fn: Callable, schema: T.StructType, op: str, many: bool) -> Relation:
        w = self.node.weights
        rows = per_row(fn if many else lambda row: [fn(row)], schema, w, w, sees_weight=False)
        return self._linear(op, rows, schema=schema)

    def with_columns(self, **named: str | Column) -> Relation:
        """All columns, and new ones; distinct rows stay distinct."""
        if clash := [n for n in named if n in self.columns]:
            raise ValueError(f"{clash} exist; use map")
        return self.map(*self.columns, injective=True, **named)

    def rename(self, **new_by_old: str) -> Relation:
        columns = [F.col(f"`{c}`").alias(new_by_old.get(c, c)) for c in self.columns]
        return self.map(*columns, injective=True)

    def flat_map(self, items: str | Column | Callable, *keep: str, schema: str | T.StructType | None = None, name: str = "item") -> Relation:
        """A row for each element of an array expression: the columns `keep` and the element, as `name` or, of structs, as
        their fields. flat_map(fn, schema=...): fn takes a dict and yields tuples."""
        if callable(items) and not isinstance(items, Column):
            return self._python_map(items, struct_type(schema), "flat_map", many=True)
        weights = self.node.weights.names

        def fn(df: DataFrame) -> DataFrame:
            out = df.select(*[F.col(f"`{k}`") for k in keep], F.explode(_column(items)).alias("_item"), *weights)
            kind = out.schema["_item"].dataType
            fields = [F.col(f"_item.`{f}`").alias(f) for f in kind.names] if isinstance(kind, T.StructType) else [F.col("_item").alias(name)]
            return out.select(*[F.col(f"`{k}`") for k in keep], *fields, *weights)

        return self._linear("flat_map", fn)

    def flat_map_dr(self, items: str | Column | Callable, weights: WeightType = INTEGER, schema: str | T.StructType | None = None) -> Relation:
        """The most general row-by-row operator: rows and weights are both rewritten, the weight's type too.

        items: an array of structs of the new columns and weight columns, from all columns and weights. It must be
        linear in the weight, for equal rows may have been merged. flat_map_dr(fn, schema=...): fn(dict, weight) yields
        (tuple, weight).
        """
        if callable(items) and not isinstance(items, Column):
            schema = struct_type(schema)
            return self._linear("flat_map_dr", per_row(items, schema, self.node.weights, weights, sees_weight=True), keeps_sign=False, weights=weights, schema=schema)

        def fn(df: DataFrame) -> DataFrame:
            out = df.select(F.explode(_column(items)).alias("_item"))
            fields = [n for n in out.schema["_item"].dataType.names if n not in weights.names]
            return out.select(*[F.col(f"_item.`{f}`").alias(f) for f in fields], *[F.col(f"_item.{n}").cast(t).alias(n) for n, t in weights.fields])

        return self._linear("flat_map_dr", fn, keeps_sign=False, weights=weights)

    def filter(self, condition: str | Column | Callable) -> Relation:
        """Rows for which the condition is true. A Python callable takes a dict."""
        if callable(condition) and not isinstance(condition, Column):
            names = self.columns
            rows = per_row(lambda row: [tuple(row[n] for n in names)] if condition(row) else [], self.schema, self.node.weights, self.node.weights, sees_weight=False)
            return self._linear("filter", rows, unit=True, schema=self.schema)
        return self._linear("filter", lambda df: df.where(_column(condition)), unit=True, schema=self.schema)

    def map_r(self, *weight_columns: str | Column, weights: WeightType = INTEGER) -> Relation:
        """New weights from the weights alone. The expression must be additive, f(a + b) = f(a) + f(b), for it is applied
        to changes and to merged rows alike."""
        columns = [_column(c).cast(t).alias(n) for c, (n, t) in zip(weight_columns, weights.fields, strict=True)]
        return self._linear("map_r", lambda df: df.select(*[F.col(f"`{c}`") for c in self.columns], *columns), keeps_sign=False, weights=weights, schema=self.schema)

    def negate(self) -> Relation:
        return self._linear("negate", lambda df: df.withColumns(self.node.weights.negated()), keeps_sign=False, schema=self.schema)

    # union

    def concat(self, other: Relation) -> Relation:
        """Weights add. Columns are matched by name."""
        return Relation(Concat(self.node, other.node))

    def consolidate(self) -> Relation:
        """Merges equal rows now; changes nothing logically."""
        if self.node.unit:
            return self
        out = self._linear("consolidate", lambda df: consolidated(df, self.node.weights), schema=self.schema)
        return out

    # joins

    def join(self, other: Relation, on, weights: WeightType | None = None) -> Relation:
        """Inner equi-join: the keys, the rest of the left, the rest of the right; weights multiply (by the product of
        `weights`, else of the left's type). Null keys match each other. on=[] joins everything with everything."""
        return Relation(Join(self.node, other.node, on, weights))

    def antijoin(self, other: Relation, on) -> Relation:
        """Left rows whose key has weight zero on the right; their weights stay."""
        return Relation(AntiJoin(self.node, other.node, on))

    def semijoin(self, other: Relation, on) -> Relation:
        """Left rows times the weight of their key on the right: a weight of 3 triples them."""
        pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in ([on] if isinstance(on, str) else on)]
        rights = [p[1] for p in pairs]
        keys = other if set(other.columns) == set(rights) else other.map(*rights)
        out = self.join(keys, pairs)
        return out if out.columns == self.columns else out.map(*self.columns, injective=True)

    def semijoin_on(self, other: Relation, *keys: str | Column) -> Relation:
        """semijoin by expressions of the left row, one for each column of other."""
        return self._on(other, keys, Relation.semijoin)

    def antijoin_on(self, other: Relation, *keys: str | Column) -> Relation:
        return self._on(other, keys, Relation.antijoin)

    def _on(self, other: Relation, keys, how) -> Relation:
        if len(keys) != len(other.columns):
            raise ValueError(f"a key for each of {other.columns} is needed")
        made = {f"key_{i}_": k for i, k in enumerate(keys)}
        out = how(self.with_columns(**made), other, list(zip(made, other.columns)))
        return out.map(*self.columns, injective=True)

    def semijoin_on_fst(self, other: Relation) -> Relation:
        """semijoin by the first column."""
        return self.semijoin_on(other, F.col(f"`{self.columns[0]}`"))

    def semijoin_on_snd(self, other: Relation) -> Relation:
        """semijoin by the second column."""
        return self.semijoin_on(other, F.col(f"`{self.columns[1]}`"))

    def antijoin_on_fst(self, other: Relation) -> Relation:
        return self.antijoin_on(other, F.col(f"`{self.columns[0]}`"))

    def antijoin_on_snd(self, other: Relation) -> Relation:
        return self.antijoin_on(other, F.col(f"`{self.columns[1]}`"))

    def triangles(self, xz: Relation, yz: Relation) -> Relation:
        """Of (x, y), (x, z) and (y, z), columns by place: all (x, y, z)."""
        return Relation(Triangles(self.node, xz.node, yz.node))

    def left_join(self, other: Relation, on) -> Relation:
        """join, and rows without a partner with nulls in the right's columns."""
        pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in ([on] if isinstance(on, str) else on)]
        inner = self.join(other, pairs)
        rest = self.antijoin(other, pairs)
        pad = {c: F.lit(None).cast(other.schema[c].dataType) for c in other.columns if c not in {p[1] for p in pairs}}
        return inner.concat(rest.with_columns(**pad))

    # set operations

    def intersection(self, other: Relation) -> Relation:
        """Equal rows; weights multiply."""
        return self.semijoin(other, self._all(other))

    def set_minus(self, other: Relation) -> Relation:
        """Rows whose weight in other is zero; weights stay."""
        return self.antijoin(other, self._all(other))

    def _all(self, other: Relation) -> list[str]:
        if set(self.columns) != set(other.columns):
            raise ValueError(f"the same columns are needed: {self.columns} and {other.columns}")
        return self.columns

    def distinct(self) -> Relation:
        """Rows of nonzero (also negative) weight, with weight 1."""
        if self.node.unit:
            return self
        columns, merged = self.columns, not self.node.positive

        def fn(df: DataFrame) -> DataFrame:
            df = df.select(*[F.col(f"`{c}`") for c in columns])
            return with_ones(df if merged else df.distinct())

        return Relation(Reduce(self.node, "distinct", columns, fn, merged=merged, schema=self.schema, insertions="distinct"))

    # aggregation

    def reduce(self, keys: str | list[str], fn: Callable | None = None, schema: str | T.StructType | None = None, weights: WeightType = INTEGER, merged: bool = True, **aggregates: str | Column) -> Relation:
        """A function of each nonempty group's rows and weights.

        reduce(keys, name=aggregate, ...): SQL aggregates over the group's merged rows, with `_w` (e.g. "sum(v * _w)",
        "count(1)"); one row of weight 1 for each group. merged=False lets them run on rows that aren't merged yet, right
        for sums of products with `_w`, minima and maxima.
        reduce(keys, fn, schema="..."): fn(key, pandas frame of values and weights) returns a frame of the columns of
        schema (without the keys), with weights or not; or a container of zedweave.functions.maps or a dict, from rows (tuples, or values
        of a single column) to weights.
        """
        keys = checked_keys(self.node, _names(keys))
        if fn is not None:
            own = struct_type(schema)
            whole = T.StructType([*[self.schema[k] for k in keys], *own.fields])
            return Relation(Reduce(self.node, "reduce", keys, per_group(fn, keys, whole, weights), unit=False, weights=weights, schema=whole))
        made = [_column(c).alias(n) for n, c in aggregates.items()]

        def grouped(df: DataFrame) -> DataFrame:
            if not keys:
                return with_ones(df.agg(F.count(F.lit(1)).alias("_n"), *made).where("_n > 0").drop("_n"))
            return with_ones(df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*made))

        return Relation(Reduce(self.node, "reduce", keys, grouped, merged=merged))

    def counts(self, *names: str) -> Relation:
        """Each row with its weight as data (named cnt, or as given), weight 1."""
        w = self.node.weights
        names = names or (("cnt",) if len(w.names) == 1 else tuple(n.lstrip("_") for n in w.names))

        def fn(df: DataFrame) -> DataFrame:
            return with_ones(df.select(*[F.col(f"`{c}`") for c in data_columns(df, w)], *[F.col(a).alias(b) for a, b in zip(w.names, names, strict=True)]))

        return Relation(Reduce(self.node, "counts", self.columns, fn))

    def hist_including(self, keys: Relation, name: str = "cnt") -> Relation:
        """counts of this and keys together, less 1 each: with keys of weight 1 that cover all rows, counts with zeros."""
        out = self.concat(keys).counts(name)
        return out.map(*self.columns, injective=True, **{name: f"`{name}` - 1"})

    def histogram(self, keys: Relation, name: str = "cnt") -> Relation:
        """counts of the rows that are among keys, 0 for keys without."""
        return self.semijoin(keys, self._all(keys)).hist_including(keys, name)

    def group_min(self, keys: str | list[str]) -> Relation:
        """The smallest of each group's values (the other columns, compared in order; null comes first)."""
        return self._extreme(keys, "group_min")

    def group_max(self, keys: str | list[str]) -> Relation:
        return self._extreme(keys, "group_max")

    def _extreme(self, keys, op: str) -> Relation:
        keys = checked_keys(self.node, _names(keys))
        values = [c for c in self.columns if c not in keys]
        if not values:
            raise ValueError("there is no column besides the keys")
        by = F.min if op == "group_min" else F.max

        def fn(df: DataFrame) -> DataFrame:
            grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys])
            if len(values) == 1:  # plain aggregates hash; only a minimum has to know of nulls
                v = F.col(f"`{values[0]}`")
                one = F.when(F.bool_or(v.isNull()), None).otherwise(by(v)) if op == "group_min" and self.schema[values[0]].nullable else by(v)
                return with_ones(grouped.agg(one.alias(values[0])))
            out = grouped.agg(by(F.struct(*[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])).alias("_m"))
            return with_ones(out.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"_m.v{i}").alias(v) for i, v in enumerate(values)]))

        schema = T.StructType([*[self.schema[k] for k in keys], *[self.schema[v] for v in values]])
        return Relation(Reduce(self.node, op, keys, fn, merged=not self.node.positive, schema=schema, insertions=op.removeprefix("group_")))

    def group_top_k(self, keys: str | list[str], k: int, *order: Column | str) -> Relation:
        """The first k rows of each group; ties beyond `order` go by the columns. Spark keeps k rows of a group and task
        before the shuffle, so a large group doesn't come to one task as a whole."""
        keys = checked_keys(self.node, _names(keys))
        w = Window.partitionBy(*[F.col(f"`{c}`") for c in keys]).orderBy(*[_column(o) for o in order], *[F.col(f"`{c}`") for c in self.columns if c not in keys])

        def fn(df: DataFrame) -> DataFrame:
            out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
            return with_ones(out.select(*[F.col(f"`{c}`") for c in self.columns]))

        return Relation(Reduce(self.node, "group_top_k", keys, fn, schema=self.schema))

    # checks

    def assert_ones(self) -> Relation:
        """Fails when read if a row's weight isn't 1."""
        schema = self.schema

        def fn(df: DataFrame) -> DataFrame:
            ok = F.when(F.col("_w") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Not a one: "), F.col("_w").cast("string"))).cast("boolean"))
            return df.where(ok)  # a filter is evaluated whichever columns are read

        return Relation(Reduce(self.node, "assert_ones", self.columns, fn, unit=True, schema=schema))

    def assert_1to1_with_output(self, keys: str | list[str], build: Builder) -> tuple[Relation, Mapping]:
        """(relation, mapping): each key must have exactly one value, of weight exactly 1, else reading fails."""
        keys = checked_keys(self.node, _names(keys))
        values = [c for c in self.columns if c not in keys]

        def fn(df: DataFrame) -> DataFrame:
            return with_ones(mapped(df, keys))

        schema = T.StructType([*[self.schema[k] for k in keys], *[self.schema[v] for v in values]])
        out = Relation(Reduce(self.node, "assert_1to1", keys, fn, unit=True, schema=schema))
        return out, Mapping(build, out.node, keys)

    # sharing and scopes

    def split(self) -> Relation:
        """Marks a relation that several others use: it is computed once a step and kept in executors' memory and disks."""
        out = self._linear("split", lambda df: df, unit=True, schema=self.schema)
        out.node.shared = True
        return out

    def dynamic(self) -> Relation:
        """Relations are dynamically typed already."""
        return self

    def collection(self) -> Relation:
        """A relation that can be used several times: every one can."""
        return self.dynamic()

    def barrier(self) -> Relation:
        """Evaluation is by whole steps already."""
        return self

    def enter(self, scope: SubContext) -> Relation:
        """This relation inside a recursive scope, where it stays as it is while the scope iterates."""
        return Relation(Enter(self.node, scope))

    def leave(self, finalizer: Finalizer) -> Relation:
        """This relation at its scope's fixpoint, for the parent scope."""
        if finalizer.scope is not self.node.scope:
            raise ContextMismatch()
        return Relation(Leave(self.node))

    # outputs

    def get_arrangement(self, build: Builder, kind: str = "rows", keys: str | list[str] | list[list[str]] = ()) -> Arrangement:
        """An output; kind: rows, ordered, nested, nested_ordered or mapping (see Arrangement.read)."""
        return Arrangement(build, self.node, kind, [keys] if isinstance(keys, str) else list(keys))

    def get_dyn_arrangement(self, build: Builder) -> Arrangement:
        return self.get_arrangement(build)

    def reduce_output(self, build: Builder) -> ReduceOutput:
        """The output of a reduce, read by key."""
        if not isinstance(self.node, Reduce):
            raise TypeError("this relation isn't made by a reduce")
        return ReduceOutput(build, self.node)

    def split_reduce_output(self, build: Builder) -> tuple[Relation, ReduceOutput]:
        return self, self.reduce_output(build)

    # names in dump_dot

    def _shown_node(self) -> Node:
        n = self.node
        while n.is_hidden and n.deps:
            n = n.deps[0]
        return n

    def named(self, name: str) -> Relation:
        self._shown_node().label = name
        return self

    def op_named(self, name: str) -> Relation:
        self._shown_node().op_label = name
        return self

    def hidden(self) -> Relation:
        if len(self.node.deps) != 1:
            raise ValueError("only a relation made from exactly one other can be hidden")
        self.node.is_hidden = True
        return self

    def shown(self) -> Relation:
        self.node.is_hidden = False
        return self


