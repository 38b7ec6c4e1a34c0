"""Nodes of the logical plan: what each operator makes of whole relations, and of changes to them.

Two physical properties are tracked, because they save shuffles:
  unit      every row stands in the frame once and has weight 1
  positive  every row of the frame has a weight above zero (implied by unit)
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zedweave.plans.sieve import fits, sieve
from zedweave.plans.weights import INTEGER, WeightType, consolidated, data_columns, union, with_ones

if TYPE_CHECKING:
    from zedweave.plans.context import Scope
    from zedweave.plans.delta import DeltaRun
    from zedweave.plans.snapshot import Snapshot

Frame = DataFrame | None  # None: known to be empty


class ContextMismatch(ValueError):
    """Relations of different contexts met."""

    def __init__(self):
        super().__init__("Context mismatch")


class Node:
    op = "node"

    def __init__(self, scope: Scope, deps: list[Node], schema: T.StructType, weights: WeightType = INTEGER, unit: bool = False, positive: bool = False):
        if any(d.scope is not scope for d in deps if not isinstance(self, Crossing)):
            raise ContextMismatch()
        if taken := [f.name for f in schema.fields if f.name.startswith(("_w", "_r_"))]:
            raise ValueError(f"names reserved for the engine: {taken}")
        if len({n.lower() for n in schema.names}) < len(schema.names):
            raise ValueError(f"column names repeat: {schema.names}; rename some before")
        self.scope, self.deps, self.schema, self.weights = scope, deps, schema, weights
        self.unit, self.positive = unit, unit or positive
        self.label, self.op_label, self.is_hidden, self.shared = None, None, False, False
        self.id = scope.root.register(self)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def snapshot(self, at: Snapshot) -> DataFrame:
        """The whole relation, possibly not consolidated unless `unit`."""
        raise NotImplementedError

    def delta(self, run: DeltaRun) -> Frame:
        """What this step adds (and, with negative weights, takes away)."""
        raise NotImplementedError

    def stateful(self) -> list[Node]:
        """The inputs whose contents a delta rule reads again in later steps."""
        return []

    def looked_up_by(self, side: int) -> list[str]:
        """The columns by which a delta rule looks for rows of stateful()[side]."""
        return []

    def grows(self, run: DeltaRun) -> bool:
        """Whether this step's delta is known to have positive weights only."""
        return False

    def empty(self) -> DataFrame:
        spark = self.scope.root.spark
        return spark.createDataFrame([], T.StructType([*self.schema.fields, *T._parse_datatype_string(self.weights.ddl()).fields]))


class Crossing(Node):
    """A node whose input lies in another scope."""


def schema_of(df: DataFrame, weights: WeightType) -> T.StructType:
    if missing := [n for n in weights.names if n not in df.columns]:
        raise ValueError(f"the weight columns {missing} are missing")
    return T.StructType([f for f in df.schema.fields if f.name not in weights.names])


class Source(Node):
    """A mutable input; its changes are logged by step."""

    op = "input"

    def __init__(self, scope: Scope, schema: T.StructType, weights: WeightType, frame: Frame = None, unit: bool = False):
        super().__init__(scope, [], schema, weights, unit, positive=frame is not None)
        self.frame, self.log = frame, []  # log: (step, frame, whether all its weights are positive)

    def changes(self, after: int, upto: int) -> Frame:
        """What was committed in the steps after+1 .. upto; a static frame counts as step 0, the first of all."""
        parts = [f for s, f, _ in self.log if after < s <= upto]
        if self.frame is not None and after < 0:
            parts.insert(0, self.frame)
        return union(parts) if parts else None

    def snapshot(self, at):
        out = self.changes(-1, at.step)
        return self.empty() if out is None else out

    def delta(self, run):
        return self.changes(run.last, run.step)

    def grows(self, run):
        return (self.positive or run.last >= 0) and all(p for s, _, p in self.log if run.last < s <= run.step)


class Linear(Node):
    """An operator that works row by row: what it makes of changes are the changes of what it makes."""

    def __init__(self, dep: Node, op: str, fn: Callable[[DataFrame], DataFrame], weights: WeightType | None = None, unit: bool = False, keeps_sign: bool = True, schema: T.StructType | None = None):
        weights = weights or dep.weights
        super().__init__(dep.scope, [dep], schema or schema_of(fn(dep.empty()), weights), weights, unit, keeps_sign and dep.positive)
        self.op, self.fn, self.keeps_sign = op, fn, keeps_sign

    def snapshot(self, at):
        return self.fn(at.frame(self.deps[0]))

    def delta(self, run):
        d = run.delta(self.deps[0])
        return None if d is None else self.fn(d)

    def grows(self, run):
        return self.keeps_sign and run.grows(self.deps[0])


class Concat(Node):
    """Multiset union: weights add."""

    op = "concat"

    def __init__(self, left: Node, right: Node):
        if left.scope is not right.scope:
            raise ContextMismatch()
        if set(left.columns) != set(right.columns):
            raise ValueError(f"concat needs the same columns: {left.columns} and {right.columns}")
        if left.weights.fields != right.weights.fields:
            raise TypeError("concat needs the same weights")
        super().__init__(left.scope, [left, right], schema_of(left.empty().unionByName(right.empty()), left.weights), left.weights, positive=left.positive and right.positive)

    def snapshot(self, at):
        return at.frame(self.deps[0]).unionByName(at.frame(self.deps[1]))

    def delta(self, run):
        parts = [d for d in map(run.delta, self.deps) if d is not None]
        return union(parts) if parts else None

    def grows(self, run):
        return all(map(run.grows, self.deps))


def _keys(left: Node, right: Node, on) -> list[tuple[str, str]]:
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in ([on] if isinstance(on, str) else on)]
    for node, names in ((left, [p[0] for p in pairs]), (right, [p[1] for p in pairs])):
        checked_keys(node, names)
    return pairs


def checked_keys(node: Node, names: list[str]) -> list[str]:
    for n in names:
        if n not in node.columns:
            raise ValueError(f"no column {n!r} among {node.columns}")
        kind = node.schema[n].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType, T.MapType)):
            raise TypeError(f"{n!r} is {kind.simpleString()}, which has no exact equality; use a decimal, integer or text key")
    return names


def renamed(df: DataFrame) -> DataFrame:
    """All columns with a prefix, so that no attribute is shared with the other side of a join."""
    return df.select([F.col(f"`{c}`").alias(f"_r_{c}") for c in df.columns])


def null_safe(left: Node, right: Node, pairs: list[tuple[str, str]]) -> Column:
    """Equality under which null equals null. Where one side has no nulls plain equality says the same."""
    out = F.lit(True)
    for k, (x, y) in enumerate(pairs):
        a, b = F.col(f"`{x}`"), F.col(f"`_r_{y}`")
        one = a.eqNullSafe(b) if left.schema[x].nullable and right.schema[y].nullable else a == b
        out = one if k == 0 else out & one
    return out


class Join(Node):
    """Inner equi-join; weights multiply. Null keys are equal to each other."""

    op = "join"

    def __init__(self, left: Node, right: Node, on, weights: WeightType | None = None):
        if left.scope is not right.scope:
            raise ContextMismatch()
        self.pairs = _keys(left, right, on)
        keys, others = [p[0] for p in self.pairs], {p[1] for p in self.pairs}
        self.left_columns = [*keys, *[c for c in left.columns if c not in keys]]
        self.right_columns = [c for c in right.columns if c not in others]
        if clash := {c.lower() for c in self.left_columns} & {c.lower() for c in self.right_columns}:
            raise ValueError(f"both sides have {sorted(clash)}; rename one side's")
        weights = weights or left.weights
        schema = T.StructType([*[left.schema[c] for c in self.left_columns], *[right.schema[c] for c in self.right_columns]])
        super().__init__(left.scope, [left, right], schema, weights, unit=left.unit and right.unit and weights.is_integer, positive=left.positive and right.positive and weights.is_integer)
        weights.multiplied([F.lit(1) for _ in left.weights.names], [F.lit(1) for _ in right.weights.names])  # else it would fail late

    def joined(self, a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = self.deps
        out = a.join(renamed(b), null_safe(left, right, self.pairs), "inner") if self.pairs else a.crossJoin(renamed(b))
        product = self.weights.multiplied([F.col(n) for n in left.weights.names], [F.col(f"_r_{n}") for n in right.weights.names])
        return out.select(*[F.col(f"`{c}`") for c in self.left_columns], *[F.col(f"`_r_{c}`").alias(c) for c in self.right_columns], *product)

    def snapshot(self, at):
        left, right = self.deps
        a, b = at.frame(left), at.frame(right)
        if right.unit and not self.right_columns and left.weights == self.weights and self.weights.is_integer and self.pairs:
            out = a.join(renamed(b), null_safe(left, right, self.pairs), "left_semi")
            return out.select(*[F.col(f"`{c}`") for c in self.left_columns], *left.weights.names)
        return self.joined(a, b)

    def delta(self, run):
        left, right = self.deps
        da, db = run.delta(left), run.delta(right)
        mine, theirs = self.looked_up_by(0), self.looked_up_by(1)
        old_b = run.met(right, theirs, da, mine) if da is not None else None
        new_a = run.met(left, mine, db, theirs, new=True) if db is not None else None
        parts = [self.joined(x, y) for x, y in ((da, old_b), (new_a, db)) if x is not None and y is not None]
        return union(parts) if parts else None

    def stateful(self):
        return self.deps

    def looked_up_by(self, side):
        return [p[side] for p in self.pairs]

    def grows(self, run):
        return self.weights.is_integer and all(run.grows(n) and run.has_grown(n) for n in self.deps)


class AntiJoin(Node):
    """Rows of the left side whose key has weight zero on the right, weights unchanged."""

    op = "antijoin"

    def __init__(self, left: Node, right: Node, on):
        if left.scope is not right.scope:
            raise ContextMismatch()
        self.pairs = _keys(left, right, on)
        super().__init__(left.scope, [left, right], left.schema, left.weights, left.unit, left.positive)

    def right_keys(self, b: DataFrame, sums: bool = True) -> DataFrame:
        right = self.deps[1]
        b = b.select(*[F.col(f"`{p[1]}`") for p in self.pairs], *right.weights.names)
        return consolidated(b, right.weights) if sums else b

    def without(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """b: keys of nonzero weight, repeats allowed."""
        left, right = self.deps
        return a.join(renamed(b), null_safe(left, right, self.pairs) if self.pairs else F.lit(True), "left_anti")

    def snapshot(self, at):
        left, right = self.deps
        return self.without(at.frame(left), self.right_keys(at.frame(right), sums=not right.positive))

    def delta(self, run):
        left, right = self.deps
        da, db = run.delta(left), run.delta(right)
        parts = []
        mine, keys = self.looked_up_by(0), self.looked_up_by(1)
        if db is not None and (old_a := run.met(left, mine, db, keys)) is not None:
            w = right.weights
            new_part = self.right_keys(db)
            touched = new_part.select(*[F.col(f"`{k}`") for k in keys])
            held = run.met(right, keys, new_part, keys)
            both = new_part.withColumns({f"_was{i}": F.lit(0).cast(t) for i, (_, t) in enumerate(w.fields)})
            if held is not None:
                old_part = self.right_keys(only(held, right, touched, keys))
                both = both.unionByName(old_part.withColumns({f"_was{i}": F.col(n) for i, n in enumerate(w.names)}))
            sums = both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*w.sums(), *[F.sum(f"_was{i}").alias(f"_was{i}") for i in range(len(w.names))])
            was = F.lit(False)
            for i in range(len(w.names)):
                was = was | (F.col(f"_was{i}") != 0)
            flips = sums.select(*[F.col(f"`{k}`") for k in keys], w.nonzero().alias("_now"), was.alias("_was")).where("_now <> _was")
            flips = flips.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in keys], F.when(F.col("_now"), -1).otherwise(1).alias("_sign"))
            moved = old_a.join(flips, null_safe(left, right, self.pairs) if self.pairs else F.lit(True), "inner")
            parts.append(moved.select(*[F.col(f"`{c}`") for c in left.columns], *[(F.col(n) * F.col("_sign")).cast(t).alias(n) for n, t in left.weights.fields]))
        if da is not None:
            new_b = run.met(right, keys, da, mine, new=True)
            parts.append(da if new_b is None else self.without(da, self.right_keys(new_b)))
        return union(parts) if parts else None

    def stateful(self):
        return self.deps

    def looked_up_by(self, side):
        return [p[side] for p in self.pairs]


def only(df: DataFrame, node: Node, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows of df whose `names` are among the rows of keys."""
    if not names:
        return df
    return df.join(renamed(keys), null_safe(node, node, [(n, n) for n in names]), "left_semi")


#: Rows of a triangle's relations from which on it is found by wedges, and counters of a sketch of their degrees.
MANY_EDGES, COUNTERS, HEAVY_COUNTERS, HEAVY = 1 << 17, 1 << 12, 1 << 16, 1 << 10
#: Rows of a relation from which on wedges are closed by hashing it, if its rows don't repeat; of it in a task, and of the two
#: that make wedges. Where the session's partitions are as many they are left.
MANY_HASHED, HASHED, SORTED = 1 << 17, 1 << 18, 1 << 20


class Triangles(Node):
    """(x, y), (x, z), (y, z) -> (x, y, z), weights multiply.

    Wedges are made at the kind of vertex (x, y or z) that has the fewest, by a sketch of the degrees, and closed by the
    third relation. Vertices of that kind which make more wedges than there are edges are left to `by_edge`: it completes
    each edge over the smaller of two neighbourhoods.
    """

    op = "triangles"

    def __init__(self, xy: Node, xz: Node, yz: Node):
        if not xy.scope is xz.scope is yz.scope:
            raise ContextMismatch()
        if any(len(n.columns) != 2 for n in (xy, xz, yz)):
            raise ValueError("triangles takes relations of two columns each")
        if not all(n.weights.is_integer for n in (xy, xz, yz)):
            raise TypeError("triangles takes integer weights")
        for n in (xy, xz, yz):
            checked_keys(n, n.columns)
        schema = T.StructType([xy.schema[0], xy.schema[1], xz.schema[1]])
        super().__init__(xy.scope, [xy, xz, yz], schema, unit=xy.unit and xz.unit and yz.unit, positive=xy.positive and xz.positive and yz.positive)

    def found(self, xy: DataFrame, xz: DataFrame, yz: DataFrame, rows: int, ones: bool = False) -> DataFrame:
        """rows: those of the three frames, which are saved ones where they are many. ones: all weights are 1."""
        xy, xz, yz = xy.toDF("x", "y", "w"), xz.toDF("x", "z", "w"), yz.toDF("y", "z", "w")
        if rows < MANY_EDGES:
            out = self.by_edge(xy, xz, yz, "xyz")
        else:
            out = self.by_vertex(xy, xz, yz, ones)
        return out.select(*[F.col(v).alias(n) for v, n in zip("xyz", self.columns)], "_w")

    def by_vertex(self, xy: DataFrame, xz: DataFrame, yz: DataFrame, ones: bool) -> DataFrame:
        held = {"x": (xy, xz, yz), "y": (xy, yz, xz), "z": (xz, yz, xy)}
        seen = self.wedges(held)
        at = min(held, key=lambda v: (seen[v][0], "zyx".index(v)))
        one, two, third = held[at]
        p, q = ((set(df.columns) - {at, "w"}).pop() for df in (one, two))
        rows = {"x": seen["y"][2], "y": seen["x"][2], "z": seen["x"][1]}[at]  # of the third
        closed = self.closed
        if rows >= MANY_HASHED and self.deps["zyx".index(at)].unit and all(plain for *_, plain in seen.values()):
            n1, n2 = -(-sum(seen[at][1:3]) // SORTED), -(-rows // HASHED)
            closed = lambda a, b, c, at: self.hashed(a, b, c, at, n1, n2, ones)
        heavy = self.heavy(one, two, at)
        if heavy is None:
            return closed(one, two, third, at)
        is_heavy = F.col(at).eqNullSafe(F.col("_heavy"))
        apart = lambda df, how: df.join(F.broadcast(heavy), is_heavy, how)
        light = closed(apart(one, "left_anti"), apart(two, "left_anti"), third, at)
        rest = self.by_edge(third.select(p, q, "w"), apart(one, "left_semi").select(p, at, "w"), apart(two, "left_semi").select(q, at, "w"), (p, q, at))
        return light.unionByName(rest)

    @staticmethod
    def wedges(held: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> dict[str, tuple[int, int, int, bool]]:
        """About how many wedges each kind of vertex makes, by products of signed sums, whose errors cancel out; the rows of
        both sides; and whether `=` finds them as `<=>` does, as a side has no nulls and both have one type."""
        parts = []
        for v, (one, two, _) in held.items():
            for side, df in enumerate((one, two)):
                h = df.select(F.xxhash64(v).alias("h"), F.col(v).isNull().cast("int").alias("no"))
                sums = h.groupBy(F.pmod("h", F.lit(COUNTERS)).alias("b")).agg(F.sum(F.when(F.shiftrightunsigned("h", 40).bitwiseAND(1) == 1, 1).otherwise(-1)).alias("s"), F.count(F.lit(1)).alias("n"), F.sum("no").alias("no"))
                parts.append(sums.select(F.lit(v).alias("v"), F.lit(side).alias("side"), "b", "s", "n", "no"))
        both = union(parts).groupBy("v", "b").agg(*[F.coalesce(F.sum(F.when(F.col("side") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for c in ("s", "n", "no") for k in (0, 1)])
        sums = {r["v"]: r for r in both.groupBy("v").agg(F.sum(F.col("s0") * F.col("s1")).alias("wedges"), *[F.sum(c).alias(c) for c in ("n0", "n1", "no0", "no1")]).collect()}
        out = {}
        for v, (one, two, _) in held.items():
            r = sums.get(v)
            plain = one.schema[v].dataType == two.schema[v].dataType and (r is None or 0 in (r["no0"], r["no1"]))
            out[v] = (0, 0, 0, plain) if r is None else (max(r["wedges"], min(r["n0"], r["n1"])), r["n0"], r["n1"], plain)
        return out

    @staticmethod
    def heavy(one: DataFrame, two: DataFrame, at: str) -> DataFrame | None:
        """The vertices that make more wedges than there are edges: these have more edges than twice the square root of all,
        so there are few. None: there are none."""
        crowded = F.pmod(F.xxhash64(at), F.lit(HEAVY_COUNTERS))
        both = one.select(crowded.alias("b"), F.lit(1).alias("o"), F.lit(0).alias("t")).unionByName(two.select(crowded.alias("b"), F.lit(0).alias("o"), F.lit(1).alias("t")))
        sums = both.groupBy("b").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
        total = sums.agg(F.sum(F.col("o") + F.col("t")).alias("n"), F.max(F.col("o") * F.col("t")).alias("most")).first()
        limit = max(HEAVY**2, total["n"] or 0)
        if not total["n"] or total["most"] <= limit:
            return None
        buckets = F.broadcast(sums.where(F.col("o") * F.col("t") > limit).select(F.col("b").alias("_b")))
        many = lambda df: df.join(buckets, crowded == F.col("_b"), "left_semi").groupBy(at).count()
        left, right = many(one).toDF("_heavy", "_n"), many(two).toDF("_other", "_m")
        rows = left.join(right, F.col("_heavy").eqNullSafe(F.col("_other")) & (F.col("_n") * F.col("_m") > limit)).select("_heavy").collect()
        return one.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_heavy", one.schema[at].dataType)])) if rows else None

    @staticmethod
    def closed(one: DataFrame, two: DataFrame, third: DataFrame, at: str) -> DataFrame:
        """Wedges at `at`, one edge of each of the first two relations, closed by the third."""
        p, q = ((set(df.columns) - {at, "w"}).pop() for df in (one, two))
        b, c = two.select(F.col(at).alias("_at"), q, F.col("w").alias("w2")), third.select(F.col(p).alias("_p"), F.col(q).alias("_q"), F.col("w").alias("w3"))
        wedges = one.join(b, F.col(at).eqNullSafe(F.col("_at"))).select(p, q, at, (F.col("w") * F.col("w2")).alias("w"))
        whole = wedges.join(c, F.col(p).eqNullSafe(F.col("_p")) & F.col(q).eqNullSafe(F.col("_q")))
        return whole.select("x", "y", "z", (F.col("w") * F.col("w3")).alias("_w"))

    @staticmethod
    def hashed(one: DataFrame, two: DataFrame, third: DataFrame, at: str, n1: int, n2: int, ones: bool) -> DataFrame:
        """`closed` for many edges without nulls of which the third relation's don't repeat: wedges aren't sorted, and the
        tasks of the joins, n1 and n2, go by the edges."""
        p, q = ((set(df.columns) - {at, "w"}).pop() for df in (one, two))
        own = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = lambda df, n, *by: df.repartition(n, *by) if n > own else df
        w = lambda name: [] if ones else [F.col("w").alias(name)]
        a, b = dealt(one.select(at, p, *w("w1")), n1, at), dealt(two.select(F.col(at).alias("_at"), q, *w("w2")), n1, "_at")
        c = dealt(third.select(F.col(p).alias("_p"), F.col(q).alias("_q"), *w("w3")), n2, "_p", "_q")
        product = lambda *names: F.lit(1).cast("bigint") if ones else F.col(names[0]) * F.col(names[1])
        wedges = a.join(b, F.col(at) == F.col("_at")).select(p, q, at, *([] if ones else [product("w1", "w2").alias("w")]))
        whole = dealt(wedges, n2, p, q).join(c.hint("shuffle_hash"), (F.col(p) == F.col("_p")) & (F.col(q) == F.col("_q")))
        return whole.select("x", "y", "z", product("w", "w3").alias("_w"))

    @staticmethod
    def by_edge(pq: DataFrame, pr: DataFrame, qr: DataFrame, names) -> DataFrame:
        p, q, r = names
        a = pq.select(F.col(p).alias("p"), F.col(q).alias("q"), F.col("w").alias("wa"))
        b, c = pr.select(F.col(p).alias("bp"), F.col(r).alias("br"), F.col("w").alias("wb")), qr.select(F.col(q).alias("cq"), F.col(r).alias("cr"), F.col("w").alias("wc"))
        same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
        of_p = b.groupBy("bp").agg(F.count(F.lit(1)).alias("np")).withColumnRenamed("bp", "dp")
        of_q = c.groupBy("cq").agg(F.count(F.lit(1)).alias("nq")).withColumnRenamed("cq", "dq")
        a = a.join(of_p, same("p", "dp")).join(of_q, same("q", "dq"))
        over_p = a.where("np <= nq").join(b, same("p", "bp")).join(c, same("q", "cq") & same("br", "cr"))
        over_q = a.where("np > nq").join(c, same("q", "cq")).join(b, same("p", "bp") & same("br", "cr"))
        out = over_p.unionByName(over_q).select(F.col("p").alias(p), F.col("q").alias(q), F.col("br").alias(r), (F.col("wa") * F.col("wb") * F.col("wc")).alias("_w"))
        return out.select("x", "y", "z", "_w")

    def snapshot(self, at):
        held = [at.session.store.watched(at.frame(n), None) for n in self.deps]
        return self.empty() if any(f is None for f in held) else self.found(*held, sum(f._zedweave_rows for f in held), self.unit)

    def delta(self, run):
        d = [run.delta(n) for n in self.deps]
        d = [f if f is None or hasattr(f, "_zedweave_rows") else run.saved(f, n) for f, n in zip(d, self.deps)]
        parts = []
        for k in range(3):
            if d[k] is not None:
                logs = [[d[i]] if i == k else run.logs.get(n, []) + ([d[i]] if i < k and d[i] is not None else []) for i, n in enumerate(self.deps)]
                if all(logs):
                    parts.append(self.found(*map(union, logs), sum(getattr(f, "_zedweave_rows", 0) for log in logs for f in log)))
        return union(parts) if parts else None

    def stateful(self):
        return self.deps


class Reduce(Node):
    """A function of each group's whole contents. fn takes a frame with all rows of its groups and returns rows by group.

    merged: fn needs equal rows merged and zero weights gone (else it only needs positive weights).
    insertions: how insertions alone change the output, from the output so far: "distinct", "min" or "max".
    """

    def __init__(self, dep: Node, op: str, keys: list[str], fn: Callable[[DataFrame], DataFrame], unit: bool = True, merged: bool = True, weights: WeightType = INTEGER, schema: T.StructType | None = None, insertions: str | None = None):
        super().__init__(dep.scope, [dep], schema or schema_of(fn(dep.empty()), weights), weights, unit, positive=unit)
        self.op, self.keys, self.fn, self.merged, self.insertions = op, keys, fn, merged, insertions

    def snapshot(self, at):
        dep = self.deps[0]
        df = at.frame(dep)
        return self.fn(df if dep.unit or dep.positive and not self.merged else consolidated(df, dep.weights))

    def delta(self, run):
        dep = self.deps[0]
        if run.delta(dep) is None:
            return None
        if self.insertions and run.only_insertions(self):
            if self.insertions == "distinct" and self.columns and run.has_grown(self) and run.is_large(self):
                return self.new_rows(run)
            return self.after_insertions(run.delta(dep), run.state(self), run.has_grown(self))
        if (d := run.keep(dep)) is None:
            return None
        old = run.met(dep, self.keys, d, self.keys)
        if old is None:
            return self.fn(consolidated(d, dep.weights))
        # one sum gives the touched groups' rows both before and after
        touched = d.select(*[F.col(f"`{k}`") for k in self.keys]).distinct()
        names = dep.weights.names
        before = only(old, dep, touched, self.keys).withColumns({f"_was{i}": F.col(n) for i, n in enumerate(names)})
        both = before.unionByName(d.withColumns({f"_was{i}": F.lit(0).cast(t) for i, (_, t) in enumerate(dep.weights.fields)}))
        both = both.groupBy(*[F.col(f"`{c}`") for c in dep.columns]).agg(*dep.weights.sums(), *[F.sum(f"_was{i}").cast(t).alias(f"_was{i}") for i, (_, t) in enumerate(dep.weights.fields)])
        columns = [F.col(f"`{c}`") for c in dep.columns]
        new = both.select(*columns, *names).where(dep.weights.nonzero())
        was = both.select(*columns, *[F.col(f"_was{i}").alias(n) for i, n in enumerate(names)]).where(dep.weights.nonzero())
        return consolidated(self.fn(new).unionByName(self.fn(was).withColumns(self.weights.negated())), self.weights)

    def new_rows(self, run: DeltaRun) -> Frame:
        """after_insertions of a distinct whose output so far is large: rows of it that can't be among the new ones, by a
        Bloom filter of these, are not shuffled."""
        columns, store, log = [F.col(f"`{c}`") for c in self.columns], run.store, run.logs[self]
        new = run.written(with_ones(run.delta(self.deps[0]).select(*columns).distinct()), self)
        if new is None:
            return None
        old, rows = union(log).select(*columns), new._zedweave_rows
        held = sum(f._zedweave_rows for f in log)
        if fits(rows) and held > 2 * rows:
            old = old.where(sieve(new, rows, self.columns))
        same = null_safe(self, self, [(c, c) for c in self.columns])
        # the log is on the right: a semi join is pushed into a union on its left, and a task then sorts for every part of it
        both = store.watched(new.select(*columns).join(renamed(old), same, "left_semi"), None)
        if both is None:
            return new
        out = run.written(new.join(renamed(both), same, "left_anti"), self)
        store.drop(new)
        store.drop(both)
        return out

    def after_insertions(self, d: DataFrame, old: Frame, old_grown: bool) -> DataFrame:
        """The changes of the output when rows d of positive weights come in. old: the output's log, if it has grown only
        without retractions in it."""
        new = with_ones(d.select(*[F.col(f"`{c}`") for c in self.columns]).distinct()) if self.insertions == "distinct" else self.fn(d)
        if old is None:
            return new
        old = old if old_grown else consolidated(old, self.weights)
        if self.insertions == "distinct":
            return new.join(renamed(old), null_safe(self, self, [(c, c) for c in self.columns]) if self.columns else F.lit(True), "left_anti")
        values = [c for c in self.columns if c not in self.keys]
        both = new.join(renamed(old), null_safe(self, self, [(k, k) for k in self.keys]) if self.keys else F.lit(True), "left")
        a, b = (F.struct(*[F.col(f"`{p}{v}`").alias(f"v{i}") for i, v in enumerate(values)]) for p in ("", "_r_"))
        gone = F.col("_r__w").isNotNull()
        both = both.where(~gone | (a < b if self.insertions == "min" else a > b))
        row = lambda v, w: F.struct(v.alias("v"), F.lit(w).cast("bigint").alias("w"))
        both = both.select(*[F.col(f"`{k}`") for k in self.keys], F.explode(F.when(gone, F.array(row(a, 1), row(b, -1))).otherwise(F.array(row(a, 1)))).alias("_c"))
        return both.select(*[F.col(f"`{k}`") for k in self.keys], *[F.col(f"_c.v.v{i}").alias(v) for i, v in enumerate(values)], F.col("_c.w").alias("_w"))

    def stateful(self):
        return [] if self.insertions else self.deps

    def looked_up_by(self, side):
        return self.keys

    def grows(self, run):
        return run.delta(self.deps[0]) is None or self.insertions == "distinct" and run.by_insertions(self)


class Variable(Node):
    """A relation of a recursive scope that is defined by one made from it; empty until set."""

    op = "variable"

    def __init__(self, scope: Scope, schema: T.StructType, weights: WeightType = INTEGER):
        super().__init__(scope, [], schema, weights)
        self.body: Node | None = None

    def snapshot(self, at):
        return at.bound(self)

    def delta(self, run):
        return run.fed(self)

    def grows(self, run):
        return run.delta(self) is None or run.feed_grows(self)


class Enter(Crossing):
    """An outer relation inside a recursive scope: it doesn't change while the scope iterates."""

    op = "enter"

    def __init__(self, dep: Node, scope: Scope):
        if scope.parent is not dep.scope:
            raise ContextMismatch()
        super().__init__(scope, [dep], dep.schema, dep.weights, dep.unit, dep.positive)

    def snapshot(self, at):
        return at.outer.frame(self.deps[0])

    def delta(self, run):
        return run.entered(self)

    def grows(self, run):
        return run.entered_grows(self)


class Leave(Crossing):
    """A relation of a recursive scope at its fixpoint, for the parent scope."""

    op = "leave"

    def __init__(self, dep: Node):
        super().__init__(dep.scope.parent, [dep], dep.schema, dep.weights, dep.unit, dep.positive)

    def snapshot(self, at):
        return at.fixpoint(self.deps[0].scope).result(self.deps[0])

    def delta(self, run):
        return run.left(self)
