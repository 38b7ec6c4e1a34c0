"""Contexts: a Builder creates inputs and relations, a Session steps through commits.

    build = Builder(spark)
    numbers, r = build.create_input("v BIGINT")
    out = r.map(v="v + 1").get_arrangement(build)
    run = build.begin()
    numbers.insert(run, 1)
    run.commit()
    out.read(run)           # a DataFrame of v and the weight _w
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from zedweave.plans.delta import DeltaRun
from zedweave.plans.nodes import ContextMismatch, Node, Source, Variable
from zedweave.plans.snapshot import Snapshot
from zedweave.plans.store import Store
from zedweave.plans.weights import INTEGER, WeightType, consolidated, union

MODES = ("snapshot", "delta")


def struct_type(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema) if schema.strip() else T.StructType([])


class Scope:
    """Relations of equal scope can be combined."""

    parent: Scope | None = None
    root: Builder

    def subgraph(self, tier: str | list[str] = (), max_rounds: int = 10_000):
        """Opens a recursive scope. tier: the columns by which rows of its variables are tiered (none: acyclic data)."""
        return SubContext(self, [tier] if isinstance(tier, str) else list(tier), max_rounds)


class Builder(Scope):
    """Creates the plan; begin() freezes it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.nodes, self.frozen = spark, self, [], False
        self.inputs: list = []
        self.outputs: list = []

    def register(self, node: Node) -> int:
        if self.frozen:
            raise RuntimeError("the plan is frozen: begin() has been called")
        self.nodes.append(node)
        return len(self.nodes) - 1

    def create_input(self, schema: str | T.StructType, weights: WeightType = INTEGER):
        """(Input, Relation): a mutable multiset, empty at first. NOT NULL columns of the schema make cheaper joins."""
        from zedweave.operators.relation import Relation
        from zedweave.sources.inputs import Input

        node = Source(self, struct_type(schema), weights)
        own = Input(self, node)
        self.inputs.append(own)
        return own, Relation(node)

    def from_frame(self, df: DataFrame, unique: bool = False, weights: WeightType = INTEGER):
        """A relation that holds the rows of df (with weight 1 if df has no weight columns) at every step.

        unique: no row of df repeats; nothing needs to be merged then. df is planned together with
        what reads it, so that filters and column lists reach its scan.
        """
        from zedweave.operators.relation import Relation
        from zedweave.plans.nodes import schema_of
        from zedweave.plans.weights import with_ones

        given = all(n in df.columns for n in weights.names)
        if not given and not weights.is_integer:
            raise ValueError(f"df needs the weight columns {weights.names}")
        frame = df if given else with_ones(df)
        node = Source(self, schema_of(frame, weights), weights, frame, unit=unique and not given)
        node.positive = not given
        return Relation(node)

    def begin(self, mode: str = "snapshot", count_messages: bool = False) -> Session:
        """mode: "snapshot" computes what is read from all commits, "delta" maintains it by the changes."""
        if self.frozen:
            raise RuntimeError("begin() was called before")
        self.frozen = True
        return Session(self, mode, count_messages)


class SubContext(Scope):
    """A recursive scope: variables, relations made from them and from entered ones, and what leaves."""

    def __init__(self, parent: Scope, tier: list[str], max_rounds: int):
        self.parent, self.root, self.tier, self.max_rounds = parent, parent.root, tier, max_rounds
        self.variables: list[Variable] = []
        self.finished = False

    def variable(self, schema: str | T.StructType, weights: WeightType = INTEGER):
        """(Handle, Relation): rows with the tier among their columns; handle.set closes the loop."""
        from zedweave.operators.relation import Relation

        schema = struct_type(schema)
        if missing := [t for t in self.tier if t not in schema.names]:
            raise ValueError(f"the tier columns {missing} are missing")
        node = Variable(self, schema, weights)
        self.variables.append(node)
        return VariableHandle(node), Relation(node)

    def finish(self) -> Finalizer:
        self.finished = True
        return Finalizer(self)


class VariableHandle:
    def __init__(self, node: Variable):
        self.node = node

    def set(self, relation) -> None:
        """Defines the variable, once."""
        body = relation.node
        if body.scope is not self.node.scope:
            raise ContextMismatch()
        if self.node.body is not None:
            raise RuntimeError("the variable was set before")
        if set(body.columns) != set(self.node.columns) or body.weights.fields != self.node.weights.fields:
            raise ValueError(f"the variable has {self.node.columns}, the relation {body.columns}")
        if diff := [c for c in body.columns if body.schema[c].dataType != self.node.schema[c].dataType]:
            raise TypeError(f"types of {diff} differ: {[(self.node.schema[c].dataType.simpleString(), body.schema[c].dataType.simpleString()) for c in diff]}")
        self.node.body = body


class Finalizer:
    """Proof that a scope is complete; leave() takes it."""

    def __init__(self, scope: SubContext):
        self.scope = scope


class Session:
    """The clock of commits and the evaluation of what is read."""

    def __init__(self, build: Builder, mode: str, count_messages: bool):
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        self.build, self.spark, self.mode, self.step = build, build.spark, mode, 0
        self.store = Store(build.spark, "relations", spreads=True)
        self.messages: dict[int, int] | None = {} if count_messages else None
        self._snapshot: Snapshot | None = None
        self._run: DeltaRun | None = None
        self._logs: dict[Node, list[DataFrame]] = {}
        self._changes: dict[Node, DataFrame | None] = {}

    def commit(self) -> int:
        """Closes the step: what was updated since the last commit becomes readable. Computes nothing in snapshot mode."""
        self.step += 1
        for i in self.build.inputs:
            i.close_step(self)
        return self.step

    def snapshot(self) -> Snapshot:
        if self._snapshot is None or self._snapshot.step != self.step:
            if self._snapshot:
                self._snapshot.release()
            self._snapshot = Snapshot(self, self.step)
        return self._snapshot

    def frame(self, node: Node) -> DataFrame:
        """The node's consolidated contents as of the last commit; repeated reads of a step are the same frame."""
        if node.scope is not self.build:
            raise ContextMismatch()
        if self.mode == "snapshot" or node not in self.targets():
            return self.snapshot().whole(node)
        self._advance()
        log = self._logs.get(node)
        if not log:
            return node.empty()
        return log[0] if len(log) == 1 else consolidated(union(log), node.weights)

    def maintained(self, node: Node) -> DataFrame:
        """The node's contents as of the last read, perhaps not consolidated: the maintained ones, where its log is kept."""
        if self._run is not None and (held := self._run.state(node)) is not None:
            return held
        return self.snapshot().frame(node)

    def targets(self) -> list[Node]:
        return list(dict.fromkeys(o.node for o in self.build.outputs))

    def changes(self, node: Node) -> DataFrame:
        """Delta mode: what the last read added to (and took from) the node."""
        d = self._changes.get(node)
        return node.empty() if d is None else d

    def _advance(self) -> None:
        if self._run is None:
            self._run = DeltaRun(self.store, self.targets(), self.messages)
        if self._run.last >= self.step:
            return
        self._changes = self._run.advance(self.step, self.snapshot(), Snapshot(self, self._run.last))
        for n, d in self._changes.items():
            if d is not None:
                log = self._logs.setdefault(n, [])
                log.append(d)
                self._logs[n] = self._run.compacted(log, n)

    def read_upto(self) -> int:
        """The last step whose changes nobody needs apart from those before it."""
        return self.step if self.mode == "snapshot" else -1 if self._run is None else self._run.last

    def dump_dot(self, writer) -> None:
        from zedweave.plans.dot import write_dot

        write_dot(self.build, self.messages or {}, writer)

    def close(self) -> None:
        """Deletes what this session has saved; frames that were read from it can't be used any longer."""
        if self._snapshot:
            self._snapshot.release()
        self.store.clear()
