"""Evaluation of changes: each step's changes of the sources become changes of the outputs.

What a rule needs of earlier steps is kept as a log of saved, consolidated changes, whose union is the
relation; logs are merged when they get long. So a step writes as much as has changed, not whole relations.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zedweave.plans.nodes import AntiJoin, Enter, Frame, Leave, Node, Reduce, Source, Variable
from zedweave.plans.weights import consolidated, union

if TYPE_CHECKING:
    from zedweave.plans.context import Scope
    from zedweave.plans.fixpoint import Loop
    from zedweave.plans.snapshot import Snapshot
    from zedweave.plans.store import Store

#: Types of columns whose values are pushed to scans.
LOOKED_UP = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.DecimalType)

#: Saved changes after which the newest of a log are merged; after which those without equal rows become one scan, and the
#: folders of such a scan at most.
LONG, SHORT, FOLDERS = 12, 3, 32
#: Rows of a state from which on a change of at most FEW keys is looked up in it, and keys of one pushed filter.
LARGE, FEW, AT_ONCE = 1 << 20, 200, 10


class DeltaRun:
    """Steps over a root scope (epochs) or an inner scope (rounds of a fixpoint)."""

    def __init__(self, store: Store, targets: list[Node], count: dict[int, int] | None = None, outer: DeltaRun | None = None):
        self.store, self.targets, self.counts, self.outer = store, targets, count, outer
        self.entering = True  # whether this round takes in what has changed outside
        self.loops: dict[Scope, Loop] = {}
        self.last, self.step = -1, -1
        self.logs: dict[Node, list[DataFrame]] = {}
        self.now: dict[Node, Frame] = {}
        self.feed: dict[Variable, Frame] = {}
        self.at: Snapshot | None = None
        self.results: dict[Node, DataFrame] = {}
        self.grown: dict[Node, bool] = {}  # whether all changes logged so far were positive
        self.had_grown: dict[Node, bool] = {}
        self.signs: dict[Node, bool] = {}
        self.before: Snapshot | None = None
        self.growing: set[Node] = set()
        self._moving: dict[Node, bool] = {}
        self.by_output: set[Node] = set()  # reduces of which the output is kept, as long as only insertions come
        self.order: dict[Node, list[str]] = {}  # columns by which a kept node's log is looked up
        self.reachable = self._reachable()
        self.kept_nodes = self._kept()

    def _reachable(self) -> list[Node]:
        seen, todo = {}, list(self.targets)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen[n] = True
                todo += self.enters(n.deps[0].scope) if isinstance(n, Leave) else [] if isinstance(n, Enter) and n.scope is self.scope else n.deps
        return list(seen)

    @property
    def scope(self) -> Scope:
        return self.targets[0].scope

    @staticmethod
    def enters(scope: Scope) -> list[Node]:
        """The relations of the parent scope that a scope reads."""
        return [n.deps[0] for n in scope.root.nodes if isinstance(n, Enter) and n.scope is scope]

    def moving(self, node: Node) -> bool:
        """Whether the node may change after the first step."""
        if node not in self._moving:
            if isinstance(node, Source):
                out = node.frame is None
            elif isinstance(node, Variable):
                out = True
            elif isinstance(node, Enter):
                out = self.outer is not None and self.outer.moving(node.deps[0])
            else:
                out = any(map(self.moving, self.enters(node.deps[0].scope) if isinstance(node, Leave) else node.deps))
            self._moving[node] = out
        return self._moving[node]

    def _kept(self) -> set[Node]:
        out = set()
        self.asked: set[Node] = set()  # nodes of which other nodes' rules read the log
        for n in self.reachable:
            if isinstance(n, Leave):  # what enters its scope is read more than once
                out.update(d for d in self.enters(n.deps[0].scope) if self.moving(d) and not isinstance(d, Source))
            if isinstance(n, Enter) and self.moving(n):
                out.add(n)
            deps = n.stateful()
            for i, d in enumerate(deps):
                own = isinstance(n, Reduce) or isinstance(n, AntiJoin) and i == 1
                if own and self.moving(d) or any(self.moving(x) for j, x in enumerate(deps) if j != i):
                    out.add(d)
                    self.asked.add(d)
                    self.order.setdefault(d, n.looked_up_by(i))
            if isinstance(n, Reduce) and n.insertions and self.moving(n.deps[0]):
                out.add(n)
                self.by_output.add(n)
        return out

    # what the rules ask for

    def delta(self, node: Node) -> Frame:
        if node not in self.now:
            d = node.delta(self)
            if d is not None and not isinstance(node, Variable):
                if node in self.kept_nodes or self.counts is not None:
                    d = self.saved(d, node)
                if self.counts is not None and d is not None:
                    self.counts[node.id] = self.counts.get(node.id, 0) + d._zedweave_rows
            self.now[node] = d
        return self.now[node]

    def saved(self, d: DataFrame, node: Node) -> Frame:
        """d with equal rows merged, saved; None if nothing is left."""
        if getattr(d, "_zedweave_written", None) is node:
            return d
        whole = isinstance(node, Enter) and (self.last < 0 or self.outer is None)  # not changes, but all contents
        if not ((isinstance(node, Reduce) or whole) and node.unit):  # these have no equal rows
            d = consolidated(d, node.weights)
        return self.written(d, node)

    def written(self, d: DataFrame, node: Node) -> Frame:
        """Saved, sorted within its files by the columns that it is looked up by."""
        if by := self.order.get(node):
            d = d.sortWithinPartitions(*[F.col(f"`{c}`") for c in by])
        out = self.store.watched(d, "_w" if node.weights.is_integer else None)
        if out is not None:
            out._zedweave_written = node
        return out

    def keep(self, node: Node) -> Frame:
        """This step's delta, saved; it is logged from now on if the node moves."""
        d = self.delta(node)
        if self.moving(node):
            self.asked.add(node)
        if d is not None and node not in self.kept_nodes and self.moving(node):
            self.kept_nodes.add(node)
            if self.counts is None and not isinstance(node, Variable):
                d = self.now[node] = self.saved(d, node)
        return d

    def only_insertions(self, node: Reduce) -> bool:
        """Whether a reduce may go by its output so far. At the first retraction its input's earlier contents are
        computed and kept from then on."""
        dep = node.deps[0]
        if not self.moving(dep):
            return False
        if node in self.by_output and self.grows(dep):
            return True
        if node in self.by_output:
            self.by_output.discard(node)
            if self.last >= 0 and dep not in self.kept_nodes:
                held = self.store.watched(consolidated(self.before.frame(dep), dep.weights), None)
                self.logs[dep] = [] if held is None else [held]
                self.grown[dep] = False
        return False

    def by_insertions(self, node: Reduce) -> bool:
        return node in self.by_output

    def grows(self, node: Node) -> bool:
        """Whether this step's delta is known to hold positive weights only."""
        if node not in self.signs:
            self.signs[node] = self.delta(node) is None or node.grows(self)
        return self.signs[node]

    def has_grown(self, node: Node) -> bool:
        return self.grown.get(node, True)

    def feed_grows(self, variable: Variable) -> bool:
        return variable in self.growing

    def measured(self, node: Node) -> bool:
        """The sign of what a node holds at the first step."""
        return node.positive or self.inserts(node)

    def inserts(self, node: Node) -> bool:
        """The sign of a delta, by its rule or found by looking at it."""
        if not node.weights.is_integer:
            return False
        d = self.keep(node) if self.moving(node) and not isinstance(node, Source) else self.delta(node)
        if d is None or self.signs.get(node):
            return True
        if not hasattr(d, "_zedweave_least"):
            return self.grows(node) if isinstance(node, Source) else d.agg(F.coalesce(F.min("_w"), F.lit(1)).alias("w")).first()["w"] > 0
        return d._zedweave_least is not None and d._zedweave_least > 0

    def is_large(self, node: Node) -> bool:
        """Whether the relation before this step has very many rows."""
        return sum(getattr(f, "_zedweave_rows", 0) for f in self.logs.get(node, [])) >= LARGE

    def state(self, node: Node) -> Frame:
        """The relation before this step."""
        log = self.logs.get(node)
        return union(log) if log else None

    def new_state(self, node: Node) -> Frame:
        parts = [x for x in (self.state(node), self.delta(node)) if x is not None]
        return union(parts) if parts else None

    def met(self, node: Node, names: list[str], d: DataFrame, by: list[str], new: bool = False) -> Frame:
        """state (new: new_state), perhaps without rows whose `names` are like no row's `by` of d.

        Where a large state meets few keys these are pushed to its scan, which skips the pages of sorted files without them.
        """
        held = self.state(node)
        if held is not None and names and sum(getattr(f, "_zedweave_rows", 0) for f in self.logs[node]) >= LARGE and isinstance(node.schema[names[0]].dataType, LOOKED_UP):
            keys = [r[0] for r in d.select(F.col(f"`{by[0]}`")).distinct().limit(FEW + 1).collect()]
            if len(keys) <= FEW:
                known, c = sorted(k for k in keys if k is not None), F.col(f"`{names[0]}`")
                some = F.lit(False) if len(known) == len(keys) else c.isNull()
                for k in range(0, len(known), AT_ONCE):
                    some = some | c.isin(known[k : k + AT_ONCE])
                held = held.where(some)
        parts = [x for x in (held, self.delta(node) if new else None) if x is not None]
        return union(parts) if parts else None

    def fed(self, variable: Variable) -> Frame:
        return self.feed.get(variable)

    def entered(self, node: Enter) -> Frame:
        if not self.entering:
            return None
        return self.at.outer.frame(node.deps[0]) if self.last < 0 or self.outer is None else self.outer.delta(node.deps[0])

    def entered_grows(self, node: Enter) -> bool:
        if not self.entering:
            return True
        return self.last >= 0 and self.outer is not None and self.outer.grows(node.deps[0]) or self.measured(node)

    def left(self, node: Leave) -> Frame:
        """What a scope's relation changes by in this step."""
        scope = node.deps[0].scope
        if not self.scope_changed(scope):
            return None
        if self.scope.parent is None:
            if scope not in self.loops:
                from zedweave.plans.fixpoint import Loop

                self.loops[scope] = Loop(scope, self, [n.deps[0] for n in self.reachable if isinstance(n, Leave) and n.deps[0].scope is scope])
            return self.loops[scope].changes(node.deps[0])
        # inside another scope's rounds: computed afresh and compared with the round before
        new, old = self.store.save(consolidated(self.at.frame(node), node.weights)), self.results.get(node)
        self.results[node] = new
        return new if old is None else consolidated(new.unionByName(old.withColumns(node.weights.negated())), node.weights)

    def scope_changed(self, scope: Scope) -> bool:
        return self.last < 0 or any(self.delta(n) is not None for n in self.enters(scope))

    # steps

    def advance(self, step: int, at: Snapshot, before: Snapshot, feed: dict[Variable, Frame] | None = None, growing: set[Node] = frozenset()) -> dict[Node, Frame]:
        """The targets' changes from the last step to this one, saved. before: the snapshot of the last step; feed: the
        variables' changes, growing: those of positive weights only."""
        self.step, self.at, self.before, self.feed, self.growing, self.now, self.signs = step, at, before, feed or {}, growing, {}, {}
        out = {}
        for n in self.targets:
            d = self.delta(n)
            if d is not None and n not in self.kept_nodes and self.counts is None:
                d = self.saved(d, n)
            out[n] = d
        for n in list(self.kept_nodes):
            if isinstance(n, Reduce) and n.insertions and n not in self.by_output and n not in self.asked:
                continue  # only its own rule read its output's log
            if (d := self.delta(n)) is not None:
                self.had_grown[n] = self.has_grown(n)
                self.grown[n] = self.had_grown[n] and self.grows(n)
                log = self.logs.setdefault(n, [])
                log.append(d)
                self.logs[n] = self.compacted(log, n)
        self.last = step
        return out

    def seen_to_grow(self, node: Node) -> None:
        """A look at the last step's delta has found positive weights only, which the rules couldn't know."""
        if node in self.grown:
            self.grown[node] = self.had_grown.get(node, False)

    def compacted(self, log: list[DataFrame], node: Node, long: int | None = None) -> list[DataFrame]:
        """A long log with its newest entries merged, as many as aren't much smaller than all after them: so a row
        is written again a logarithmic number of times, and what is old and large stays. Where no rows of the log can be
        equal nothing is written: the files of all entries become one scan, as long as they lie in few folders."""
        unit = node.unit or isinstance(node, Variable) and node.body is not None and node.body.unit
        if len(log) > SHORT and unit and all(getattr(f, "_zedweave_paths", None) and (f._zedweave_least or 0) > 0 for f in log) and sum(len(f._zedweave_paths) for f in log) <= FOLDERS:
            return [self.store.together(log)]
        if len(log) <= (long or LONG):
            return log
        size = lambda f: getattr(f, "_zedweave_rows", 0)
        k, held = len(log) - 1, size(log[-1])
        while k and size(log[k - 1]) <= 2 * held:
            k -= 1
            held += size(log[k])
        if k == len(log) - 1:
            return log
        merged = self.written(consolidated(union(log[k:]), node.weights), node)
        return log[:k] + ([] if merged is None else [merged])
