"""Recursive scopes: rounds of changes until nothing changes.

Round i turns the changes of the variables into the changes of the relations that define them, with the
rules of the delta evaluation; the variables pass through the same contents as when the bodies are computed
anew from empty variables in each round. For a well-tiered scope, in which rows of a tier depend on rows
of lower tiers only, that ends in its one solution, also with retractions and non-monotone bodies.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from zedweave.plans.delta import LONG, DeltaRun
from zedweave.plans.nodes import AntiJoin, Concat, Enter, Frame, Join, Linear, Node, Reduce, Triangles, Variable
from zedweave.plans.weights import consolidated, union

if TYPE_CHECKING:
    from zedweave.plans.context import Scope
    from zedweave.plans.snapshot import Snapshot
    from zedweave.plans.store import Store


class NoFixpoint(RuntimeError):
    """A scope still changes after its largest number of rounds."""


class Rounds:
    """The rounds of a scope, from empty variables and then on from one fixpoint to the next.

    leaving: relations whose changes are wanted besides the bodies'. outer: the run over the parent scope, if its changes
    will come in later.
    """

    def __init__(self, scope: Scope, store: Store, leaving: list[Node] = (), outer: DeltaRun | None = None):
        self.scope, self.number = scope, 0
        self.positive = True  # whether nothing but positive weights has come in from outside
        self.variables = [v for v in scope.variables if v.body is not None]
        self.logs: dict[Variable, list[DataFrame]] = {v: [] for v in self.variables}
        self.shrank: set[Variable] = set()  # those of which rows may have been taken away
        self.targets = list(dict.fromkeys([*(v.body for v in self.variables), *leaving]))
        self.run = DeltaRun(store, self.targets, outer=outer) if self.targets else None

    def bindings(self) -> dict[Variable, DataFrame]:
        return {v: union(log) for v, log in self.logs.items() if log}

    def settle(self, before: Snapshot, after: Snapshot) -> dict[Node, list[DataFrame]]:
        """Goes on until nothing changes; before, after: the parent scope's contents. Returns the targets' changes."""
        changes: dict[Node, list[DataFrame]] = {n: [] for n in self.targets}
        feed: dict[Variable, DataFrame] = {}
        growing: set[Variable] = set()
        done, self.run.entering = 0, True
        while self.targets:
            # the variables of the round before, and of this one
            was = (after if done else before).inner(self.bindings())
            for v, d in feed.items():
                self.logs[v].append(d)
                self.logs[v] = self.run.compacted(self.logs[v], v.body, LONG)
            out = self.run.advance(self.number, after.inner(self.bindings()), was, feed, growing)
            if not done and self.run.outer is not None:
                self.positive = self.positive and all(self.run.grows(n) for n in self.run.reachable if isinstance(n, Enter) and n.scope is self.scope)
            self.number, done, self.run.entering = self.number + 1, done + 1, False
            for n, d in out.items():
                if d is not None:
                    changes[n].append(d)
                if d is None or d._zedweave_least is not None and d._zedweave_least > 0:
                    self.run.seen_to_grow(n)
            feed = {}
            for v in self.variables:
                if (d := out[v.body]) is not None:
                    feed[v] = d.select(*v.columns, *v.weights.names)
                    feed[v]._zedweave_rows, feed[v]._zedweave_least, feed[v]._zedweave_paths = d._zedweave_rows, d._zedweave_least, d._zedweave_paths
            self.shrank |= {v for v in feed if not (out[v.body]._zedweave_least or 0) > 0}
            growing = {v for v in feed if (out[v.body]._zedweave_least or 0) > 0}
            if not feed:
                break
            if done >= self.scope.max_rounds:
                raise NoFixpoint(f"the scope still changes after {done} rounds; are its tiers right?")
        return changes


class Fixpoint:
    """A scope's fixpoint, from empty variables, over a snapshot of the parent scope."""

    def __init__(self, scope: Scope, outer: Snapshot):
        self.scope = scope
        rounds = Rounds(scope, outer.session.store)
        if rounds.variables:
            rounds.settle(outer, outer)
        self.rounds = rounds.number
        # rows that came in once and never left are merged already
        self.final = {v: union(log) if v.body.unit and v not in rounds.shrank else consolidated(union(log), v.weights) for v, log in rounds.logs.items() if log}
        self.inner = outer.inner(self.final)

    def result(self, node: Node) -> DataFrame:
        for v in self.scope.variables:
            if node is v or node is v.body:
                return self.final[v].select(*node.columns, *node.weights.names) if v in self.final else node.empty()
        return self.inner.frame(node)


class Loop:
    """A scope maintained over the steps of the run of its parent scope.

    Insertions go on from the fixpoint of the step before, where the scope is monotone in what has changed: iteration from there ends
    where iteration from empty variables does, and costs what follows from the insertions only. After a retraction rows
    might keep each other alive, so that the scope starts afresh and the difference of its results is taken.
    """

    def __init__(self, scope: Scope, outer: DeltaRun, leaving: list[Node]):
        self.scope, self.outer = scope, outer
        self.leaving = [n.body if isinstance(n, Variable) and n.body is not None else n for n in leaving]
        self.rounds: Rounds | None = None
        self.held: dict[Node, list[DataFrame]] = {}
        self.step, self.out, self.afresh = -1, {}, 0

    def changes(self, node: Node) -> Frame:
        if self.step < self.outer.step:
            self.step = self.outer.step
            self._advance()
        if isinstance(node, Variable):
            d = self.out.get(node.body)
            return None if d is None else d.select(*node.columns, *node.weights.names)
        return self.out.get(node)

    def _advance(self) -> None:
        outer = self.outer
        if self.rounds is not None and self._goes_on():
            new = self.rounds.settle(outer.before, outer.at)
            self.out = {n: union(d) for n, d in new.items() if d}
            for n in self.leaving:
                self.held[n] = self._short(self.held.get(n, []) + new[n], n)
            return
        self.rounds, self.afresh = Rounds(self.scope, outer.store, self.leaving, outer), self.afresh + 1
        new, self.out = self.rounds.settle(outer.at, outer.at), {}
        for n in self.leaving:
            old, own = self.held.get(n), self._short(new[n], n)
            self.held[n] = own
            parts = own + ([union(old).withColumns(n.weights.negated())] if old else [])
            if parts:
                self.out[n] = consolidated(union(parts), n.weights) if old else union(parts)

    def _short(self, log: list[DataFrame], node: Node) -> list[DataFrame]:
        return self.rounds.run.compacted(log, node, LONG) if log else log

    def _goes_on(self) -> bool:
        changed = [n for n in self.outer.enters(self.scope) if self.outer.delta(n) is not None]
        seen: dict[Node, bool] = {}

        def moves(n: Node) -> bool:
            """Whether a relation of the scope may have changed in this step."""
            if n not in seen:
                seen[n] = isinstance(n, Variable) or (n.deps[0] in changed if isinstance(n, Enter) else any(map(moves, n.deps)))
            return seen[n]

        def grows(n: Node) -> bool:
            """Whether insertions make its contents grow, or its least or greatest rows go on."""
            if not moves(n) or isinstance(n, (Variable, Enter)):
                return True
            if isinstance(n, AntiJoin):
                return not moves(n.deps[1]) and grows(n.deps[0])
            ok = isinstance(n, Linear) and n.keeps_sign or isinstance(n, (Concat, Triangles)) or isinstance(n, Join) and n.weights.is_integer or isinstance(n, Reduce) and n.insertions is not None
            return ok and all(map(grows, n.deps))

        return self.rounds.positive and all(map(grows, self.rounds.targets)) and all(map(self.outer.inserts, changed))
