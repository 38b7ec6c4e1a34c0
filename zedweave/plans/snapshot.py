"""Evaluation of whole relations at a step: one Spark plan, optimised as a whole by Catalyst."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from zedweave.plans.fixpoint import Fixpoint
from zedweave.plans.nodes import Node, Variable
from zedweave.plans.weights import consolidated

if TYPE_CHECKING:
    from zedweave.plans.context import Scope, Session


class Snapshot:
    """Frames of the nodes of one scope; for an inner scope with its variables bound, and the outer scope's snapshot."""

    def __init__(self, session: Session, step: int, outer: Snapshot | None = None, bindings: dict[Variable, DataFrame] | None = None):
        self.session, self.step, self.outer, self.bindings = session, step, outer, bindings or {}
        self.memo: dict[Node, DataFrame] = {}
        self.fixpoints: dict[Scope, Fixpoint] = {}
        self.persisted: list[DataFrame] = []

    def frame(self, node: Node) -> DataFrame:
        if node not in self.memo:
            df = node.snapshot(self)
            if node.shared:
                df = (df if node.unit else consolidated(df, node.weights)).persist()
                self.persisted.append(df)
            self.memo[node] = df
        return self.memo[node]

    def whole(self, node: Node) -> DataFrame:
        """Consolidated."""
        df = self.frame(node)
        return df if node.unit or node.shared else consolidated(df, node.weights)

    def bound(self, variable: Variable) -> DataFrame:
        return self.bindings[variable] if variable in self.bindings else variable.empty()

    def fixpoint(self, scope: Scope) -> Fixpoint:
        if scope not in self.fixpoints:
            self.fixpoints[scope] = Fixpoint(scope, self)
        return self.fixpoints[scope]

    def release(self) -> None:
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()

    def inner(self, bindings: dict[Variable, DataFrame]) -> Snapshot:
        return Snapshot(self.session, self.step, self, bindings)
