"""Weighted standing relations on Spark."""

from zedweave.operators.outputs import Arrangement, Mapping, ReduceOutput
from zedweave.operators.relation import Relation
from zedweave.plans.context import Builder, Finalizer, Session, SubContext, VariableHandle
from zedweave.plans.fixpoint import NoFixpoint
from zedweave.plans.nodes import ContextMismatch
from zedweave.plans.weights import INTEGER, WeightType
from zedweave.sources.inputs import Input

__all__ = ["INTEGER", "Arrangement", "Builder", "ContextMismatch", "Finalizer", "Input", "Mapping", "NoFixpoint", "ReduceOutput", "Relation", "Session", "SubContext", "VariableHandle", "WeightType"]
