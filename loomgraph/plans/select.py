"""Selections built by calls instead of text, compiled to one DataFrame.

    select(graph).from_type("Customer").where().property("c_acctbal").gt().parameter("least").and_().property("c_name").like().value("C%").order_by("c_acctbal", False).limit(5).compile().bind(least=9000).rows()

`and_` binds closer than `or_`; a block is a condition in brackets. Comparisons
have two values, as in the SQL dialect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.pattern import Graph
from ..operators.search import nearest

Value = Callable[[dict[str, Any]], Column]
_OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": P.eq, "neq": P.ne, "lt": P.lt, "le": P.le, "gt": P.gt, "ge": P.ge, "like": lambda a, b: P.like(a, b), "ilike": lambda a, b: P.like(a, b, ignore_case=True), "in_": lambda a, b: P.is_in(a, b),
    "between": lambda a, b: P.between(a, F.lit(b[0]), F.lit(b[1])), "contains_text": lambda a, b: P.contains_text(a, F.lit(b)),
}
_RAW = ("like", "ilike", "in_", "between", "contains_text")


@dataclass(frozen=True)
class Condition:
    """Operands, operators and connectives in the order they were called."""

    parts: tuple = ()

    def _plus(self, *parts) -> Condition:
        return replace(self, parts=(*self.parts, *parts))

    def property(self, name: str):
        return self._plus(("value", lambda p: F.col(f"`{name}`")))

    def value(self, v: Any):
        return self._plus(("raw", lambda p: v))

    def parameter(self, name: str):
        return self._plus(("raw", lambda p: p[name]))

    def is_null(self):
        return self._plus(("null", False))

    def is_not_null(self):
        return self._plus(("null", True))

    def and_(self):
        return self._plus(("and", None))

    def or_(self):
        return self._plus(("or", None))

    def not_(self):
        return self._plus(("not", None))

    def block(self, inner: Callable[[Condition], Condition]):
        """A condition in brackets."""
        return self._plus(("block", inner(Condition())))

    def column(self, params: dict[str, Any]) -> Column:
        parts = list(self.parts)

        def operand(kind: str, v: Any, raw: bool) -> Any:
            x = v(params)
            return x if kind == "value" or raw else F.lit(x)

        def one() -> Column:
            kind, v = parts.pop(0)
            if kind == "not":
                return ~one()
            if kind == "block":
                return v.column(params)
            a = operand(kind, v, False)
            op, x = parts.pop(0)
            if op == "null":
                return a.isNotNull() if x else a.isNull()
            kind, v = parts.pop(0)
            return _OPERATORS[op](a, operand(kind, v, op in _RAW))

        def all_() -> Column:
            out = one()
            while parts and parts[0][0] == "and":
                parts.pop(0)
                out = out & one()
            return out

        out = all_()
        while parts:
            if parts.pop(0)[0] != "or":
                raise ValueError("a condition goes on without and_() or or_()")
            out = out | all_()
        return out


for _name in _OPERATORS:
    setattr(Condition, _name, lambda self, _name=_name: self._plus((_name, None)))


@dataclass(frozen=True)
class Select(Condition):
    graph: Graph | None = None
    types: tuple[str, ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    first: int = 0
    most: int | None = None
    steps: tuple = ()
    near: tuple | None = None
    bound: dict[str, Any] = field(default_factory=dict)

    def from_type(self, *names: str) -> Select:
        return replace(self, types=names)

    def where(self) -> Select:
        return self

    def order_by(self, name: str, up: bool = True) -> Select:
        return replace(self, orders=(*self.orders, (name, up)))

    def skip(self, n: int) -> Select:
        return replace(self, first=n)

    def limit(self, n: int) -> Select:
        return replace(self, most=n)

    def out(self, *types: str) -> Select:
        return replace(self, steps=(*self.steps, ("out", types, False)))

    def into(self, *types: str) -> Select:
        return replace(self, steps=(*self.steps, ("in", types, False)))

    def both(self, *types: str) -> Select:
        return replace(self, steps=(*self.steps, ("both", types, False)))

    def out_edges(self, *types: str) -> Select:
        return replace(self, steps=(*self.steps, ("out", types, True)))

    def in_edges(self, *types: str) -> Select:
        return replace(self, steps=(*self.steps, ("in", types, True)))

    def nearest_to(self, vector: str, target: list[float], k: int) -> Select:
        """The k rows whose vectors are nearest to the target, with `distance`, of those that the condition keeps."""
        return replace(self, near=(vector, target, k))

    def compile(self) -> Select:
        """The selection itself: nothing of it depends on parameters before rows()."""
        return self

    def bind(self, **params: Any) -> Select:
        return replace(self, bound=self.bound | params)

    def rows(self) -> DataFrame:
        out: DataFrame | None = None
        for t in self.types:
            df = self.graph.vertices[t][0] if t in self.graph.vertices else self.graph.edges[t][0]
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if self.parts:
            out = out.filter(self.column(self.bound))
        label = self.types[0]
        for way, types, edge in self.steps:
            out, label = self._step(out, label, way, types, edge)
        if self.near:
            vector, target, k = self.near
            key = self.graph.vertices[label][1]
            out = out.join(F.broadcast(nearest(out, key, vector, target, k)), key)  # k rows
        if self.orders:
            out = out.orderBy(*[F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in self.orders])
        if self.first:
            out = out.offset(self.first)
        return out if self.most is None else out.limit(self.most)

    def count(self) -> int:
        return self.rows().count()

    def _step(self, rows: DataFrame, label: str, way: str, types: tuple[str, ...], edge: bool) -> tuple[DataFrame, str]:
        """What a step from the vertices of rows leads to: an edge or a vertex for each way there."""
        key = self.graph.vertices[label][1]
        ids, out, far = rows.select(F.col(key).alias("~from")), None, label
        for t in types or tuple(self.graph.edges):
            df, src, dst = self.graph.edges[t]
            for near, other, at, to in ((src, dst, *self.graph.ends[t]), (dst, src, *self.graph.ends[t][::-1])):
                if at != label or (way == "out" and near != src) or (way == "in" and near != dst):
                    continue
                met = df.join(ids, F.col(near) == F.col("~from"))
                if edge:
                    one = met.select(*df.columns)
                else:
                    table, own = self.graph.vertices[to]
                    one = table.join(met.select(F.col(other).alias("~to")), F.col(own) == F.col("~to")).select(*table.columns)
                out, far = one if out is None else out.unionByName(one, allowMissingColumns=True), t if edge else to
        if out is None:
            raise ValueError(f"no relationship of {types} leads from {label}")
        return out, far


def select(graph: Graph) -> Select:
    return Select(graph=graph)
