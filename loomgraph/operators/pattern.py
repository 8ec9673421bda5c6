"""Graph patterns over typed vertex and edge tables, compiled to joins.

A pattern is a chain: a node, then hops. Node tables that a pattern neither
filters nor reads aren't joined at all, filters go to the scans, and Catalyst
chooses the joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


@dataclass
class Graph:
    """vertices: label to table with its id column; edges: type to table with its ends' columns; ends: type to its ends' labels; keys: type to the columns that tell its edges apart, the ends' if not given."""

    vertices: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    edges: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def nodes(self, label: str, alias: str) -> DataFrame:
        """Nodes as id column `alias` and struct `alias_`."""
        df, key = self.vertices[label]
        return df.select(F.col(key).alias(alias), F.struct("*").alias(f"{alias}_"))


class Match:
    """A pattern under construction; every step returns a new one. Rows have an id column for each alias and, once asked for, a struct `alias_` of its properties."""

    def __init__(self, graph: Graph, rows: DataFrame, optional: bool = False):
        self.graph, self.rows = graph, rows

    @staticmethod
    def node(graph: Graph, alias: str, label: str, where: Column | None = None) -> Match:
        rows = graph.nodes(label, alias)
        return Match(graph, rows.filter(where) if where is not None else rows)

    def hop(self, a: str, edge: str, b: str, *, reverse: bool = False, alias: str | None = None, where: Column | None = None, optional: bool = False) -> Match:
        """From alias a along an edge type to alias b. If b is bound already, the edge must lead there (expand into)."""
        df, src, dst = self.graph.edges[edge]
        if reverse:
            src, dst = dst, src
        if where is not None:
            df = df.filter(where)
        held = df.select(F.col(src).alias(a), F.col(dst).alias(b), *([F.struct("*").alias(f"{alias}_")] if alias else []))
        on = [a, b] if b in self.rows.columns else [a]
        return Match(self.graph, self.rows.join(held, on, "left" if optional else "inner"))

    def read(self, alias: str, label: str, where: Column | None = None, optional: bool = False) -> Match:
        """Join the properties of a bound alias."""
        nodes = self.graph.nodes(label, alias)
        return Match(self.graph, self.rows.join(nodes.filter(where) if where is not None else nodes, alias, "left" if optional else "inner"))

    def exists(self, a: str, edge: str, *, reverse: bool = False, where: Column | None = None, negate: bool = False) -> Match:
        """Keep rows whose alias has (or, negated, hasn't) such an edge."""
        df, src, dst = self.graph.edges[edge]
        df = df.filter(where) if where is not None else df
        return Match(self.graph, self.rows.join(df.select(F.col(dst if reverse else src).alias(a)), a, "left_anti" if negate else "left_semi"))

    def filter(self, where: Column) -> Match:
        return Match(self.graph, self.rows.filter(where))


def traverse(edges: DataFrame, start: DataFrame, most: int, both: bool = False) -> DataFrame:
    """id and depth of what start (id) reaches in `most` hops along edges (src, dst), each at its least depth.

    Breadth first, a join a level against what hasn't been seen yet.
    """
    step = edges.select("src", "dst")
    if both:
        step = step.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = step.distinct()
    seen = written(start.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, most + 1):
        new = front.select(F.col("id").alias("src")).join(step, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = written(new.withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, start: DataFrame, least: int, most: int) -> DataFrame:
    """Trails of least to most hops from start (id), no edge twice: columns nodes, rels, length. edges: id, src, dst."""
    now = start.select(F.array("id").alias("nodes"), F.array().cast("array<bigint>").alias("rels"))
    out = now.filter(F.lit(least == 0))
    step = edges.select(F.col("id").cast("long").alias("_e"), F.col("src").alias("_s"), F.col("dst").alias("_d"))
    for n in range(1, most + 1):
        now = now.join(step, F.element_at("nodes", -1) == F.col("_s")).filter(~F.array_contains("rels", F.col("_e")))
        now = now.select(F.array_append("nodes", F.col("_d")).alias("nodes"), F.array_append("rels", F.col("_e")).alias("rels"))
        if n >= least:
            out = out.unionByName(now)
    return out.withColumn("length", F.size("rels"))
