"""Statements of both languages that change data or schema: each makes a new Graph, the old one stays as it was.

    graph, rows = cypher_change(graph, "MATCH (c:Customer {c_custkey: 1}) SET c.c_name = 'x' RETURN c.c_name AS name")
    graph, rows = sql_script(graph, "UPDATE Customer SET c_acctbal = 0 WHERE c_acctbal < 0; SELECT count(*) AS n FROM Customer")

A change is a DataFrame over the table before: an append is a union, an update
a join, a delete an anti-join. Where several rows set a property of one node,
one of them does. A row that is created without an id gets one beyond the
greatest; such rows are written first, so that the ids stay.
"""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pattern import Graph
from ..storage import written
from .cypher import CypherError, Path, Var, _c, _Query
from .dialect import SqlError, _Sql


def copied(g: Graph) -> Graph:
    return Graph(dict(g.vertices), dict(g.edges), dict(g.ends), dict(g.keys))


def beyond(df: DataFrame, key: str) -> int:
    """The first whole number above all ids."""
    most = df.agg(F.max(F.col(key).cast("long"))).first()[0]
    return 0 if most is None else most + 1


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df, written, with the numbers from 0 on in a column: a row's place in its partition, and how many rows the partitions before have."""
    held = written(df.withColumn("~place", F.monotonically_increasing_id()).withColumn("~part", F.shiftright("~place", 33)))
    before = Window.orderBy("~part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = held.groupBy("~part").agg(F.count("*").alias("~n")).select("~part", F.coalesce(F.sum("~n").over(before), F.lit(0)).alias("~before"))
    return held.join(F.broadcast(parts), "~part").withColumn(column, F.col("~before") + F.col("~place").bitwiseAND(F.lit(2**33 - 1))).drop("~place", "~part", "~before")


def appended(df: DataFrame, new: DataFrame) -> DataFrame:
    """new's columns are cast to those that df has; others are added."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.unionByName(new.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in new.columns]), allowMissingColumns=True)


def updated(df: DataFrame, on: Column | list[str], changes: DataFrame, columns: list[str]) -> DataFrame:
    """df with `=column` of changes (`~id` and these) in the rows whose id (the expression on) is there."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    joined = df.withColumn("~id", on).join(changes.withColumn("~hit", F.lit(True)), "~id", "left")
    new = {c: F.when(F.col("~hit"), _c(f"={c}").cast(kinds[c]) if c in kinds else _c(f"={c}")).otherwise(_c(c) if c in kinds else F.lit(None)) for c in columns}
    return joined.withColumns(new).select(*[_c(c) for c in [*df.columns, *[c for c in columns if c not in kinds]]])


def without_nodes(g: Graph, label: str, ids: DataFrame, detach: bool) -> Graph:
    """g less the nodes of ids (`~id`); their edges go too, or else there must be none."""
    out = copied(g)
    df, key = g.vertices[label]
    out.vertices[label] = (df.join(ids.withColumnRenamed("~id", key), key, "left_anti"), key)
    for t, ends in g.ends.items():
        table, src, dst = g.edges[t]
        left = table
        for side, at in zip((src, dst), ends, strict=True):
            if at == label:
                left = left.join(ids.withColumnRenamed("~id", side), side, "left_anti")
        if label in ends:
            if not detach and left.count() != table.count():
                raise CypherError(f"a node to be deleted still has relationships of type {t}")
            out.edges[t] = (left.select(*table.columns), src, dst)
    return out


class _Changes(_Query):
    def write(self) -> bool:
        if self.take("CREATE"):
            self.create(self.patterns())
        elif self.take("MERGE"):
            self.merge(self.path())
        elif self.take("SET"):
            self.assign(None)
        elif self.take("REMOVE"):
            self.remove()
        elif self.take("DELETE"):
            self.delete(False)
        elif self.take("DETACH"):
            self.need("DELETE")
            self.delete(True)
        elif self.take("FOREACH"):
            self.foreach()
        else:
            return False
        return True

    # creation

    def create(self, paths: list[Path]) -> None:
        self.graph = copied(self.graph)
        rows = numbered(self.current(), "~row")
        fresh = [n for p in paths for n in p.nodes if n.name not in self.scope]
        fresh = [n for k, n in enumerate(fresh) if n.name not in {m.name for m in fresh[:k]}]
        by_label: dict[str, int] = {}
        for n in fresh:
            if len(n.labels) != 1:
                raise CypherError("a node is created with one label")
            by_label[n.labels[0]] = by_label.get(n.labels[0], 0) + 1
        first = {x: beyond(*self.graph.vertices[x]) if x in self.graph.vertices else 0 for x in by_label}
        place = dict.fromkeys(by_label, 0)
        for n in fresh:
            label = n.labels[0]
            df, key = self.graph.vertices.get(label) or (self.spark.createDataFrame([], "id long"), "id")
            own = n.props.get(key)
            if own is None:
                own = F.lit(first[label]) + _c("~row") * by_label[label] + place[label]
            place[label] += 1
            rows = rows.withColumns({n.name: own, f"{n.name}:label": F.lit(label), f"{n.name}.{key}": own, **{f"{n.name}.{k}": v for k, v in n.props.items() if k != key}})
            held = [c for c in rows.columns if c.startswith(f"{n.name}.")]
            self.graph.vertices[label] = (appended(df, rows.select(*[_c(c).alias(c[len(n.name) + 1 :]) for c in held])), key)
            self.scope[n.name] = Var("node", (label,))
        for p in paths:
            for r, a, b in zip(p.rels, p.nodes, p.nodes[1:], strict=False):
                rows = self.linked(rows, r, a.name, b.name)
        self.rows = rows.drop("~row")

    def linked(self, rows: DataFrame, r, a: str, b: str) -> DataFrame:
        """rows with a new relationship each."""
        if len(r.types) != 1 or r.way == "both":
            raise CypherError("a relationship is created with one type and a direction")
        if r.way == "in":
            a, b = b, a
        t, ends = r.types[0], tuple(self.scope[x].labels for x in (a, b))
        if any(len(x) != 1 for x in ends):
            raise CypherError("the ends of a new relationship must have one label each")
        if t in self.graph.edges:
            table, src, dst = self.graph.edges[t]
        else:
            kinds = [rows.schema[x].dataType.simpleString() for x in (a, b)]
            table, src, dst = self.spark.createDataFrame([], f"src {kinds[0]}, dst {kinds[1]}"), "src", "dst"
            self.graph.ends[t] = (ends[0][0], ends[1][0])
        if self.graph.ends[t] != (ends[0][0], ends[1][0]):
            raise CypherError(f"{t} leads from {self.graph.ends[t][0]} to {self.graph.ends[t][1]}")
        new = rows.select(_c(a).alias(src), _c(b).alias(dst), *[v.alias(k) for k, v in r.props.items()])
        self.graph.edges[t] = (appended(table, new), src, dst)
        if r.name.startswith("~"):
            return rows
        self.scope[r.name] = Var("rel", (t,))
        return rows.withColumns({r.name: F.struct(_c(a).alias(src), _c(b).alias(dst)), f"{r.name}:label": F.lit(t), f"{r.name}:from": _c(a), f"{r.name}:to": _c(b), **{f"{r.name}.{k}": v for k, v in r.props.items()}})

    def merge(self, p: Path) -> None:
        """A node by its properties, or a relationship between bound nodes: what isn't there is created; then ON CREATE SET and ON MATCH SET."""
        self.graph = copied(self.graph)
        if not p.rels:
            self.merge_node(p.nodes[0])
        else:
            for n in p.nodes:
                if n.name not in self.scope:
                    self.merge_node(n)
            for r, a, b in zip(p.rels, p.nodes, p.nodes[1:], strict=False):
                self.merge_rel(r, a.name, b.name)
        while self.take("ON"):
            created = self.take("CREATE")
            if not created:
                self.need("MATCH")
            self.need("SET")
            self.assign(_c("~new") if created else ~_c("~new"))
        self.rows = self.current().drop("~new")

    def merge_node(self, n) -> None:
        label = n.labels[0]
        df, key = self.graph.vertices.get(label) or (self.spark.createDataFrame([], T.StructType([T.StructField("id", T.LongType())])), "id")
        for k, v in n.props.items():
            if k not in df.columns:
                df = df.withColumn(k, F.lit(None).cast(self.type_of(v)))
        names = list(n.props)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        rows = written(self.current().withColumns({f"~m.{k}": v.cast(kinds[k]) for k, v in n.props.items()}))
        wanted = rows.select(*[_c(f"~m.{k}").alias(k) for k in names]).distinct() if names else self.spark.range(1).select()
        there = df.select(*names).distinct() if names else df.limit(1).select(F.lit(1).alias("~one"))
        missing = wanted.join(there, names, "left_anti") if names else wanted.withColumn("~one", F.lit(1)).join(there, "~one", "left_anti").drop("~one")
        if key not in names:
            missing = numbered(missing, "~row").withColumn(key, (F.lit(beyond(df, key)) + F.col("~row")).cast(kinds[key])).drop("~row")
        missing = written(missing)
        self.graph.vertices[label] = (appended(df, missing), key)
        fresh = missing.select(_c(key).alias(n.name), F.lit(True).alias("~new"))
        on: Any = [_c(f"~m.{k}") == _c(f"{n.name}.{k}") for k in names]
        found = self.scan(n.name, label).join(fresh, n.name, "left").withColumn("~new", F.coalesce("~new", F.lit(False)))
        rows = rows.drop("~new").join(found, on) if on else rows.drop("~new").crossJoin(found)
        self.rows = rows.drop(*[f"~m.{k}" for k in names])
        self.scope[n.name] = Var("node", (label,))

    def merge_rel(self, r, a: str, b: str) -> None:
        if r.way == "in":
            a, b = b, a
        t = r.types[0]
        rows = written(self.current().drop("~new"))
        pairs = rows.select(_c(a).alias("~a"), _c(b).alias("~b"), *[v.alias(f"~p.{k}") for k, v in r.props.items()]).distinct()
        if t in self.graph.edges:
            table, src, dst = self.graph.edges[t]
            same = [F.col(src) == _c("~a"), F.col(dst) == _c("~b"), *[F.col(k) == _c(f"~p.{k}") for k in r.props if k in table.columns]]
            missing = pairs.join(table, same, "left_anti")
        else:
            table, src, dst, missing = None, "src", "dst", pairs
        missing = written(missing)
        new = missing.select(_c("~a").alias(src), _c("~b").alias(dst), *[_c(f"~p.{k}").alias(k) for k in r.props])
        self.graph.edges[t] = (new if table is None else appended(table, new), src, dst)
        self.graph.ends.setdefault(t, (self.scope[a].labels[0], self.scope[b].labels[0]))
        fresh = missing.select(_c("~a").alias(a), _c("~b").alias(b), F.lit(True).alias("~new")).distinct()
        self.rows = rows.join(fresh, [a, b], "left").withColumn("~new", F.coalesce("~new", F.lit(False)))
        if not r.name.startswith("~"):
            self.rows = self.rows.join(self.edges(((t, False),), a, b, r.name), [a, b])
            self.scope[r.name] = Var("rel", (t,))

    # updates

    def assign(self, where: Column | None) -> None:
        while True:
            name = self.name()
            v = self.scope.get(name)
            if not isinstance(v, Var):
                raise CypherError(f"{name} is no node or relationship")
            if self.take("."):
                key = self.name()
                self.need("=")
                self.put(name, {key: self.expression()}, where)
            else:
                if self.take("+"):
                    self.need("=")
                    keep = True
                else:
                    self.need("=")
                    keep = False
                values = self.properties()
                if not keep:  # all other properties go
                    held = [c for label in v.labels for c in self.table(v, label)[0].columns]
                    ids = {self.table(v, label)[1] for label in v.labels}
                    values = {c: F.lit(None) for c in held if c not in ids} | values
                self.put(name, values, where)
            if not self.take(","):
                return

    def table(self, v: Var, label: str) -> tuple[DataFrame, Any]:
        return self.graph.vertices[label] if v.kind == "node" else self.graph.edges[label][:1] + (None,)

    def put(self, name: str, values: dict[str, Column], where: Column | None) -> None:
        v = self.scope[name]
        self.graph = copied(self.graph)
        rows = written(self.current().withColumns({f"~v.{k}": x for k, x in values.items()}))
        chosen = rows.filter(_c(name).isNotNull())
        chosen = chosen.filter(where) if where is not None else chosen
        for label in v.labels:
            own = chosen.filter(_c(f"{name}:label") == label).groupBy(_c(name).alias("~id")).agg(*[F.any_value(_c(f"~v.{k}")).alias(f"={k}") for k in values])
            if v.kind == "node":
                df, key = self.graph.vertices[label]
                self.graph.vertices[label] = (updated(df, F.col(key), own, list(values)), key)
            else:
                df, src, dst = self.graph.edges[label]
                keys = self.graph.keys.get(label, (src, dst))
                self.graph.edges[label] = (updated(df, F.col(keys[0]) if len(keys) == 1 else F.struct(*keys), own, list(values)), src, dst)
        hit = F.lit(True) if where is None else where
        held = set(rows.columns)
        self.rows = rows.withColumns({f"{name}.{k}": F.when(hit, _c(f"~v.{k}")).otherwise(_c(f"{name}.{k}") if f"{name}.{k}" in held else F.lit(None)) for k in values}).drop(*[f"~v.{k}" for k in values])

    def remove(self) -> None:
        while True:
            name = self.name()
            self.need(".")
            key = self.name()
            labels = [x for x in self.scope[name].labels if key in self.table(self.scope[name], x)[0].columns]
            if labels:
                kind = self.table(self.scope[name], labels[0])[0].schema[key].dataType
                self.put(name, {key: F.lit(None).cast(kind)}, None)
            if not self.take(","):
                return

    def delete(self, detach: bool) -> None:
        while True:
            name = self.name()
            v = self.scope.get(name)
            if not isinstance(v, Var):
                raise CypherError(f"{name} is no node or relationship")
            rows = written(self.current())
            for label in v.labels:
                ids = rows.filter((_c(f"{name}:label") == label) & _c(name).isNotNull()).select(_c(name).alias("~id")).distinct()
                if v.kind == "node":
                    self.graph = without_nodes(self.graph, label, ids, detach)
                else:
                    self.graph = copied(self.graph)
                    df, src, dst = self.graph.edges[label]
                    keys = self.graph.keys.get(label, (src, dst))
                    on = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
                    self.graph.edges[label] = (df.withColumn("~id", on).join(ids, "~id", "left_anti").select(*df.columns), src, dst)
            self.rows = rows
            if not self.take(","):
                return

    def foreach(self) -> None:
        """FOREACH (x IN list | clauses): the clauses for each item of each row."""
        self.need("(")
        name = self.name()
        self.need("IN")
        v = self.expression()
        self.need("|")
        rows, scope = written(self.current()), dict(self.scope)
        self.rows = rows.withColumn(name, F.explode(v))
        self.scope[name] = _c(name)
        while self.write():
            pass
        self.need(")")
        self.rows, self.scope = rows, scope


def cypher_change(graph: Graph, text: str, **params: Any) -> tuple[Graph, DataFrame]:
    """The graph after a query that changes it, and the query's rows."""
    q = _Changes(graph, text, params)
    out = q.run()
    return q.graph, out


_KINDS = {"STRING": "string", "INTEGER": "int", "LONG": "long", "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "boolean", "SHORT": "short", "BYTE": "byte", "DATE": "date", "DATETIME": "timestamp", "DECIMAL": "decimal(38,10)", "BINARY": "binary", "LIST": "array<string>"}


class _SqlChange(_Sql):
    """One statement at a time; self.graph is what they have made of the graph."""

    views: dict[str, str]

    def table(self, name: str) -> tuple[str, DataFrame, str | None]:
        """(kind, rows, id column)"""
        if name in self.graph.vertices:
            return "vertex", *self.graph.vertices[name]
        if name in self.graph.edges:
            return "edge", self.graph.edges[name][0], None
        raise SqlError(f"there is no type {name}")

    def store(self, name: str, df: DataFrame) -> None:
        self.graph = copied(self.graph)
        if name in self.graph.edges:
            self.graph.edges[name] = (df, *self.graph.edges[name][1:])
        else:
            self.graph.vertices[name] = (df, self.graph.vertices[name][1])

    def change(self) -> DataFrame | None:
        """Run a statement; rows if it reads, or counts what it did."""
        self.clear()
        if self.peek("SELECT", "TRAVERSE", "MATCH"):
            return self.statement()
        word = self.next().upper()
        if word in ("INSERT", "CREATE", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "MOVE", "REFRESH", "EXPLAIN", "PROFILE", "SLEEP", "RETURN"):
            return getattr(self, f"do_{word.lower()}")()
        raise SqlError(f"a statement expected, not {word}")

    def count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

    # values

    def assignments(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        while True:
            name = self.name()
            more = self.take("+")
            self.need("=")
            v = self.expression()
            out[name] = (F.coalesce(self.scope[name], F.lit(0)) + v) if more else v
            if not self.take(","):
                return out

    def content(self) -> dict[str, Column]:
        """{"key" or key: value, ...}"""
        out: dict[str, Column] = {}
        self.need("{")
        while not self.take("}"):
            key = self.text_of() if self.kind() == "str" else self.name()
            self.need(":")
            out[key] = self.expression()
            self.take(",")
        return out

    def new_rows(self) -> DataFrame:
        """What INSERT or CREATE VERTEX adds."""
        one = self.spark.range(1).select()
        if self.take("SET"):
            return one.select(*[v.alias(k) for k, v in self.assignments().items()])
        if self.take("CONTENT"):
            return one.select(*[v.alias(k) for k, v in self.content().items()])
        if self.take("FROM") or self.peek("SELECT"):
            self.need("(") if not self.peek("SELECT") else None
            inner = _Sql(self.graph, "", self.params)
            inner.toks, inner.i = self.toks, self.i
            rows = inner.statement()
            self.i = inner.i
            self.take(")")
            return rows
        self.need("(")
        names = []
        while not self.take(")"):
            names.append(self.name())
            self.take(",")
        self.need("VALUES")
        out: DataFrame | None = None
        while True:
            self.need("(")
            values = self.arguments()
            row = one.select(*[v.alias(n) for n, v in zip(names, values, strict=True)])
            out = row if out is None else out.unionByName(row)
            if not self.take(","):
                return out

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        kind, df, key = self.table(name)
        rows = written(rows)
        if kind == "vertex" and key not in rows.columns:
            rows = written(numbered(rows, "~row").withColumn(key, F.lit(beyond(df, key)) + F.col("~row")).drop("~row"))
        self.store(name, appended(df, rows))
        return self.count(rows.count())

    def do_insert(self) -> DataFrame:
        self.need("INTO")
        name = self.name()
        return self.add(name, self.new_rows())

    def do_create(self) -> DataFrame:
        kind = self.next().upper()
        if kind in ("VERTEX", "EDGE", "DOCUMENT") and self.take("TYPE"):
            name = self.name()
            if self.take("IF"):
                self.need("NOT")
                self.need("EXISTS")
                if name in self.graph.vertices or name in self.graph.edges:
                    return self.count(0)
            if name in self.graph.vertices or name in self.graph.edges:
                raise SqlError(f"{name} exists")
            self.graph = copied(self.graph)
            base: DataFrame | None = None
            if self.take("EXTENDS"):
                base = self.table(self.name())[1].limit(0)
            if kind == "EDGE":
                self.need("FROM")
                a = self.name()
                self.need("TO")
                b = self.name()
                kinds = [self.graph.vertices[x][0].schema[self.graph.vertices[x][1]].dataType.simpleString() for x in (a, b)]
                self.graph.edges[name] = (self.spark.createDataFrame([], f"src {kinds[0]}, dst {kinds[1]}"), "src", "dst")
                self.graph.ends[name] = (a, b)
            else:
                self.graph.vertices[name] = (self.spark.createDataFrame([], "id long") if base is None else base, "id" if base is None else self.graph.vertices[self.toks[self.i - 1][1].strip("`")][1])
            return self.count(1)
        if kind == "VERTEX":
            name = self.name()
            return self.add(name, self.new_rows())
        if kind == "EDGE":
            return self.create_edge()
        if kind == "PROPERTY":
            name = self.name()
            self.need(".")
            key = self.name()
            _, df, _ = self.table(name)
            self.store(name, df.withColumn(key, F.lit(None).cast(_KINDS[self.name().upper()])) if key not in df.columns else df)
            return self.count(1)
        if kind == "MATERIALIZED":
            self.need("VIEW")
            name = self.name()
            self.need("AS")
            start = self.i
            rows = self.statement_at()
            self.views[name] = " ".join(t for _, t in self.toks[start : self.i])
            self.graph = copied(self.graph)
            self.graph.vertices[name] = (written(rows), rows.columns[0])
            return self.count(1)
        raise SqlError(f"CREATE {kind} isn't known")

    def statement_at(self) -> DataFrame:
        inner = _Sql(self.graph, "", self.params)
        inner.toks, inner.i = self.toks, self.i
        rows = inner.statement()
        self.i = inner.i
        return rows

    def create_edge(self) -> DataFrame:
        """CREATE EDGE T FROM (SELECT ...) TO (SELECT ...) [IF NOT EXISTS] [SET ...]: each of the first to each of the second, which are few."""
        name = self.name()
        ends = []
        for word in ("FROM", "TO"):
            self.need(word)
            self.need("(")
            label = next(t.strip("`") for k, (_, t) in enumerate(self.toks[self.i :], self.i) if self.toks[k - 1][1].upper() == "FROM")
            rows = self.statement_at()
            self.need(")")
            ends.append((label, rows.select(F.col(self.graph.vertices[label][1]))))
        table, src, dst = self.graph.edges[name]
        if self.graph.ends[name] != (ends[0][0], ends[1][0]):
            raise SqlError(f"{name} leads from {self.graph.ends[name][0]} to {self.graph.ends[name][1]}")
        new = ends[0][1].toDF(src).crossJoin(ends[1][1].toDF(dst))
        if self.take("IF"):
            self.need("NOT")
            self.need("EXISTS")
            new = new.join(table, [src, dst], "left_anti")
        if self.take("SET"):
            new = new.select("*", *[v.alias(k) for k, v in self.assignments().items()])
        new = written(new)
        self.store(name, appended(table, new))
        return self.count(new.count())

    def do_update(self) -> DataFrame:
        """UPDATE T [SET a = x, b += y] [REMOVE c] [MERGE {...}] [CONTENT {...}] [UPSERT] [WHERE condition]."""
        name = self.name()
        kind, df, key = self.table(name)
        self.open(df, name if kind == "vertex" else None)
        values: dict[str, Column] = {}
        upsert = False
        while True:
            if self.take("SET"):
                values |= self.assignments()
            elif self.take("REMOVE"):
                while True:
                    values[self.name()] = F.lit(None)
                    if not self.take(","):
                        break
            elif self.take("MERGE"):
                values |= self.content()
            elif self.take("CONTENT"):
                values |= {c: F.lit(None) for c in df.columns if c != key} | self.content()
            elif self.take("UPSERT"):
                upsert = True
            else:
                break
        start = self.i + 1
        where = self.expression() if self.take("WHERE") else F.lit(True)
        end = self.i
        hit = F.coalesce(where, F.lit(False))
        rows = self.current().withColumn("~hit", hit)
        n = rows.filter("`~hit`").count()
        if upsert and not n:
            self.i = start
            given = {}
            while self.i < end:  # the equalities of the condition
                k = self.name()
                self.need("=")
                given[k] = self.sum()
                self.take("AND")
            self.i = end
            return self.add(name, self.spark.range(1).select(*[v.alias(k) for k, v in (given | values).items()]))
        kinds = {f.name: f.dataType for f in df.schema.fields}
        new = {k: F.when(_c("~hit"), v.cast(kinds[k]) if k in kinds else v).otherwise(_c(k) if k in kinds else F.lit(None)) for k, v in values.items()}
        self.store(name, rows.withColumns(new).select(*[_c(c) for c in [*df.columns, *[k for k in values if k not in kinds]]]))
        return self.count(n)

    def do_delete(self) -> DataFrame:
        """DELETE FROM T | DELETE VERTEX T | DELETE EDGE T, with [WHERE condition]; edges go with their vertices."""
        self.take("FROM", "VERTEX", "EDGE")
        self.take("FROM")
        name = self.name()
        kind, df, key = self.table(name)
        self.open(df, name if kind == "vertex" else None)
        where = F.coalesce(self.expression(), F.lit(False)) if self.take("WHERE") else F.lit(True)
        rows = self.current()
        n = rows.filter(where).count()
        if kind == "vertex":
            self.graph = without_nodes(self.graph, name, written(rows.filter(where).select(F.col(key).alias("~id"))), True)
        else:
            self.store(name, rows.filter(~where).select(*df.columns))
        return self.count(n)

    def do_drop(self) -> DataFrame:
        kind = self.next().upper()
        if kind == "PROPERTY":
            name = self.name()
            self.need(".")
            _, df, _ = self.table(name)
            self.store(name, df.drop(self.name()))
            return self.count(1)
        if kind == "MATERIALIZED":
            self.need("VIEW")
        elif kind != "TYPE":
            raise SqlError(f"DROP {kind} isn't known")
        name = self.name()
        self.table(name)
        self.graph = copied(self.graph)
        for held in (self.graph.vertices, self.graph.edges, self.graph.ends, self.graph.keys, self.views):
            held.pop(name, None)
        return self.count(1)

    def do_truncate(self) -> DataFrame:
        self.take("TYPE")
        name = self.name()
        _, df, _ = self.table(name)
        n = df.count()
        self.store(name, df.limit(0))
        return self.count(n)

    def do_alter(self) -> DataFrame:
        """ALTER PROPERTY T.p NAME q | TYPE kind."""
        self.need("PROPERTY")
        name = self.name()
        self.need(".")
        key = self.name()
        _, df, _ = self.table(name)
        if self.take("NAME"):
            self.store(name, df.withColumnRenamed(key, self.name()))
        else:
            self.need("TYPE")
            self.store(name, df.withColumn(key, F.col(key).try_cast(_KINDS[self.name().upper()])))
        return self.count(1)

    def do_move(self) -> DataFrame:
        """MOVE VERTEX (SELECT ...) TO TYPE:T: of another type from now on; their edges go."""
        self.need("VERTEX")
        self.need("(")
        label = next(t.strip("`") for k, (_, t) in enumerate(self.toks[self.i :], self.i) if self.toks[k - 1][1].upper() == "FROM")
        rows = written(self.statement_at())
        self.need(")")
        self.need("TO")
        self.need("TYPE")
        self.need(":")
        name = self.name()
        key = self.graph.vertices[label][1]
        self.graph = without_nodes(self.graph, label, rows.select(F.col(key).alias("~id")), True)
        return self.add(name, rows if key == self.graph.vertices[name][1] else rows.drop(key))

    def do_refresh(self) -> DataFrame:
        self.need("MATERIALIZED")
        self.need("VIEW")
        name = self.name()
        inner = _Sql(self.graph, self.views[name], self.params)
        rows = inner.statement()
        self.graph = copied(self.graph)
        self.graph.vertices[name] = (written(rows), rows.columns[0])
        return self.count(1)

    def do_explain(self) -> DataFrame:
        rows = self.statement_at()
        plan = rows._jdf.queryExecution().toString()
        return self.spark.createDataFrame([(plan,)], "executionPlan string")

    def do_profile(self) -> DataFrame:
        start = time.monotonic()
        n = self.statement_at().count()
        return self.spark.createDataFrame([(n, time.monotonic() - start)], "rows long, seconds double")

    def do_sleep(self) -> DataFrame:
        time.sleep(self.number() / 1000)
        return self.count(0)

    def do_return(self) -> DataFrame:
        if self.peek("SELECT"):
            return self.statement_at()
        self.open(self.spark.range(1).select(F.lit(1).alias("~one")), None)
        return self.current().select(self.expression().alias("value"))


def sql_script(graph: Graph, text: str, **params: Any) -> tuple[Graph, DataFrame]:
    """The graph after the statements, parted by semicolons, and the rows of the last one.

    BEGIN marks a state that ROLLBACK goes back to, COMMIT ends that. IF
    (condition) { statements } runs them if the condition, of parameters and
    constants, holds. RETURN ends the script.
    """
    q = _SqlChange(graph, text, params)
    q.views = {}
    marks: list[Graph] = []
    out: DataFrame | None = None
    closing = 0

    def skip() -> None:
        depth = 0
        while True:
            depth += {"{": 1, "}": -1}.get(q.next(), 0)
            if not depth:
                return

    while q.i < len(q.toks):
        if q.take(";"):
            continue
        if closing and q.take("}"):
            closing -= 1
            continue
        if q.take("BEGIN"):
            marks.append(q.graph)
        elif q.take("COMMIT"):
            marks = []
        elif q.take("ROLLBACK"):
            q.graph = marks.pop() if marks else graph
        elif q.take("IF"):
            q.need("(")
            q.open(q.spark.range(1).select(F.lit(1).alias("~one")), None)
            holds = q.current().select(q.expression().alias("v")).first()["v"]
            q.need(")")
            if holds:
                q.need("{")
                closing += 1
            else:
                skip()
        else:
            ends = q.peek("RETURN")
            out = q.change()
            if ends:
                break
    return q.graph, out if out is not None else q.count(0)
