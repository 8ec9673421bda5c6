"""The SQL dialect of multi-model databases, compiled to one DataFrame: SELECT, TRAVERSE and MATCH.

    sql(graph, "SELECT c_name, out('PLACED').size() AS n FROM Customer WHERE c_name LIKE 'A%' ORDER BY n DESC LIMIT 10")
    sql(graph, "MATCH {type: Customer, as: c, where: (c_acctbal > 0)}.out('PLACED'){as: o} RETURN c.c_name AS name, count(*) AS n")

Predicates have two values, null sorts first, a value outside the grouping is
that of some row of the group. Parameters are :name. Scanning of the text,
arithmetic, lists and patterns are those of the Cypher compiler.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates as A
from ..functions import geometry, library  # noqa: F401  geometry enters its functions in the library
from ..functions import lists as L
from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import text as X
from ..operators.pattern import Graph, traverse
from .cypher import CypherError, Node, Path, Rel, Var, _c, _Query

_STEPS = ("OUT", "IN", "BOTH", "OUTE", "INE", "BOTHE")
_END = {"FROM", "LET", "WHERE", "GROUP", "ORDER", "UNWIND", "SKIP", "LIMIT", "UNION"}


class SqlError(CypherError):
    pass


def sql(graph: Graph, text: str, **params: Any) -> DataFrame:
    """The rows of a statement that reads."""
    q = _Sql(graph, text, params)
    out = q.statement()
    q.take(";")
    if q.i < len(q.toks):
        raise SqlError(f"cannot go on at {q.next()!r}")
    return out


def _sorted(v: Column, up: Column | None = None) -> Column:
    return F.sort_array(v) if up is None else F.when(up, F.sort_array(v)).otherwise(F.sort_array(v, False))


_METHODS: dict[str, Callable[..., Column]] = {
    "tolowercase": F.lower, "touppercase": F.upper, "trim": F.trim, "length": lambda s: F.char_length(s.cast("string")).cast("long"), "left": lambda s, n: F.substring(s, F.lit(1), F.greatest(n, F.lit(0))),
    "right": lambda s, n: F.when(n <= 0, F.lit("")).otherwise(F.right(s, n)), "append": lambda s, t: F.concat(s, t.cast("string")), "prefix": lambda s, p: F.concat(p, s), "replace": F.replace, "capitalize": S.capitalize,
    "charat": lambda s, n: F.when((n >= 0) & (n < F.char_length(s)), F.substring(s, n + 1, F.lit(1))), "indexof": lambda s, t: (F.instr(s, t) - 1).cast("long"), "split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
    "substring": lambda s, a, b=None: F.substring(s, a + 1, F.char_length(s) if b is None else F.greatest(b - a, F.lit(0))), "trimprefix": lambda s, p: F.when(F.startswith(s, p), F.substring(s, F.char_length(p) + 1, F.char_length(s))).otherwise(s),
    "trimsuffix": lambda s, p: F.when(F.endswith(s, p), F.substring(s, F.lit(1), F.char_length(s) - F.char_length(p))).otherwise(s), "asstring": lambda x: x.cast("string"), "asinteger": lambda x: x.try_cast("int"), "aslong": lambda x: x.try_cast("long"),
    "asshort": lambda x: x.try_cast("short"), "asbyte": lambda x: x.try_cast("byte"), "asfloat": lambda x: x.try_cast("float"), "asdouble": lambda x: x.try_cast("double"), "asdecimal": lambda x: x.try_cast("decimal(38,10)"),
    "asboolean": lambda x: x.try_cast("boolean"), "asdate": lambda x, f=None: F.to_date(x) if f is None else F.to_date(F.to_timestamp(x, f)), "asdatetime": lambda x, f=None: F.to_timestamp(x) if f is None else F.to_timestamp(x, f), "aslist": F.array,
    "asset": F.array_distinct, "asvector": lambda v: v.cast("array<float>"), "tojson": F.to_json, "asjson": F.to_json, "ifnull": F.coalesce, "ifempty": lambda x, y: F.when(F.length(x.cast("string")) == 0, y).otherwise(x), "sort": _sorted, "remove": L.remove_first,
    "removeall": F.array_remove, "join": lambda v, d=None: F.array_join(v.cast("array<string>"), ","), "keys": F.map_keys, "values": F.map_values, "type": F.typeof, "field": lambda m, k: m[k],
}
_SCALARS: dict[str, Callable[..., Column]] = {
    "ifnull": F.coalesce, "coalesce": F.coalesce, "abs": F.abs, "sqrt": F.sqrt, "squareroot": F.sqrt, "if": lambda c, a, b=None: F.when(c, a) if b is None else F.when(c, a).otherwise(b), "sysdate": F.current_timestamp, "date": lambda *a: F.to_timestamp(*a), "uuid": F.uuid,
    "concat": lambda *a: F.concat(*[x.cast("string") for x in a]), "intersect": F.array_intersect, "difference": F.array_except, "unionall": F.concat, "symmetricdifference": L.symmetric_difference, "distance": lambda *a: S.distance_m(*a) / 1000, "randomint": lambda n: F.floor(F.rand() * n),
    "bytecount": X.byte_count, "upper": F.upper, "lower": F.lower, "round": lambda x, n=None, how=None: library.rounded(None, x, n, how),
}
_GROUPED: dict[str, Callable[..., Column]] = {
    "count": F.count, "sum": A.total, "avg": F.avg, "min": F.min, "max": F.max, "first": F.first, "last": F.last, "list": F.collect_list, "set": F.collect_set, "mode": A.modes, "variance": A.variance, "stddev": A.stddev, "median": lambda x: A.percentile(x, 0.5),
    "bool_or": A.any_true, "bool_and": A.all_true, "ts.first": A.ts_first, "ts.last": A.ts_last, "ts.delta": A.ts_delta, "ts.rate": A.ts_rate, "ts.correlate": A.ts_correlate, "variancep": lambda x: A.variance(x, True), "stddevp": lambda x: A.stddev(x, True),
}
#: Methods that need the types of what they are called on.
_TYPED: dict[str, Callable[..., Column]] = {
    "iswithin": library.SQL["geo.within"], "intersectswith": library.SQL["geo.intersects"], "normalize": library.SQL["normalize"], "asmap": library.as_map, "convert": lambda q, v, kind: v.try_cast({"LONG": "long", "INTEGER": "int", "STRING": "string", "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp"}[str(kind._jc.toString()).strip("'").upper()]),
    "precision": lambda q, v, unit: F.call_function("date_trunc", unit, v), "javatype": lambda q, v: F.lit({"StringType": "java.lang.String", "LongType": "java.lang.Long", "IntegerType": "java.lang.Integer", "DoubleType": "java.lang.Double", "BooleanType": "java.lang.Boolean"}.get(type(q.type_of(v)).__name__, "java.lang.Object")),
    "assparse": lambda q, v, least=None: library.to_sparse(v, least), "include": lambda q, v, *names: F.struct(*[v.getField(n).alias(n) for n in (str(x._jc.toString()).strip("'") for x in names)]),
    "exclude": lambda q, v, *names: F.struct(*[v.getField(f.name).alias(f.name) for f in q.type_of(v).fields if f.name not in [str(x._jc.toString()).strip("'") for x in names]]), "lastindexof": lambda q, s, t: F.when(F.instr(F.reverse(s), F.reverse(t)) == 0, F.lit(-1)).otherwise(F.char_length(s) - F.instr(F.reverse(s), F.reverse(t)) - F.char_length(t) + 1).cast("long"),
}
_BUCKET = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


class _Sql(_Query):
    def read_properties(self, name: str) -> bool:
        return True  # a pattern's end may be expanded

    def number(self) -> int:
        if self.take(":"):
            return int(self.params[self.name()])
        return int(self.next())

    def text_of(self) -> str:
        if self.take(":"):
            return str(self.params[self.name()])
        if self.kind() != "str":
            raise SqlError(f"a text expected, not {self.next()!r}")
        return self.next()[1:-1]

    def statement(self) -> DataFrame:
        self.clear()
        if self.take("SELECT"):
            return self.select()
        if self.take("TRAVERSE"):
            return self.traversal()
        if self.take("MATCH"):
            return self.sql_match()
        raise SqlError(f"SELECT, TRAVERSE or MATCH expected, not {self.next()!r}")

    # sources

    def source(self) -> tuple[DataFrame, str | None]:
        """Rows and the label of what FROM names."""
        if self.take("("):
            inner = _Sql(self.graph, "", self.params)
            inner.toks, inner.i = self.toks, self.i
            rows = inner.statement()
            self.i = inner.i
            self.need(")")
            return rows, None
        name = self.name()
        if name in self.graph.vertices:
            return self.graph.vertices[name][0], name
        if name in self.graph.edges:
            return self.graph.edges[name][0], None
        raise SqlError(f"there is no type {name}")

    def open(self, rows: DataFrame, label: str | None) -> None:
        self.clear()
        self.scope = {c: _c(c) for c in rows.columns}
        if label:
            key = self.graph.vertices[label][1]
            rows = rows.withColumns({"~a": F.col(key), "~a:label": F.lit(label)})
            self.scope["~a"] = Var("node", (label,))
        self.rows = rows

    # SELECT

    def select(self) -> DataFrame:
        start, distinct = self.i, self.take("DISTINCT")
        depth = 0
        while self.i < len(self.toks) and not (depth == 0 and self.peek("FROM")):  # what is selected is read once the columns are known
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(self.toks[self.i][1], 0)
            if depth < 0:
                break
            self.i += 1
        end = self.i
        if self.take("FROM"):
            rows, label = self.source()
        else:
            rows, label = self.spark.range(1).select(F.lit(1).alias("~one")), None
        self.open(rows, label)
        plain = rows.columns
        while self.take("LET") or (self.peek(",") and self.kind(1) == "param" and self.take(",")):
            name = self.next()
            self.need("=")
            self.scope[name] = self.expression()
        if self.take("WHERE"):
            where = self.expression()
            self.rows = self.current().filter(where)
        after, self.i = self.i, start + distinct
        items, opened = self.selected(end, plain)
        self.i = after
        if opened is not None:
            self.rows = opened.distinct() if distinct else opened
            self.scope = {c: _c(c) for c in opened.columns}
            order = opened.columns
        else:
            order = self.grouped(items, distinct)
        if self.take("ORDER"):
            self.order_by({str(v): self.scope[n] for n, v, _ in items})
        while self.take("UNWIND"):
            name = self.name()
            v = self.scope[name]
            assert isinstance(v, Column)
            many = isinstance(self.type_of(v), T.ArrayType)
            self.rows = self.current().withColumn(f"={name}" if opened is None else name, F.explode_outer(v) if many else v)
        if self.take("SKIP", "OFFSET"):
            self.rows = self.current().offset(self.number())
        if self.take("LIMIT"):
            self.rows = self.current().limit(self.number())
        return self.current().select(*[self.value(n).alias(n) for n in order])

    def selected(self, end: int, plain: list[str]) -> tuple[list[tuple[str, Column, bool]], DataFrame | None]:
        """(name, value, aggregated) of each item; or the rows that expand() makes of the only one."""
        items: list[tuple[str, Column, bool]] = []
        if self.i == end:
            return [(c, _c(c), False) for c in plain if not c.startswith("~")], None
        while self.i < end:
            start, self.aggregated = self.i, False
            if self.take("*"):
                items += [(c, _c(c), False) for c in plain]
            elif self.peek("EXPAND") and self.peek("(", ahead=1):
                self.i += 2
                return [], self.expanded()
            else:
                v = self.expression()
                shown = "".join(t for _, t in self.toks[start : self.i]).strip("`")
                items.append((self.name() if self.take("AS") else shown, v, self.aggregated))
            if self.i < end:
                self.need(",")
        return items, None

    def expanded(self) -> DataFrame:
        rows = self.current()
        if self.peek(*_STEPS) and self.peek("(", ahead=1):
            path, last = self.chain()
            found, _ = self.bind(rows.select("~a", "~a:label"), {"~a": self.scope["~a"]}, [path])
            held = [c for c in found.columns if c.startswith(f"{last}.")]
            return found.select(*[_c(c).alias(c[len(last) + 1 :]) for c in held])
        start = self.i
        v = self.expression()
        name = "".join(t for _, t in self.toks[start : self.i])
        kind = self.type_of(v)
        if isinstance(kind, T.ArrayType):
            rows, kind, v = rows.select(F.explode(v).alias("value")), kind.elementType, F.col("value")
        rows = rows.select(v.alias("value" if v is not None else name)).filter("value is not null")
        return rows.select("value.*") if isinstance(kind, T.StructType) else rows

    def grouped(self, items: list[tuple[str, Column, bool]], distinct: bool) -> list[str]:
        keys: list[Column] = []
        if self.take("GROUP"):
            self.need("BY")
            named = {n: v for n, v, _ in items}
            while True:
                v = named[self.name()] if self.kind() == "name" and self.toks[self.i][1] in named and self.toks[self.i][1] not in self.scope and not self.peek("(", ".", ahead=1) else self.expression()
                keys.append(v)
                if not self.take(","):
                    break
        rows = self.current()
        if keys or any(a for *_, a in items):
            shown = {str(k): f"~g{i}" for i, k in enumerate(keys)}
            aggs = [(v if a else F.first(v)).alias(f"={n}") for n, v, a in items if str(v) not in shown]
            by = [k.alias(f"~g{i}") for i, k in enumerate(keys)]
            rows = (rows.groupBy(*by).agg(*aggs) if aggs else rows.select(*by).distinct()) if by else rows.agg(*aggs)
            rows = rows.select(*rows.columns, *[_c(shown[str(v)]).alias(f"={n}") for n, v, _ in items if str(v) in shown])
            self.scope = {n: _c(f"={n}") for n, *_ in items}
        else:
            kept = [] if distinct else [_c(c) for c in rows.columns]
            rows = rows.select(*kept, *[v.alias(f"={n}") for n, v, _ in items])
            rows = rows.distinct() if distinct else rows
            self.scope = ({} if distinct else self.scope) | {n: _c(f"={n}") for n, *_ in items}
        self.rows = rows
        return [n for n, *_ in items]

    def order_by(self, same: dict[str, Column]) -> None:
        self.need("BY")
        by = []
        while True:
            v = self.expression()
            v = same.get(str(v), v)
            down = self.take("DESC")
            if not down:
                self.take("ASC")
            by.append(v.desc_nulls_last() if down else v.asc_nulls_first())
            if not self.take(","):
                break
        self.rows = self.current().orderBy(*by)

    # TRAVERSE

    def traversal(self) -> DataFrame:
        """TRAVERSE out('T') FROM ... [MAXDEPTH n]: the vertices met, each once at its least depth, with `$depth`."""
        if not self.peek(*_STEPS):
            raise SqlError("TRAVERSE goes along out(), in() or both() of a type")
        path, _ = self.chain()
        rel = path.rels[0]
        self.need("FROM")
        rows, label = self.source()
        if label is None:
            raise SqlError("TRAVERSE starts from a vertex type")
        self.open(rows, label)
        if self.take("WHERE"):
            where = self.expression()
            self.rows = self.current().filter(where)
        most = 1_000_000
        if self.take("MAXDEPTH"):
            most = self.number()
        if self.take("STRATEGY"):
            self.name()
        parts = [t for t in (rel.types or self.graph.edges) if self.graph.ends[t] == (label, label)]
        if not parts:
            raise SqlError(f"no type leads from {label} to {label}")
        edges: DataFrame | None = None
        for t in parts:
            df, src, dst = self.graph.edges[t]
            one = df.select(F.col(dst if rel.way == "in" else src).alias("src"), F.col(src if rel.way == "in" else dst).alias("dst"))
            edges = one if edges is None else edges.unionByName(one)
        assert edges is not None
        seen = traverse(edges, self.current().select(F.col("~a").alias("id")), most, rel.way == "both")
        df, key = self.graph.vertices[label]
        out = df.join(seen.select(F.col("id").alias(key), F.col("depth").alias("$depth")), key)
        return out.limit(self.number()) if self.take("LIMIT") else out

    # steps and patterns

    def chain(self) -> tuple[Path, str]:
        """out('A').in('B')... from the current vertex, and the name of what it ends at."""
        assert isinstance(self.scope.get("~a", Var("node", tuple(self.graph.vertices))), Var)
        path = Path(None, [Node("~a", (), {})])
        last = "~a"
        while self.peek(*_STEPS) and self.peek("(", ahead=1):
            rel, edge = self.step()
            path.rels.append(rel)
            path.nodes.append(Node(self.anonymous(), (), {}))
            last = rel.name if edge else path.nodes[-1].name
            if not (self.peek(".") and self.i + 2 < len(self.toks) and self.peek(*_STEPS, ahead=1) and self.peek("(", ahead=2)):
                break
            self.i += 1
        if self.take(")"):
            pass
        return path, last

    def step(self) -> tuple[Rel, bool]:
        word = self.next().upper()
        self.need("(")
        types = []
        while not self.take(")"):
            types.append(self.text_of())
            self.take(",")
        return Rel(self.anonymous(), tuple(types), {}, {"O": "out", "I": "in", "B": "both"}[word[0]]), word.endswith("E")

    def sql_match(self) -> DataFrame:
        paths, filters, optional = [], [], []
        while True:
            node = self.filter_(filters)
            path = Path(None, [node])
            while self.peek(".", "-", "<"):
                if self.take("."):
                    rel, edge = self.step()
                    if edge:
                        raise SqlError("steps to edges aren't part of a pattern")
                else:
                    back = self.take("<")
                    self.need("-")
                    rel = Rel(self.anonymous(), (), {})
                    if self.kind() == "name":
                        rel.types = (self.name(),)
                    elif self.take("{"):
                        while not self.take("}"):
                            word = self.name().lower()
                            self.need(":")
                            if word == "as":
                                rel.name = self.name()
                            elif word == "type":
                                rel.types = (self.name(),)
                            self.take(",")
                    self.need("-")
                    on = self.take(">")
                    rel.way = "in" if back and not on else "out" if on and not back else "both"
                path.rels.append(rel)
                path.nodes.append(self.filter_(filters, rel, optional))
            paths.append(path)
            if not self.take(","):
                break
        late = []
        for path in paths:  # from the first optional item on, a part of its own
            k = next((k for k, n in enumerate(path.nodes) if n.name in optional), None)
            if k == 0:
                raise SqlError("a pattern can't begin with an optional item")
            if k is not None:
                late.append(Path(None, [Node(path.nodes[k - 1].name, path.nodes[k - 1].labels, {}), *path.nodes[k:]], path.rels[k - 1 :]))
                path.nodes, path.rels = path.nodes[:k], path.rels[: k - 1]
        self.rows, self.scope = self.bind(None, {}, paths)
        back_to = self.i

        def condition(name: str, at: int) -> Column:
            self.i = at
            held = self.scope
            self.scope = held | {c[len(name) + 1 :]: _c(c) for c in self.rows.columns if c.startswith(f"{name}.")}
            where = self.expression()
            self.scope = held
            return where

        for name, at in filters:
            if name in self.scope:
                self.rows = self.rows.filter(condition(name, at))
        for path in late:
            first = self.scope[path.nodes[0].name]
            path.nodes[0].labels = first.labels

            def on(path: Path = path) -> Column | None:
                out = None
                for name, at in filters:
                    if name in {n.name for n in path.nodes[1:]}:
                        out = condition(name, at) if out is None else out & condition(name, at)
                return out

            self.attach([path], on)
        self.i = back_to
        self.need("RETURN")
        distinct = self.take("DISTINCT")
        end, depth = self.i, 0
        while end < len(self.toks) and not (depth == 0 and (self.toks[end][1].upper() in _END or self.toks[end][1] in (";", ")"))):
            depth += {"(": 1, ")": -1}.get(self.toks[end][1], 0)
            end += 1
        items, _ = self.selected(end, [])
        order = self.grouped(items, distinct)
        if self.take("ORDER"):
            self.order_by({str(v): self.scope[n] for n, v, _ in items})
        if self.take("SKIP"):
            self.rows = self.rows.offset(self.number())
        if self.take("LIMIT"):
            self.rows = self.rows.limit(self.number())
        return self.rows.select(*[self.value(n).alias(n) for n in order])

    def filter_(self, filters: list[tuple[str, int]], rel: Rel | None = None, optional: list[str] | None = None) -> Node:
        """{type: T, as: name, where: (...), maxDepth: n, optional: b}; a condition is read once the columns are known."""
        node = Node(self.anonymous(), (), {})
        self.need("{")
        where = None
        while not self.take("}"):
            word = self.name().lower()
            self.need(":")
            if word in ("type", "class"):
                node.labels = (self.name(),)
            elif word == "as":
                node.name = self.name()
            elif word == "maxdepth" and rel is not None:
                rel.low, rel.high = 0, self.number()
            elif word == "optional" and optional is not None:
                if self.next().lower() == "true":
                    optional.append(node.name)
            elif word == "where":
                where, depth = self.i, 0
                while True:
                    depth += {"(": 1, ")": -1}.get(self.next(), 0)
                    if not depth:
                        break
            else:
                raise SqlError(f"{word} isn't known in a pattern item")
            self.take(",")
        if where is not None:
            filters.append((node.name, where))
        return node

    # expressions

    def comparison(self) -> Column:
        if self.kind() == "name" and self.peek("IS", ahead=1) and (self.peek("DEFINED", ahead=2) or (self.peek("NOT", ahead=2) and self.peek("DEFINED", ahead=3))):
            known = self.name() in self.scope
            self.need("IS")
            no = self.take("NOT")
            self.need("DEFINED")
            return F.lit(known != no)
        a = self.sum()
        ops = {"=": P.eq, "<>": P.ne, "!=": P.ne, "==": P.eq, "<=>": lambda x, y: x.eqNullSafe(y), "<=": P.le, ">=": P.ge, "<": P.lt, ">": P.gt}
        for op, f in ops.items():
            if self.peek(op):
                self.i += 1
                return f(a, self.sum())
        no = self.peek("NOT") and self.peek("IN", "LIKE", "ILIKE", "BETWEEN", ahead=1) and self.take("NOT")
        out: Column | None = None
        if self.take("IS"):
            isnt = self.take("NOT")
            if self.take("DEFINED"):  # of an expression that could be read
                return F.lit(not isnt)
            self.need("NULL")
            return a.isNotNull() if isnt else a.isNull()
        if self.take("LIKE"):
            out = P.like(a, self.text_of())
        elif self.take("ILIKE"):
            out = P.like(a, self.text_of(), ignore_case=True)
        elif self.take("MATCHES"):
            out = P.matches(a, self.text_of())
        elif self.take("CONTAINSTEXT"):
            out = P.contains_text(a, self.sum())
        elif self.take("CONTAINSKEY"):
            out = P.holds(F.map_contains_key(library.as_map(self, a), self.sum()))
        elif self.take("CONTAINSVALUE"):
            out = P.holds(F.array_contains(F.map_values(library.as_map(self, a)), self.sum()))
        elif self.take("INSTANCEOF"):
            kind = self.text_of() if self.kind() == "str" else self.name()
            held = self.scope.get("~a")
            out = _c("~a:label") == kind if isinstance(held, Var) else F.lit(False)
        elif self.take("CONTAINSALL"):
            out = P.contains_all(a, self.sum())
        elif self.take("CONTAINSANY"):
            out = P.contains_any(a, self.sum())
        elif self.take("CONTAINS"):
            out = P.holds(F.array_contains(a, self.sum()))
        elif self.take("BETWEEN"):
            low = self.sum()
            self.need("AND")
            out = P.between(a, low, self.sum())
        elif self.take("IN"):
            out = P.holds(F.array_contains(self.sum(), a))
        if out is None:
            return a
        return ~out if no else out

    def postfix(self) -> Column:
        v = self.primary()
        while self.peek(".", "["):
            if self.take("["):
                at = self.expression()
                self.need("]")
                v = F.get(v, at.cast("int")) if isinstance(self.type_of(v), T.ArrayType) else v[at]
                continue
            self.need(".")
            name = self.name()
            if not self.peek("("):
                v = v.getField(name)
                continue
            self.i += 1
            low = name.lower()
            if low == "hash":
                how = "SHA-256" if self.take(")") else self.text_of()
                if self.toks[self.i - 1][1] != ")":
                    self.need(")")
                v = {"MD5": F.md5, "SHA-1": F.sha1, "SHA-256": lambda x: F.sha2(x, 256), "SHA-512": lambda x: F.sha2(x, 512)}[how.upper()](v)
                continue
            args = self.arguments()
            if low == "size":
                v = (F.size(v) if isinstance(self.type_of(v), T.ArrayType | T.MapType) else F.lit(1)).cast("long")
            elif low == "format":
                v = F.date_format(v, "yyyy-MM-dd") if not args else F.date_format(v, args[0]) if isinstance(self.type_of(v), T.TimestampType | T.TimestampNTZType | T.DateType) else F.call_function("format_string", args[0], v)
            elif low in _METHODS:
                v = _METHODS[low](v, *args)
            elif low in _TYPED:
                v = _TYPED[low](self, v, *args)
            else:
                raise SqlError(f"there is no method {name}")
        return v

    def primary(self) -> Column:
        if self.kind() == "param":
            name = self.next()
            v = self.scope.get(name)
            if not isinstance(v, Column):
                raise SqlError(f"{name} isn't defined")
            return v
        if self.take(":"):
            value = self.params[self.name()]
            return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        if self.take("("):
            v = self.expression()
            self.need(")")
            return v
        if self.peek(*_STEPS) and self.peek("(", ahead=1) and "~a" in self.scope:
            path, last = self.chain()
            if self.peek(".") and self.toks[self.i + 1][1].lower() in ("size", "count") and self.peek("(", ahead=2):
                self.i += 3
                self.need(")")
                return self.related([path], None)
            self.need(".")
            key = self.name()
            return self.related([path], None, lambda: _c(f"{last}.{key}"))
        if self.kind() == "name" and not self.peek("(", ahead=1):
            bare = self.toks[self.i][1].strip("`")
            if self.peek(".", ahead=1) and self.peek("(", ahead=3) and (full := f"{bare}.{self.toks[self.i + 2][1]}".lower()) in {*_GROUPED, *library.SQL, "ts.timebucket"}:
                self.i += 3
                return self.call(full)
            if bare in self.scope and isinstance(self.scope[bare], Column):
                self.i += 1
                return self.scope[bare]
        return self.atom()

    def call(self, name: str) -> Column:
        self.need("(")
        if name == "count" and self.take("*"):
            self.need(")")
            self.aggregated = True
            return F.count("*")
        if name == "count" and self.take("DISTINCT"):
            self.need("(") if self.peek("(") else None
            args = self.arguments()
            self.aggregated = True
            return F.count_distinct(*args)
        if name == "percentile":
            v = self.expression()
            self.need(",")
            q = float(self.next())
            self.need(")")
            self.aggregated = True
            return A.percentile(v, q)
        if name == "ts.timebucket":
            step = self.text_of()
            self.need(",")
            v = self.expression()
            self.need(")")
            return A.time_bucket(v, int(step[:-1]) * _BUCKET[step[-1]])
        args = self.arguments()
        if name in _GROUPED and not (name in ("min", "max", "sum") and len(args) > 1):
            self.aggregated = True
            return _GROUPED[name](*args)
        if name in ("min", "max"):
            return (F.least if name == "min" else F.greatest)(*args)
        if name in _SCALARS:
            return _SCALARS[name](*args)
        if name in library.SQL:
            return library.SQL[name](self, *args)
        raise SqlError(f"there is no function {name}")
