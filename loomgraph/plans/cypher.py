"""Cypher read queries compiled to one DataFrame.

    cypher(graph, "MATCH (c:Customer)-[r:PLACED]->(o) WHERE r.o_totalprice > $least RETURN c.c_name AS name, count(*) AS n", least=1000)

A variable of a node or relationship stands as flat columns: `v` its id,
`v:label` its label or type, `v.p` its properties, so that Catalyst prunes what
isn't read and pushes filters to the scans. A pattern whose labels or types
aren't given is compiled once for each way they can be, and the ways are united.
Names are told apart without regard to case.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import library
from ..functions import lists as L
from ..functions import scalars as S
from ..operators.pattern import Graph
from ..storage import written
from .procedures import PROCEDURES, Projection

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<name>[^\W\d]\w*|`[^`]+`)|(?P<param>\$\w+)|(?P<op><=>|<>|<=|>=|!=|==|=~|\.\.|[-+*/%^=<>(){}\[\],.:;|])",
    re.S,
)
_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "ORDER", "SKIP", "OFFSET", "LIMIT", "UNION", "FINISH", "CALL", "YIELD", "LOAD", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "FOREACH", "ON"}


class CypherError(ValueError):
    pass


@dataclass
class Var:
    kind: str  # node, rel, rels or path
    labels: tuple[str, ...] = ()


@dataclass
class Node:
    name: str
    labels: tuple[str, ...]
    props: dict[str, Column]


@dataclass
class Rel:
    name: str
    types: tuple[str, ...]
    props: dict[str, Column]
    way: str = "both"  # out, in or both
    low: int | None = None  # None: exactly one hop
    high: int | None = None


@dataclass
class Path:
    name: str | None
    nodes: list[Node] = field(default_factory=list)
    rels: list[Rel] = field(default_factory=list)
    shortest: str | None = None


def cypher(graph: Graph, text: str, **params: Any) -> DataFrame:
    """The rows of a read query, one column a returned item; nodes and relationships come as structs."""
    return _Query(graph, text, params).run()


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _number(x: Column) -> Column:
    return x.cast("double")


# name: (what it makes of its arguments); all names in lower case
_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "coalesce": F.coalesce, "nullif": F.nullif, "head": lambda v: F.get(v, F.lit(0)), "last": lambda v: F.element_at(v, -1), "tail": L.tail, "abs": F.abs, "ceil": lambda x: F.ceil(_number(x)).cast("double"),
    "floor": lambda x: F.floor(_number(x)).cast("double"), "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "cot": F.cot, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "atan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "degrees": F.degrees, "radians": F.radians, "pi": F.pi, "e": F.e, "sign": lambda x: F.signum(x).cast("long"), "isnan": F.isnan,
    "toupper": F.upper, "upper": F.upper, "tolower": F.lower, "lower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "left": lambda s, n: F.when(n <= 0, F.lit("")).otherwise(F.left(s, n)), "right": lambda s, n: F.when(n <= 0, F.lit("")).otherwise(F.right(s, n)),
    "replace": F.replace, "reverse": F.reverse, "tostring": lambda x: x.cast("string"), "tointeger": library.integer, "tofloat": lambda x: x.try_cast("double"), "toboolean": lambda x: x.try_cast("boolean"),
    "char_length": F.char_length, "range": lambda a, b, by=None: F.when((b - a) * (1 if by is None else F.signum(by)) < 0, F.array().cast("array<bigint>")).otherwise(F.sequence(a.cast("long"), b.cast("long"), F.lit(1).cast("long") if by is None else by.cast("long"))),
    "rand": F.rand, "randomuuid": F.uuid, "date": lambda s: s.cast("date"), "datetime": lambda s: s.cast("timestamp"), "haversin": lambda x: (1 - F.cos(x)) / 2,
    "coll.distinct": F.array_distinct, "coll.sort": F.sort_array, "coll.max": F.array_max, "coll.min": F.array_min, "coll.union": F.array_union, "coll.sum": L.total, "coll.avg": L.mean,
}
_AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": F.count, "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list, "stdev": lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0)), "stdevp": lambda x: F.coalesce(F.stddev_pop(x), F.lit(0.0)),
    "percentilecont": F.percentile, "percentiledisc": lambda x, p: F.element_at(F.array_sort(F.collect_list(x)), F.greatest(F.ceil(p * F.count(x)), F.lit(1)).cast("int")),
}
_DISTINCT: dict[str, Callable[..., Column]] = {"count": F.count_distinct, "sum": lambda x: F.coalesce(F.sum_distinct(x), F.lit(0)), "collect": F.collect_set, "avg": lambda x: F.call_function("avg", x), "min": F.min, "max": F.max}


class _Query:
    def __init__(self, graph: Graph, text: str, params: dict[str, Any]):
        self.graph, self.params, self.text = graph, params, text
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"cannot read {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.toks.append((m.lastgroup or "", m.group()))
            at = m.end()
        self.i = 0
        self.fresh = 0
        self.aggregated = False
        self.met: list[T.DataType] | None = None  # types met while an expression over elements is read first
        self.told: Any = None  # the same types when it is read again
        held = [*graph.vertices.values(), *graph.edges.values()]
        self.spark = held[0][0].sparkSession if held else SparkSession.active()
        self.clear()

    def clear(self) -> None:
        self.rows: DataFrame | None = None
        self.scope: dict[str, Var | Column] = {}

    # tokens

    def peek(self, *words: str, ahead: int = 0) -> bool:
        at = self.i + ahead
        return at < len(self.toks) and self.toks[at][0] in ("name", "op") and self.toks[at][1].upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"{word} expected near {' '.join(t for _, t in self.toks[max(0, self.i - 3) : self.i + 3])!r}")

    def kind(self, ahead: int = 0) -> str:
        return self.toks[self.i + ahead][0] if self.i + ahead < len(self.toks) else ""

    def next(self) -> str:
        if self.i >= len(self.toks):
            raise CypherError("the query ends too early")
        self.i += 1
        return self.toks[self.i - 1][1]

    def name(self) -> str:
        if self.kind() != "name":
            raise CypherError(f"a name expected, not {self.next()!r}")
        return self.next().strip("`")

    def anonymous(self) -> str:
        self.fresh += 1
        return f"~{self.fresh}"

    def read_properties(self, name: str) -> bool:
        """Whether anything but a pattern, count() or id() names the variable."""
        if name.startswith("~"):
            return False
        for k, (_, t) in enumerate(self.toks):
            if t.strip("`").lower() == name.lower():
                inside = k > 1 and self.toks[k - 1][1] == "("
                before = self.toks[k - 2] if inside else ("", "")
                after = self.toks[k + 1][1] if k + 1 < len(self.toks) else ""
                if not inside or after == "." or (before[0] == "name" and before[1].upper() not in _CLAUSES | {"COUNT", "ID", "NOT", "AND", "OR"}):
                    return True
        return False

    # clauses

    def run(self) -> DataFrame:
        out = self.single()
        while self.take("UNION"):
            every = self.take("ALL")
            self.clear()
            more = self.single()
            if sorted(more.columns) != sorted(out.columns):
                raise CypherError("the parts of a UNION must return the same names")
            out = out.unionByName(more)
            out = out if every else out.distinct()
        self.take(";")
        if self.i < len(self.toks):
            raise CypherError(f"cannot go on at {self.next()!r}")
        return out

    def current(self) -> DataFrame:
        if self.rows is None:
            self.rows = self.spark.range(1).toDF("~unit")
        return self.rows

    def single(self) -> DataFrame:
        while True:
            if self.take("MATCH"):
                self.match(False)
            elif self.take("OPTIONAL"):
                self.need("MATCH")
                self.match(True)
            elif self.take("UNWIND"):
                v = self.expression()
                self.need("AS")
                name = self.name()
                v = v if isinstance(self.type_of(v), T.ArrayType) else F.array(v)
                self.rows = self.current().drop(name).withColumn(name, F.explode(v))
                self.scope[name] = _c(name)
            elif self.take("CALL"):
                self.call_clause()
                if self.i >= len(self.toks) or self.peek("UNION", ";", "}"):
                    return self.current().select(*[self.value(n).alias(n) for n in self.scope if not n.startswith("~")])
            elif self.take("LOAD"):
                self.load_csv()
            elif self.take("WITH"):
                self.project()
                if self.take("WHERE"):
                    where = self.expression()
                    self.rows = self.current().filter(where)
            elif self.take("RETURN"):
                order = self.project()
                return self.current().select(*[self.value(n).alias(n) for n in order])
            elif self.take("FINISH"):
                return self.current().limit(0)
            elif self.write():
                if self.i >= len(self.toks) or self.peek("UNION", ";"):
                    return self.current().limit(0)
            else:
                raise CypherError(f"a clause expected, not {self.next()!r}")

    def write(self) -> bool:
        """Run a clause that changes the graph, if one stands here; of a query that reads there is none."""
        return False

    def constant_value(self) -> Any:
        """A literal, a parameter, a list or a map of these; of a variable of a node its (label, id), which must be one."""
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.constant_value())
                self.take(",")
            return out
        if self.take("{"):
            held = {}
            while not self.take("}"):
                key = self.name()
                self.need(":")
                held[key] = self.constant_value()
                self.take(",")
            return held
        if self.take("-"):
            return -self.constant_value()
        kind = self.kind()
        if kind == "param":
            return self.params[self.next()[1:]]
        if kind == "num":
            t = self.next()
            return int(t) if t.isdigit() else float(t)
        if kind == "str":
            return self.next()[1:-1]
        for word, v in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return v
        name = self.name()
        if not isinstance(self.scope.get(name), Var):
            raise CypherError(f"{name} is no node")
        found = self.current().select(_c(f"{name}:label"), _c(name)).distinct().limit(2).collect()
        if len(found) != 1:
            raise CypherError(f"a procedure takes one node, and {name} is {'none' if not found else 'several'}")
        return tuple(found[0])

    def call_clause(self) -> None:
        """CALL procedure(arguments) [YIELD column [AS name], ... [WHERE condition]], or CALL { query } of its own scope: its rows with each row so far."""
        if self.take("{"):
            outer_rows, outer = self.rows, self.scope
            self.clear()
            made = self.single()
            while self.take("UNION"):
                every = self.take("ALL")
                self.clear()
                made = made.unionByName(self.single())
                made = made if every else made.distinct()
            self.need("}")
            self.rows = made if outer_rows is None else outer_rows.crossJoin(made)
            self.scope = outer | {c: _c(c) for c in made.columns}
            return
        name = self.name()
        while self.take("."):
            name += f".{self.name()}"
        if name.lower() not in PROCEDURES:
            raise CypherError(f"there is no procedure {name}")
        args: list[Any] = []
        if self.take("("):
            while not self.take(")"):
                args.append(self.constant_value())
                self.take(",")
        make, nodes = PROCEDURES[name.lower()]
        p = Projection(self.graph, self.spark, args)
        made = make(p)
        wanted = {c: c for c in made.columns}
        if self.take("YIELD") and not self.take("*"):
            wanted = {}
            while True:
                was = self.name()
                if was not in made.columns:
                    raise CypherError(f"{name} yields no {was}")
                wanted[was] = self.name() if self.take("AS") else was
                if not self.take(","):
                    break
        made = made.select(*[x for was, now in wanted.items() for x in ([p.id_of(_c(was)).alias(now), p.label_of(_c(was)).alias(f"{now}:label")] if was in nodes else [_c(was).alias(now)])])
        for was, now in wanted.items():
            self.scope[now] = Var("node", tuple(p.labels)) if was in nodes else _c(now)
            if was in nodes and self.read_properties(now):
                made = self.with_properties(made, now, p.labels)
        self.rows = made if self.rows is None else self.rows.crossJoin(made)  # what a procedure yields goes with each row
        if self.take("WHERE"):
            where = self.expression()
            self.rows = self.current().filter(where)

    def with_properties(self, rows: DataFrame, name: str, labels: list[str]) -> DataFrame:
        out: DataFrame | None = None
        for label in labels:
            one = rows.filter(_c(f"{name}:label") == label).join(self.scan(name, label).drop(f"{name}:label"), name, "left")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        assert out is not None
        return out

    def load_csv(self) -> None:
        """LOAD CSV [WITH HEADERS] FROM 'path' AS row [FIELDTERMINATOR 'c']: a row is a map by header, else a list; with each row so far."""
        self.need("CSV")
        headed = self.take("WITH") and (self.need("HEADERS") or True)
        self.need("FROM")
        path = str(self.constant_value())
        self.need("AS")
        name = self.name()
        by = str(self.constant_value()) if self.take("FIELDTERMINATOR") else ","
        made = self.spark.read.csv(path, header=bool(headed), sep=by, multiLine=True, escape='"')
        cells = [_c(c) for c in made.columns]
        row = F.create_map(*[x for c, v in zip(made.columns, cells, strict=True) for x in (F.lit(c), v)]) if headed else F.array(*cells)
        made = made.select(row.alias(name), F.input_file_name().alias("~csv:file"))
        self.rows = made if self.rows is None else self.rows.crossJoin(made)
        self.scope[name] = _c(name)

    def match(self, optional: bool) -> None:
        paths = self.patterns()
        if not optional:
            self.rows, self.scope = self.bind(self.rows, self.scope, paths)
            if self.take("WHERE"):
                where = self.expression()
                self.rows = self.rows.filter(where)
            return
        self.attach(paths, lambda: self.expression() if self.take("WHERE") else None)

    def attach(self, paths: list[Path], where: Callable[[], Column | None]) -> None:
        """Each row with the matches of paths, or with nulls where there is none. where is read once the columns are known."""
        left, outer = self.current(), dict(self.scope)
        right, inner = self.bind(None, {}, paths)
        shared = [v for v in inner if v in outer]
        right = right.select([_c(c).alias(f"{c}#") if c in shared else _c(c) for c in right.columns if not any(c.startswith((f"{v}.", f"{v}:")) for v in shared)])
        self.scope = inner | outer
        self.rows = left.crossJoin(right)  # analysed only, for the types of WHERE
        on = F.lit(True)
        for v in shared:
            on = on & (_c(v) == _c(f"{v}#"))
        condition = where()
        if condition is not None:
            on = on & condition
        self.rows = left.join(right, on, "left").drop(*[f"{v}#" for v in shared])

    def items(self) -> list[tuple[str, Var | Column, bool, str | None]]:
        """(name, value, aggregated, the variable it is) of each item."""
        out: list[tuple[str, Var | Column, bool, str | None]] = []
        if self.take("*"):
            out = [(n, v, False, n) for n, v in self.scope.items() if not n.startswith("~")]
            if not self.take(","):
                return out
        while True:
            start = self.i
            self.aggregated = False
            bare = self.kind() == "name" and self.toks[self.i][1].strip("`") in self.scope and (self.i + 1 >= len(self.toks) or self.peek(",", "AS", ";", ")", "}", *_CLAUSES, ahead=1))
            if bare:
                was = self.name()
                v: Var | Column = self.scope[was]
            else:
                was, v = None, self.expression()
            shown = "".join(t for _, t in self.toks[start : self.i])
            out.append((self.name() if self.take("AS") else shown.strip("`"), v, self.aggregated, was))
            if not self.take(","):
                return out

    def columns_of(self, name: str) -> list[str]:
        return [c for c in self.current().columns if c == name or c.startswith((f"{name}.", f"{name}:"))]

    def project(self) -> list[str]:
        distinct = self.take("DISTINCT")
        self.current()
        items = self.items()
        grouped = any(a for _, _, a, _ in items)
        keys, carried, found, scope = [], [], [], {}
        for n, v, agg, was in items:
            if isinstance(v, Var):
                for c in self.columns_of(was or n):
                    as_ = n + c[len(was or n) :]
                    (keys if c == was or c.endswith(":label") else carried).append((_c(c), as_))
                scope[n] = v
            else:
                (found if agg else keys).append((v, f"={n}"))  # apart from the columns of variables
                scope[n] = _c(f"={n}")
        before = dict(self.scope)
        assert self.rows is not None
        if grouped:
            aggs = [v.alias(n) for v, n in found] + [F.first(v).alias(n) for v, n in carried]
            by = [v.alias(n) for v, n in keys]
            self.rows = self.rows.groupBy(*by).agg(*aggs) if by else self.rows.agg(*aggs)
            self.scope = scope
            self.order({str(v): scope[n] for n, v, _, _ in items if isinstance(v, Column)})
        else:
            chosen = [v.alias(n) for v, n in keys + carried]
            if distinct:
                self.rows = self.rows.select(chosen).dropDuplicates([n for _, n in keys])
                self.scope = scope
                self.order({str(v): scope[n] for n, v, _, _ in items if isinstance(v, Column)})
            else:
                if self.peek("ORDER"):  # what is ordered by may be an item or a variable from before
                    self.scope = before | {n: v for n, v, _, _ in items}
                    self.order({}, late=chosen)
                else:
                    self.rows = self.rows.select(chosen)
                self.scope = scope
        skip = self.take("SKIP", "OFFSET") and self.constant()
        if skip:
            self.rows = self.rows.offset(int(skip))
        if self.take("LIMIT"):
            self.rows = self.rows.limit(int(self.constant()))
        return [n for n, *_ in items]

    def order(self, same: dict[str, Column], late: list[Column] | None = None) -> None:
        """ORDER BY: nulls are the greatest values. late: what to select once sorted."""
        assert self.rows is not None
        if self.take("ORDER"):
            self.need("BY")
            by = []
            while True:
                v = self.expression()
                v = same.get(str(v), v)
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                by.append(v.desc_nulls_first() if down else v.asc_nulls_last())
                if not self.take(","):
                    break
            self.rows = self.rows.orderBy(*by)
        if late:
            self.rows = self.rows.select(late)

    def constant(self) -> Any:
        t = self.next()
        return self.params[t[1:]] if t.startswith("$") else int(t)

    # patterns

    def patterns(self) -> list[Path]:
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def path(self) -> Path:
        name = None
        if self.kind() == "name" and self.peek("=", ahead=1):
            name = self.name()
            self.need("=")
        shortest = self.next().lower() if self.peek("SHORTESTPATH", "ALLSHORTESTPATHS") else None
        if shortest:
            self.need("(")
        p = Path(name, [self.node()], [], shortest)
        while self.peek("-") or (self.peek("<") and self.peek("-", ahead=1)):
            p.rels.append(self.rel())
            p.nodes.append(self.node())
        if shortest:
            self.need(")")
        return p

    def alternatives(self) -> tuple[str, ...]:
        out = []
        if self.take(":"):
            out.append(self.name())
            while self.take("|"):
                self.take(":")
                out.append(self.name())
        return tuple(out)

    def properties(self) -> dict[str, Column]:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out[key] = self.expression()
                self.take(",")
        return out

    def node(self) -> Node:
        self.need("(")
        name = self.name() if self.kind() == "name" else self.anonymous()
        out = Node(name, self.alternatives(), self.properties())
        self.need(")")
        return out

    def rel(self) -> Rel:
        back = self.take("<")
        self.need("-")
        r = Rel(self.anonymous(), (), {})
        if self.take("["):
            if self.kind() == "name":
                r.name = self.name()
            r.types = self.alternatives()
            if self.take("*"):
                r.low, r.high = 1, None
                if self.kind() == "num":
                    r.low = r.high = int(self.next())
                if self.take(".."):
                    r.high = int(self.next()) if self.kind() == "num" else None
            r.props = self.properties()
            self.need("]")
        self.need("-")
        on = self.take(">")
        r.way = "in" if back and not on else "out" if on and not back else "both"
        return r

    def bind(self, rows: DataFrame | None, scope: dict[str, Var | Column], paths: list[Path]) -> tuple[DataFrame, dict[str, Var | Column]]:
        """Rows with all of the paths bound: a branch for each way to choose labels and types, united."""
        labels: dict[str, tuple[str, ...]] = {}
        for p in paths:
            for n in p.nodes:
                held = scope.get(n.name)
                known = held.labels if isinstance(held, Var) else labels.get(n.name, tuple(self.graph.vertices))
                labels[n.name] = tuple(x for x in known if not n.labels or x in n.labels)
        rels = [(r, a.name, b.name) for p in paths for r, a, b in zip(p.rels, p.nodes, p.nodes[1:], strict=False)]
        ways: list[tuple[dict[str, str], dict[str, tuple[tuple[str, bool], ...]]]] = [({}, {})]
        for r, a, b in rels:
            grown = []
            for chosen, types in ways:
                fit: dict[tuple[str, str], list[tuple[str, bool]]] = {}
                for t in r.types or tuple(self.graph.edges):
                    src, dst = self.graph.ends[t]
                    for back in {"out": (False,), "in": (True,), "both": (False, True)}[r.way]:
                        x, y = (dst, src) if back else (src, dst)
                        if x in labels[a] and y in labels[b] and chosen.get(a, x) == x and chosen.get(b, y) == y and (a != b or x == y) and (r.low is None or x == y):
                            fit.setdefault((x, y), []).append((t, back))
                grown += [(chosen | {a: x, b: y}, types | {r.name: tuple(ts)}) for (x, y), ts in fit.items()]
            ways = grown
        alone = [n for n in labels if not any(n in (a, b) for _, a, b in rels)]
        full = [(chosen | dict(zip(alone, pick, strict=True)), types) for chosen, types in ways for pick in product(*[labels[n] for n in alone])]
        if not full:
            raise CypherError("no label or relationship type fits the pattern")
        outs = [self.branch(rows, scope, paths, chosen, types) for chosen, types in full]
        out = outs[0]
        for more in outs[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        new: dict[str, Var | Column] = dict(scope)
        for n in labels:
            new[n] = Var("node", tuple(sorted({chosen[n] for chosen, _ in full})))
        for r, _, _ in rels:
            new[r.name] = Var("rel" if r.low is None else "rels", tuple(sorted({t for _, types in full for t, _ in types[r.name]})))
        for p in paths:
            if p.name:
                new[p.name] = Var("path")
        return out, new

    def scan(self, name: str, label: str) -> DataFrame:
        df, key = self.graph.vertices[label]
        return df.select(F.col(key).alias(name), F.lit(label).alias(f"{name}:label"), *[F.col(p).alias(f"{name}.{p}") for p in df.columns])

    def edges(self, types: tuple[tuple[str, bool], ...], a: str, b: str, name: str, props: bool = True) -> DataFrame:
        """Edges from a to b as columns of the relationship `name`; where both directions count, a loop comes once."""
        out: DataFrame | None = None
        for t, back in types:
            df, src, dst = self.graph.edges[t]
            keys = self.graph.keys.get(t, (src, dst))
            if back and (t, False) in types:
                df = df.filter(F.col(src) != F.col(dst))
            one = df.select(
                F.col(dst if back else src).alias(a), F.col(src if back else dst).alias(b), (F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)).alias(name), F.lit(t).alias(f"{name}:label"),
                F.col(src).alias(f"{name}:from"), F.col(dst).alias(f"{name}:to"), *[F.col(p).alias(f"{name}.{p}") for p in df.columns if props],
            )
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        assert out is not None
        return out

    def branch(self, rows: DataFrame | None, scope: dict[str, Var | Column], paths: list[Path], chosen: dict[str, str], types: dict[str, tuple[tuple[str, bool], ...]]) -> DataFrame:
        bound = {n for n, v in scope.items()}
        for n, label in chosen.items():
            v = scope.get(n)
            if rows is not None and isinstance(v, Var) and len(v.labels) > 1:
                rows = rows.filter(_c(f"{n}:label") == label)
        for p in paths:
            names = [n.name for n in p.nodes]
            at = next((k for k, n in enumerate(names) if n in bound), None)
            if at is None:
                at = max(range(len(names)), key=lambda k: (bool(p.nodes[k].props), -k))
                start = self.scan(names[at], chosen[names[at]])
                rows = start if rows is None else rows.crossJoin(start)  # parts of a pattern that share nothing
                bound.add(names[at])
            assert rows is not None
            if p.shortest:
                rows = self.shortest(rows, p, chosen, types, bound)
            else:
                for k in range(at, len(p.rels)):
                    rows = self.hop(rows, names[k], p.rels[k], names[k + 1], types[p.rels[k].name], chosen, bound, p.nodes[k + 1])
                for k in range(at - 1, -1, -1):
                    turned = tuple((t, not back) for t, back in types[p.rels[k].name])
                    rows = self.hop(rows, names[k + 1], p.rels[k], names[k], turned, chosen, bound, p.nodes[k], turned=True)
            for item in (*p.nodes, *p.rels):
                for key, v in item.props.items():
                    rows = rows.filter(_c(f"{item.name}.{key}") == v if f"{item.name}.{key}" in rows.columns else F.lit(False))
        rels = [r for p in paths for r in p.rels if not p.shortest]
        for i, r in enumerate(rels):
            for s in rels[:i]:
                if {t for t, _ in types[r.name]} & {t for t, _ in types[s.name]} and r.name != s.name:
                    a, b = _c(r.name), _c(s.name)
                    if r.low is None and s.low is None:
                        clash = (a == b) & (_c(f"{r.name}:label") == _c(f"{s.name}:label"))
                    elif r.low is not None and s.low is not None:
                        clash = F.arrays_overlap(a, b)
                    else:
                        clash = F.array_contains(a, b) if r.low is not None else F.array_contains(b, a)
                    rows = rows.filter(~clash)
        for p in paths:
            if p.name and not p.shortest:
                rows = self.named(rows, p)
        assert rows is not None
        return rows

    def named(self, rows: DataFrame, p: Path) -> DataFrame:
        whole = all(isinstance(rows.schema[n.name].dataType, T.IntegralType) for n in p.nodes)
        to = "bigint" if whole else "string"
        parts = [F.array(_c(p.nodes[0].name).cast(to))]
        rels, size = [], F.lit(0)
        for r, n in zip(p.rels, p.nodes[1:], strict=True):
            parts.append(F.array(_c(n.name).cast(to)) if r.low is None else L.tail(_c(f"{r.name}:nodes")).cast(f"array<{to}>"))
            rels.append(F.array(_c(r.name).cast("string")) if r.low is None else _c(r.name).cast("array<string>"))
            size = size + (F.lit(1) if r.low is None else F.size(_c(r.name)))
        return rows.withColumns({p.name: F.concat(*parts), f"{p.name}:rels": F.concat(*rels) if rels else F.array().cast("array<string>"), f"{p.name}:length": size.cast("long")})

    def hop(self, rows: DataFrame, a: str, r: Rel, b: str, types, chosen, bound: set[str], to: Node, turned: bool = False) -> DataFrame:
        if r.low is not None:
            rows = self.trails(rows, a, r, b, types, b in bound, turned)
        elif a == b:
            rows = rows.join(self.edges(types, a, "~end", r.name).filter(_c(a) == _c("~end")).drop("~end"), a)
        else:
            rows = rows.join(self.edges(types, a, b, r.name), [a, b] if b in bound else [a])
        bound.add(r.name)
        if b not in bound:
            bound.add(b)
            rows = rows.join(self.scan(b, chosen[b]), b) if to.props or self.read_properties(b) else rows.withColumn(f"{b}:label", F.lit(chosen[b]))
        return rows

    def trails(self, rows: DataFrame, a: str, r: Rel, b: str, types, held: bool, turned: bool) -> DataFrame:
        """Paths of several hops, no edge twice; without an upper bound a table is written a level, until no path goes on."""
        e = self.edges(types, "~s", "~d", "~k", props=False)
        e = e.select("~s", "~d", F.struct(_c("~k:label").alias("type"), _c("~k").alias("id")).alias("~k")) if len({t for t, _ in types}) > 1 else e.select("~s", "~d", "~k")
        for key, v in r.props.items():
            e = e.join(self.edges(types, "~s", "~d", "~k").filter(_c(f"~k.{key}") == v).select("~s", "~d", "~k"), ["~s", "~d", "~k"], "left_semi")
        kind = e.schema["~k"].dataType
        now = rows.withColumns({r.name: F.array().cast(T.ArrayType(kind)), f"{r.name}:nodes": F.array(_c(a).cast(e.schema["~d"].dataType)), "~end": _c(a).cast(e.schema["~d"].dataType)})
        outs = [now] if r.low == 0 else []
        n = 0
        while r.high is None or n < r.high:
            n += 1
            now = now.join(e, _c("~end") == _c("~s")).filter(~F.array_contains(_c(r.name), _c("~k")))
            now = now.withColumns({r.name: F.array_append(_c(r.name), _c("~k")), f"{r.name}:nodes": F.array_append(_c(f"{r.name}:nodes"), _c("~d")), "~end": _c("~d")}).drop("~s", "~d", "~k")
            if r.high is None:
                now = written(now)
                if now.isEmpty():
                    break
            if n >= (r.low or 0):
                outs.append(now)
        out = outs[0] if outs else now.limit(0)
        for more in outs[1:]:
            out = out.unionByName(more)
        if turned:
            out = out.withColumns({r.name: F.reverse(_c(r.name)), f"{r.name}:nodes": F.reverse(_c(f"{r.name}:nodes"))})
        return out.filter(_c("~end") == _c(b)).drop("~end") if held else out.withColumn(b, _c("~end")).drop("~end")

    def shortest(self, rows: DataFrame, p: Path, chosen, types, bound: set[str]) -> DataFrame:
        """Breadth first from the distinct starts; of the paths to a node one stays (the least), or all of its level."""
        r, (a, b) = p.rels[0], (p.nodes[0].name, p.nodes[1].name)
        ends = b not in bound and a != b
        if a not in bound:
            rows = rows.crossJoin(self.scan(a, chosen[a]))
            bound.add(a)
        name = p.name or self.anonymous()
        e = written(self.edges(types[r.name], "~s", "~d", "~k", props=False).select("~s", "~d", F.col("~k").cast("string").alias("~k")))
        key = e.schema["~d"].dataType
        front = written(rows.select(_c(a).cast(key).alias("~a")).distinct().select("~a", F.col("~a").alias("~z"), F.array("~a").alias(name), F.array().cast("array<string>").alias(f"{name}:rels")))
        out = front if r.low == 0 else None
        seen = front.select("~a", "~z")
        for _ in range(r.high if r.high is not None else 1_000_000):
            new = front.join(e, _c("~z") == _c("~s")).select("~a", F.col("~d").alias("~z"), F.array_append(_c(name), _c("~d")).alias(name), F.array_append(_c(f"{name}:rels"), _c("~k")).alias(f"{name}:rels"))
            new = new.join(seen, ["~a", "~z"], "left_anti")
            if p.shortest == "shortestpath":
                new = new.groupBy("~a", "~z").agg(F.min(F.struct(_c(name), _c(f"{name}:rels"))).alias("~p")).select("~a", "~z", F.col("~p").getField(name).alias(name), F.col("~p").getField(f"{name}:rels").alias(f"{name}:rels"))
            front = written(new)
            if front.isEmpty():
                break
            out = front if out is None else out.unionByName(front)
            seen = seen.unionByName(front.select("~a", "~z").distinct())
        found = front if out is None else out
        found = found.withColumn(f"{name}:length", F.size(_c(f"{name}:rels")).cast("long"))
        bound.add(r.name)
        if ends:  # what is reached are the ends
            bound.add(b)
            rows = rows.join(found, _c(a) == _c("~a")).drop("~a").withColumnRenamed("~z", b).join(self.scan(b, chosen[b]), b)
            return rows.withColumn(r.name, _c(f"{name}:rels"))
        return rows.join(found, (_c(a) == _c("~a")) & (_c(b) == _c("~z"))).drop("~a", "~z").withColumn(r.name, _c(f"{name}:rels"))

    # expressions, from the loosest operator to the tightest

    def type_of(self, v: Column) -> T.DataType:
        t = next(self.told) if self.told is not None else self.current().select(v.alias("x")).schema["x"].dataType
        if self.met is not None:
            self.met.append(t)
        return t

    def expression(self) -> Column:
        v = self.xor()
        while self.take("OR"):
            v = v | self.xor()
        return v

    def xor(self) -> Column:
        v = self.conjunction()
        while self.take("XOR"):
            v = v.cast("boolean") != self.conjunction()
        return v

    def conjunction(self) -> Column:
        v = self.negation()
        while self.take("AND"):
            v = v & self.negation()
        return v

    def negation(self) -> Column:
        return ~self.negation() if self.take("NOT") else self.comparison()

    def comparison(self) -> Column:
        a = self.sum()
        out: Column | None = None
        while True:
            op = next((o for o in ("=", "<>", "<=", ">=", "<", ">", "=~") if self.peek(o)), None)
            if op:
                self.i += 1
                b = self.sum()
                one = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "=~": lambda x, y: F.regexp(x, F.concat(F.lit("^(?:"), y, F.lit(")$")))}[op](a, b)
                out, a = one if out is None else out & one, b
            elif self.take("IS"):
                no = self.take("NOT")
                if self.take("TYPED") or (self.take(":") and (self.need(":") or True)):
                    a = out = self.typed(a, no)
                    continue
                self.need("NULL")
                a = out = a.isNotNull() if no else a.isNull()
            elif self.take("IN"):
                a = out = F.array_contains(self.sum(), a)
            elif self.take("STARTS"):
                self.need("WITH")
                a = out = F.startswith(a, self.sum())
            elif self.take("ENDS"):
                self.need("WITH")
                a = out = F.endswith(a, self.sum())
            elif self.take("CONTAINS"):
                a = out = F.contains(a, self.sum())
            else:
                return a if out is None else out

    def typed(self, v: Column, no: bool) -> Column:
        """IS [NOT] :: TYPE [NOT NULL]: null is of every type that isn't NOT NULL."""
        own, held = library.type_name(self.type_of(v)), False
        while True:
            name = self.name().upper()
            if name in ("ZONED", "LOCAL"):
                name += f" {self.name().upper()}"
            if name == "LIST":
                self.need("<")
                inner = self.name().upper()
                self.need(">")
                name = f"LIST<{inner}>"
            full = self.take("NOT") and (self.need("NULL") or True)
            null = F.lit(False) if full else v.isNull()
            alike = own.replace(" NOT NULL", "") == name or name in ("ANY", "INT" if own == "INTEGER" else "", "BOOL" if own == "BOOLEAN" else "")
            one = F.when(v.isNull(), null).otherwise(F.lit(alike))
            held = one if held is False else held | one
            if not self.take("|"):
                return ~held if no else held

    def sum(self) -> Column:
        a = self.term()
        while True:
            if self.take("+"):
                b = self.term()
                x, y = self.type_of(a), self.type_of(b)
                if isinstance(x, T.ArrayType) or isinstance(y, T.ArrayType):
                    a = F.concat(a if isinstance(x, T.ArrayType) else F.array(a), b if isinstance(y, T.ArrayType) else F.array(b))
                elif isinstance(x, T.StringType) or isinstance(y, T.StringType):
                    a = F.concat(a.cast("string"), b.cast("string"))
                else:
                    a = a + b
            elif self.take("-"):
                a = a - self.term()
            else:
                return a

    def term(self) -> Column:
        a = self.power()
        while True:
            if self.take("*"):
                a = a * self.power()
            elif self.take("/"):
                b = self.power()
                whole = all(isinstance(self.type_of(v), T.IntegralType) for v in (a, b))
                a = F.call_function("div", a, b) if whole else a / b
            elif self.take("%"):
                a = a % self.power()
            else:
                return a

    def power(self) -> Column:
        a = self.unary()
        while self.take("^"):
            a = F.pow(a, self.unary())
        return a

    def unary(self) -> Column:
        if self.take("-"):
            return -self.unary()
        self.take("+")
        return self.postfix()

    def postfix(self) -> Column:
        v = self.atom()
        while True:
            if self.take("."):
                v = v.getField(self.name())
            elif self.take("["):
                low = None if self.peek("..") else self.expression()
                if self.take(".."):
                    high = None if self.peek("]") else self.expression()
                    n = F.size(v)
                    place = lambda c, n=n: F.greatest(F.lit(0), F.least(n, F.when(c < 0, n + c).otherwise(c)))
                    start, end = F.lit(0) if low is None else place(low), n if high is None else place(high)
                    v = F.slice(v, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
                elif isinstance(self.type_of(v), T.ArrayType):
                    v = F.get(v, F.when(low < 0, F.size(v) + low).otherwise(low).cast("int"))
                else:
                    v = v[low]
                self.need("]")
            else:
                return v

    def value(self, name: str) -> Column:
        """A variable as a value: of a node or relationship the struct of its id, label and properties."""
        v = self.scope[name]
        if not isinstance(v, Var):
            return v
        if v.kind in ("path", "rels"):
            return _c(name)
        held = [c for c in self.columns_of(name) if c.startswith(f"{name}.")]
        return F.when(_c(name).isNotNull(), F.struct(_c(name).alias("id"), _c(f"{name}:label").alias("label"), *[_c(c).alias(c[len(name) + 1 :]) for c in held]))

    def atom(self) -> Column:
        kind = self.kind()
        if kind == "num":
            t = self.next()
            return F.lit(int(t) if t.isdigit() else float(t))
        if kind == "str":
            return F.lit(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), self.next()[1:-1]))
        if kind == "param":
            v = self.params[self.next()[1:]]
            return F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
        if self.peek("("):
            return self.pattern_or_group()
        if self.take("["):
            return self.list_()
        if self.peek("{"):
            m = self.properties()
            return F.struct(*[v.alias(k) for k, v in m.items()])
        if self.peek("CASE"):
            return self.case()
        if self.peek("EXISTS", "COUNT", "COLLECT") and self.peek("{", ahead=1):
            return self.subquery(self.next().upper())
        for word, v in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return F.lit(v)
        name = self.name()
        while self.peek(".") and name not in self.scope and self.kind(1) == "name":
            self.i += 1
            name += f".{self.name()}"
        if self.peek("(") and name not in self.scope:
            return self.call(name.lower())
        if name not in self.scope:
            raise CypherError(f"{name} isn't defined")
        v = self.scope[name]
        if self.peek("{") and self.peek(".", ahead=1) or (self.peek("{") and self.peek("*", ahead=2)):
            return self.projected(name)
        if isinstance(v, Var) and v.kind in ("node", "rel"):
            if self.take("."):
                key = f"{name}.{self.name()}"
                return _c(key) if key in self.current().columns else F.lit(None)
            if self.peek(":") and self.kind(1) == "name":
                return _c(f"{name}:label").isin(*self.alternatives())
            return _c(name) if self.peek("=", "<>", "IS", ")", ",", "]") or self.toks[self.i - 2][1] in ("=", "<>") else self.value(name)
        return self.value(name)

    def projected(self, name: str) -> Column:
        """variable {.property, .*, key: value, other}: a map of some of it."""
        v = self.scope[name]
        node = isinstance(v, Var)
        held = {c[len(name) + 1 :]: _c(c) for c in self.columns_of(name) if c.startswith(f"{name}.")} if node else {}
        if not node and isinstance(self.type_of(v), T.StructType):
            held = {f.name: v.getField(f.name) for f in self.type_of(v).fields}
        out: dict[str, Column] = {}
        self.need("{")
        while not self.take("}"):
            if self.take("."):
                if self.take("*"):
                    out |= held
                else:
                    key = self.name()
                    out[key] = held.get(key, F.lit(None) if node else v.getField(key) if not isinstance(self.type_of(v), T.StructType) else F.lit(None))
            else:
                key = self.name()
                out[key] = self.expression() if self.take(":") else self.value(key)
            self.take(",")
        made = F.struct(*[x.alias(k) for k, x in out.items()])
        return F.when(_c(name).isNotNull(), made) if node else made

    def pattern_or_group(self) -> Column:
        depth, k = 0, self.i
        while k < len(self.toks):
            depth += {"(": 1, ")": -1}.get(self.toks[k][1], 0)
            k += 1
            if not depth:
                break
        after = [t for _, t in self.toks[k : k + 3]]
        node = self.kind(1) == "name" and self.toks[self.i + 2][1] in (")", ":", "{") or self.toks[self.i + 1][1] in (")", ":")
        if node and (after[:2] in (["-", "["], ["<", "-"], ["-", "-"])):
            return self.related([self.path()], None) > 0
        self.need("(")
        v = self.expression()
        self.need(")")
        return v

    def related(self, paths: list[Path], where: Callable[[], Column] | None, collected: Callable[[], Column] | None = None) -> Column:
        """How many matches each row has, or the list of what is collected of them: one grouping of the pattern by the variables shared with the row, joined back."""
        outer_rows, outer = self.current(), self.scope
        for n in (n for p in paths for n in p.nodes):
            held = outer.get(n.name)
            if isinstance(held, Var) and held.labels:  # a variable of the row has the labels that it has there
                n.labels = tuple(x for x in held.labels if not n.labels or x in n.labels)
        rows, inner = self.bind(None, {}, paths)
        shared = [v for v in inner if v in outer]
        shared += [f"{v}:label" for v in shared if isinstance(outer[v], Var) and f"{v}:label" in outer_rows.columns and f"{v}:label" in rows.columns]
        if not shared:
            raise CypherError("a pattern in an expression must share a variable with the row")
        self.rows, self.scope = rows, inner
        try:
            if where:
                self.rows = self.rows.filter(where())
            found = F.collect_list(collected()) if collected else F.count("*")
        finally:
            rows, self.rows, self.scope = self.rows, outer_rows, outer
        name = self.anonymous()
        self.rows = outer_rows.join(rows.groupBy(*shared).agg(found.alias(name)), shared, "left")
        return F.coalesce(_c(name), F.array() if collected else F.lit(0))

    def returned(self) -> Column:
        self.need("RETURN")
        return self.expression()

    def subquery(self, what: str) -> Column:
        self.need("{")
        self.take("MATCH")
        paths = self.patterns()
        n = self.related(paths, self.expression if self.take("WHERE") else None, self.returned if what == "COLLECT" else None)
        self.need("}")
        return n > 0 if what == "EXISTS" else n

    def inside(self, names: dict[str, Column], stop: Callable[[], Any]) -> Any:
        """Parse with names standing for elements of lists."""
        held = self.scope
        self.scope = held | names
        try:
            return stop()
        finally:
            self.scope = held

    def over(self, names: dict[str, Column]) -> Callable[..., Column]:
        """The next expression as a function of names, whose values here are nulls of their types. It is read once with these, which tells the types met, and again for each use."""
        start = self.i
        outer, self.met = self.met, []
        self.inside(names, self.expression)
        met, self.met = self.met, outer
        if outer is not None:
            outer += met
        end = self.i

        def f(*xs: Column) -> Column:
            held = self.i, self.met, self.told
            self.i, self.met, self.told = start, None, iter(met)
            try:
                return self.inside(dict(zip(names, xs, strict=True)), self.expression)
            finally:
                self.i, self.met, self.told = held

        self.i = end
        return f

    def element(self, v: Column) -> Column:
        t = self.type_of(v)
        return F.lit(None).cast(t.elementType) if isinstance(t, T.ArrayType) else F.lit(None)

    def list_(self) -> Column:
        if self.kind() == "name" and self.peek("IN", ahead=1):
            name = self.name()
            self.need("IN")
            v = self.expression()
            if self.take("WHERE"):
                v = F.filter(v, _one(self.over({name: self.element(v)})))
            if self.take("|"):
                v = F.transform(v, _one(self.over({name: self.element(v)})))
            self.need("]")
            return v
        out = []
        while not self.take("]"):
            out.append(self.expression())
            self.take(",")
        return F.array(*out)

    def case(self) -> Column:
        self.need("CASE")
        of = None if self.peek("WHEN") else self.expression()
        out: Any = F
        while self.take("WHEN"):
            test = self.expression()
            self.need("THEN")
            out = out.when(test if of is None else of == test, self.expression())
        if self.take("ELSE"):
            out = out.otherwise(self.expression())
        self.need("END")
        return out

    def call(self, name: str) -> Column:
        self.need("(")
        space, _, bare = name.partition(".")
        if space in ("node", "rel") and bare in ("id", "labels", "type", "startnode", "endnode", "properties", "keys"):
            name = bare
        elif space == "node":
            return self.around(bare)
        elif space == "path" and self.kind() == "name" and isinstance(self.scope.get(self.toks[self.i][1]), Var):
            return self.of_path(bare)
        if name == "file" and self.take(")"):
            return _c("~csv:file")
        if name in ("all", "any", "none", "single") and self.peek("IN", ahead=1):
            x = self.name()
            self.need("IN")
            v = self.expression()
            self.need("WHERE")
            f = _one(self.over({x: self.element(v)}))
            self.need(")")
            return {"all": lambda: F.forall(v, f), "any": lambda: F.exists(v, f), "none": lambda: ~F.exists(v, f), "single": lambda: F.size(F.filter(v, f)) == 1}[name]()
        if name == "reduce":
            total = self.name()
            self.need("=")
            first = self.expression()
            self.need(",")
            x = self.name()
            self.need("IN")
            v = self.expression()
            self.need("|")
            kind, start = self.type_of(first), self.i
            if isinstance(kind, T.IntegralType):
                kind = T.LongType()
            elif isinstance(kind, T.NullType):
                kind = T.StringType()
            step = self.over({total: F.lit(None).cast(kind), x: self.element(v)})
            grown = self.type_of(step(F.lit(None).cast(kind), self.element(v)))
            if isinstance(kind, T.LongType) and isinstance(grown, T.FractionalType):  # a fraction is added to a whole number
                kind, self.i = T.DoubleType(), start
                step = self.over({total: F.lit(None).cast(kind), x: self.element(v)})
            out = F.aggregate(v, first.cast(kind), lambda acc, item: step(acc, item).cast(kind))
            self.need(")")
            return out
        if name in _AGGREGATES:
            distinct = self.take("DISTINCT")
            if name == "count" and self.take("*"):
                self.need(")")
                self.aggregated = True
                return F.count("*")
            args = self.arguments()
            self.aggregated = True
            if distinct and name == "avg":
                return F.sum_distinct(args[0]) / F.count_distinct(args[0])
            return (_DISTINCT if distinct else _AGGREGATES)[name](*args)
        if name in ("id", "elementid", "labels", "type", "keys", "properties", "nodes", "relationships", "length", "startnode", "endnode") and self.kind() == "name" and self.toks[self.i][1].strip("`") in self.scope and self.peek(")", ahead=1):
            v = self.name()
            self.need(")")
            held = [c[len(v) + 1 :] for c in self.columns_of(v) if c.startswith(f"{v}.")]
            made = {
                "id": lambda: _c(v), "elementid": lambda: _c(v).cast("string"), "labels": lambda: F.array(_c(f"{v}:label")), "type": lambda: _c(f"{v}:label"), "properties": lambda: F.struct(*[_c(f"{v}.{p}").alias(p) for p in held]),
                "keys": lambda: F.array_compact(F.array(*[F.when(_c(f"{v}.{p}").isNotNull(), p) for p in held])), "nodes": lambda: _c(v), "relationships": lambda: _c(f"{v}:rels"), "length": lambda: _c(f"{v}:length"),
                "startnode": lambda: _c(f"{v}:from"), "endnode": lambda: _c(f"{v}:to"),
            }
            return made[name]()
        args = self.arguments()
        if name in ("size", "length"):
            return (F.size(args[0]) if isinstance(self.type_of(args[0]), T.ArrayType | T.MapType) else F.char_length(args[0])).cast("long")
        if name == "substring":
            return F.substr(args[0], args[1] + 1, *args[2:])
        if name == "split":
            return F.split(args[0], F.concat(F.lit("\\Q"), args[1], F.lit("\\E")))
        if name == "isempty":
            return F.size(args[0]) == 0 if isinstance(self.type_of(args[0]), T.ArrayType | T.MapType) else F.length(args[0].cast("string")) == 0
        if name in library.CYPHER:
            return library.CYPHER[name](self, *args)
        if name == "exists":
            return args[0].isNotNull()
        if name not in _FUNCTIONS:
            raise CypherError(f"there is no function {name}")
        return _FUNCTIONS[name](*args)

    def around(self, what: str) -> Column:
        """node.degree, .degree.in, .degree.out (node [, types [, direction]]), node.relationship.exists and .types: counts of a pattern round the node."""
        name = self.name()
        given: list[Any] = []
        while not self.take(")"):
            if self.take(","):
                given.append(self.constant_value())
        types = next(([x] if isinstance(x, str) else x for x in given if isinstance(x, list) or (isinstance(x, str) and x.upper() not in ("IN", "OUT", "BOTH"))), [])
        way = {"degree.in": "in", "degree.out": "out"}.get(what) or next((x.lower() for x in given if isinstance(x, str) and x.upper() in ("IN", "OUT", "BOTH")), "both")
        rel = Rel(self.anonymous(), tuple(types or ()), {}, way)
        path = Path(None, [Node(name, (), {}), Node(self.anonymous(), (), {})], [rel])
        none = not any(x in self.graph.ends[t] for t in types or self.graph.edges for x in self.scope[name].labels)
        if what == "relationship.types":
            return F.array().cast("array<string>") if none else F.sort_array(F.array_distinct(self.related([path], None, lambda: _c(f"{rel.name}:label"))))
        side = {"out": (0,), "in": (1,)}.get(way, (0, 1))
        none = not any(self.graph.ends[t][k] in self.scope[name].labels for t in types or self.graph.edges for k in side)
        n = F.lit(0) if none else self.related([path], None)
        if what == "relationship.exists":
            return n > 0
        if not what.startswith("degree"):
            raise CypherError(f"there is no function node.{what}")
        return n

    def of_path(self, what: str) -> Column:
        """path.elements, path.slice and path.combine of variables of paths: nodes are their ids."""
        name = self.name()
        nodes, rels = _c(name), _c(f"{name}:rels")
        if what == "combine":
            self.need(",")
            other = self.name()
            self.need(")")
            return F.concat(nodes, L.tail(_c(other)))
        self.take(",")
        args = self.arguments()
        if what == "elements":
            return F.flatten(F.transform(nodes.cast("array<string>"), lambda x, i: F.when(i < F.size(rels), F.array(x, F.get(rels, i))).otherwise(F.array(x))))
        if what == "slice":
            to = F.size(rels) if len(args) < 2 else F.least(args[1], F.size(rels))
            return F.slice(nodes, (args[0] + 1).cast("int"), F.greatest(to - args[0] + 1, F.lit(0)).cast("int"))
        raise CypherError(f"there is no function path.{what}")

    def arguments(self) -> list[Column]:
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out


def _one(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(x)
