"""Plane geometry over WKT texts: points, line strings, polygons (a ring without holes). What takes loops over corners runs in Python on Arrow batches."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .library import CYPHER, SQL

Point = tuple[float, float]
_NEAR = 1e-12
_TEXT = re.compile(r"\s*(POINT|LINESTRING|POLYGON)\s*\((.*)\)\s*$", re.I | re.S)


def parse(wkt: str) -> tuple[str, list[Point]]:
    """The kind and the corners; of a polygon the ring, closed."""
    m = _TEXT.match(wkt)
    if not m:
        raise ValueError(f"no geometry: {wkt[:40]!r}")
    kind, inner = m[1].upper(), m[2].replace("(", " ").replace(")", " ")
    corners = [(float(p.split()[0]), float(p.split()[1])) for p in inner.split(",")]
    if kind == "POLYGON" and corners[0] != corners[-1]:
        corners.append(corners[0])
    return kind, corners


def _number(x: float) -> str:
    return f"{x:.12g}"


def shown(kind: str, corners: list[Point]) -> str:
    inner = ", ".join(f"{_number(x)} {_number(y)}" for x, y in corners)
    return f"{kind} (({inner}))" if kind == "POLYGON" else f"{kind} ({inner})"


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(p: Point, a: Point, b: Point) -> bool:
    size = max(math.dist(a, b), _NEAR)
    return abs(_turn(a, b, p)) <= _NEAR * size * max(1.0, size) and min(a[0], b[0]) - _NEAR <= p[0] <= max(a[0], b[0]) + _NEAR and min(a[1], b[1]) - _NEAR <= p[1] <= max(a[1], b[1]) + _NEAR


def _edges(g: tuple[str, list[Point]]) -> list[tuple[Point, Point]]:
    return list(zip(g[1], g[1][1:])) or [(g[1][0], g[1][0])]


def place(p: Point, g: tuple[str, list[Point]]) -> str:
    """inside, edge or outside. A point has an inside only; of a line the ends are its edge."""
    kind, corners = g
    if kind == "POINT":
        return "inside" if math.dist(p, corners[0]) <= _NEAR else "outside"
    if any(_on(p, a, b) for a, b in _edges(g)):
        return "inside" if kind == "LINESTRING" and (corners[0] == corners[-1] or (math.dist(p, corners[0]) > _NEAR and math.dist(p, corners[-1]) > _NEAR)) else "edge"
    if kind == "LINESTRING":
        return "outside"
    odd = False
    for (x1, y1), (x2, y2) in _edges(g):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            odd = not odd
    return "inside" if odd else "outside"


def _pieces(a, b) -> list[tuple[Point, Point]]:
    """The edges of a, cut where edges of b meet them."""
    out = []
    for p, q in _edges(a):
        cuts = {0.0, 1.0}
        dx, dy = q[0] - p[0], q[1] - p[1]
        size = dx * dx + dy * dy
        for r, s in _edges(b):
            ex, ey = s[0] - r[0], s[1] - r[1]
            cross = dx * ey - dy * ex
            if abs(cross) > _NEAR:
                t = ((r[0] - p[0]) * ey - (r[1] - p[1]) * ex) / cross
                u = ((r[0] - p[0]) * dy - (r[1] - p[1]) * dx) / cross
                if -_NEAR <= t <= 1 + _NEAR and -_NEAR <= u <= 1 + _NEAR:
                    cuts.add(min(1.0, max(0.0, t)))
            elif size:
                cuts |= {min(1.0, max(0.0, ((c[0] - p[0]) * dx + (c[1] - p[1]) * dy) / size)) for c in (r, s) if _on(c, p, q)}
        at = sorted(cuts)
        out += [((p[0] + t * dx, p[1] + t * dy), (p[0] + u * dx, p[1] + u * dy)) for t, u in zip(at, at[1:]) if u - t > _NEAR]
    return out or [(a[1][0], a[1][0])]


def _places(a, b) -> set[str]:
    """Where pieces of a's corners and edges lie in b."""
    return {place(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), b) for p, q in _pieces(a, b)}


def _within(g) -> Point:
    """A point inside a polygon, or of a line or point."""
    kind, corners = g
    if kind != "POLYGON":
        (a, b), *_ = _edges(g)
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    for i in range(len(corners) - 1):
        for j in range(i + 2, len(corners) - 1):
            p = ((corners[i][0] + corners[j][0]) / 2, (corners[i][1] + corners[j][1]) / 2)
            if place(p, g) == "inside":
                return p
    return sum(x for x, _ in corners[:-1]) / (len(corners) - 1), sum(y for _, y in corners[:-1]) / (len(corners) - 1)


def intersects(a, b) -> bool:
    corners = any(place(p, b) != "outside" for p in a[1]) or any(place(p, a) != "outside" for p in b[1])
    return corners or "outside" not in _places(a, b) or bool(_places(a, b) - {"outside"}) or any(_meet(e, f) for e in _edges(a) for f in _edges(b))


def _meet(e, f) -> bool:
    (p, q), (r, s) = e, f
    return (_turn(p, q, r) > 0) != (_turn(p, q, s) > 0) and (_turn(r, s, p) > 0) != (_turn(r, s, q) > 0)


def _insides_meet(a, b) -> bool:
    if "POINT" in (a[0], b[0]):
        p, g = (a[1][0], b) if a[0] == "POINT" else (b[1][0], a)
        return place(p, g) == "inside"
    if a[0] == b[0] == "LINESTRING":
        crossing = [r for e in _pieces(a, b) for r in e]
        return "inside" in _places(a, b) or any(place(p, a) == "inside" and place(p, b) == "inside" for p in crossing)
    if a[0] != b[0]:  # a line and a polygon: the line's inside is the line
        return "inside" in (_places(a, b) if a[0] == "LINESTRING" else _places(b, a))
    return "inside" in _places(a, b) | _places(b, a) or place(_within(a), b) == "inside" or place(_within(b), a) == "inside"


def contains(a, b) -> bool:
    return all(place(p, a) != "outside" for p in b[1]) and "outside" not in _places(b, a) and _insides_meet(a, b)


def equals(a, b) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] == "POINT":
        return place(a[1][0], b) == "inside"
    return "outside" not in _places(a, b) | _places(b, a) and (a[0] == "LINESTRING" or (_places(a, b) == {"edge"} and _places(b, a) == {"edge"}))


_SIZE = {"POINT": 0, "LINESTRING": 1, "POLYGON": 2}


def crosses(a, b) -> bool:
    if _SIZE[a[0]] > _SIZE[b[0]]:
        a, b = b, a
    if a[0] == "LINESTRING" and b[0] == "POLYGON":
        return {"inside", "outside"} <= _places(a, b)
    if a[0] == b[0] == "LINESTRING":
        return _insides_meet(a, b) and not {"inside", "edge"} & _places(a, b)
    return False


def overlaps(a, b) -> bool:
    if a[0] != b[0] or a[0] == "POINT":
        return False
    shared = _insides_meet(a, b) if a[0] == "POLYGON" else "inside" in _places(a, b)
    return shared and not contains(a, b) and not contains(b, a)


def distance(a, b) -> float:
    """Between the nearest points, in the units of the coordinates."""
    if intersects(a, b):
        return 0.0

    def far(p: Point, e) -> float:
        (x1, y1), (x2, y2) = e
        size = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = 0.0 if not size else max(0.0, min(1.0, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / size))
        return math.dist(p, (x1 + t * (x2 - x1), y1 + t * (y2 - y1)))

    return min([far(p, e) for p in a[1] for e in _edges(b)] + [far(p, e) for p in b[1] for e in _edges(a)])


def area(g) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in _edges(g))) / 2 if g[0] == "POLYGON" else 0.0


def envelope(g) -> str:
    xs, ys = [x for x, _ in g[1]], [y for _, y in g[1]]
    a, b, c, d = min(xs), min(ys), max(xs), max(ys)
    return shown("POLYGON", [(a, b), (c, b), (c, d), (a, d), (a, b)])


def buffer(g, size: float, quarter: int = 8) -> str:
    """The hull of circles round the corners: exact for points and convex shapes."""
    steps = 4 * quarter
    points = sorted({(round(x + size * math.cos(2 * math.pi * k / steps), 12), round(y + size * math.sin(2 * math.pi * k / steps), 12)) for x, y in g[1] for k in range(steps)})
    hull: list[list[Point]] = [[], []]
    for half, order in zip(hull, (points, points[::-1]), strict=True):
        for p in order:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
    ring = hull[0][:-1] + hull[1][:-1]
    return shown("POLYGON", [*ring, ring[0]])


def geo_json(g) -> str:
    kind, corners = g
    points = [list(p) for p in corners]
    name = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}[kind]
    return json.dumps({"type": name, "coordinates": points[0] if kind == "POINT" else [points] if kind == "POLYGON" else points}, separators=(",", ":"))


def _udf(kind: str, shapes: int, f: Callable) -> Callable[..., Column]:
    """A function whose first arguments are WKT texts; null where one is null. Rows of a batch with the same arguments are worked out once."""
    import pandas as pd

    def call(q, *args: Column) -> Column:
        def run(*cols):
            rows = list(zip(*cols, strict=True))
            known = {x: None if any(v is None or v != v for v in x) else f(*[parse(v) if k < shapes else v for k, v in enumerate(x)]) for x in dict.fromkeys(rows)}
            return pd.Series([known[x] for x in rows], dtype=object)

        return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(*args)

    return call


def _text(kind: str, pairs: Column) -> Column:
    inner = F.array_join(F.transform(pairs.cast("array<array<double>>"), lambda p: F.concat(_plain(F.get(p, F.lit(0))), F.lit(" "), _plain(F.get(p, F.lit(1))))), ", ")
    return F.concat(F.lit(f"{kind} (("), inner, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(f"{kind} ("), inner, F.lit(")"))


def _plain(x: Column) -> Column:
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def _rectangle(q, a, b, c, d):
    return _text("POLYGON", F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]))


def _point(q, x, y):
    return F.concat(F.lit("POINT ("), _plain(x), F.lit(" "), _plain(y), F.lit(")"))


_closed = lambda v: F.when(F.get(v, F.lit(0)) == F.element_at(v, -1), v).otherwise(F.array_append(v, F.get(v, F.lit(0))))
_part = lambda k: lambda q, g: F.regexp_extract(g, r"POINT\s*\(\s*(\S+)\s+([^)\s]+)", k).try_cast("double")
_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "geo.point": _point, "geo.linestring": lambda q, v: _text("LINESTRING", v), "geo.polygon": lambda q, v: _text("POLYGON", _closed(v)), "geo.geomfromtext": _udf("string", 1, lambda g: shown(*g)), "geo.astext": _udf("string", 1, lambda g: shown(*g)),
    "geo.asgeojson": _udf("string", 1, geo_json), "geo.x": _part(1), "geo.y": _part(2), "geo.area": _udf("double", 1, area), "geo.envelope": _udf("string", 1, envelope), "geo.buffer": _udf("string", 1, lambda g, d: buffer(g, float(d))), "geo.distance": _udf("double", 2, distance),
    "geo.contains": _udf("boolean", 2, contains), "geo.within": _udf("boolean", 2, lambda a, b: contains(b, a)), "geo.intersects": _udf("boolean", 2, intersects), "geo.disjoint": _udf("boolean", 2, lambda a, b: not intersects(a, b)),
    "geo.touches": _udf("boolean", 2, lambda a, b: intersects(a, b) and not _insides_meet(a, b)), "geo.crosses": _udf("boolean", 2, crosses), "geo.overlaps": _udf("boolean", 2, overlaps), "geo.equals": _udf("boolean", 2, equals),
    "geo.dwithin": _udf("boolean", 2, lambda a, b, d: distance(a, b) <= float(d)), "rectangle": _rectangle, "circle": lambda q, x, y, d: _FUNCTIONS["geo.buffer"](q, _point(q, x, y), d),
}
SQL.update(_FUNCTIONS)
CYPHER.update({k: v for k, v in _FUNCTIONS.items() if k.startswith("geo.")})
