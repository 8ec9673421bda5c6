"""Registered queries over the function libraries, procedures and conditions of both languages, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pattern import Graph
from ..sources.tables import table
from .cypher import cypher
from .dialect import sql
from .queries import _BOTH, _MB, ORACLES, QUERIES, _rank_sql, _wcc_sql, bought, graph, market, market_lines


def _text(kind: str, name: str, text: str, oracle: str, of: Callable[[SparkSession, str], Graph] = graph, after: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    compiled = cypher if kind == "cypher" else sql

    def run(spark, d):
        return after(compiled(of(spark, d), text))

    QUERIES[f"{kind}_{name}"] = run
    ORACLES[f"{kind}_{name}"] = oracle


_text(
    "cypher", "text_functions",
    """MATCH (p:Part) WITH p.p_partkey AS k, p.p_name AS n, p.p_type AS t, p.p_brand AS b
    RETURN k, text.code(n) AS code, text.lpad(b, 12, '*') AS lp, text.rpad(b, 12, '*') AS rp, text.replace(t, 'A', '-') AS rep, text.regexReplace(t, '[AEIOU]', '') AS rx, text.join(text.split(t, ' '), '_') AS joined, text.hexValue(k) AS hx,
    text.hammingDistance(left(b, 7), right(b, 7)) AS ham, text.levenshteinDistance(n, t) AS lev, text.format('%s:%d', b, k) AS fmt, text.capitalizeAll(toLower(t)) AS caps, text.decapitalizeAll(t) AS decaps, text.byteCount(n) AS bytes, text.charAt(n, 1) AS c1, text.indexOf(t, 'E') AS ix,
    text.capitalize(toLower(t)) AS cap, text.decapitalize(t) AS decap, text.swapCase(n) AS swapped, text.snakeCase(t) AS snake, text.slug(t) AS slug, text.camelCase(t) AS camel, text.upperCamelCase(t) AS upperCamel, text.levenshteinSimilarity(n, t) > 0.2 AS alike, size(text.random(4)) AS r""",
    r"""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_type AS t, p_brand AS b, string_split(lower(p_type), ' ') AS w FROM part)
    SELECT k, unicode(n) AS code, lpad(b, 12, '*') AS lp, rpad(b, 12, '*') AS rp, replace(t, 'A', '-') AS rep, regexp_replace(t, '[AEIOU]', '', 'g') AS rx, array_to_string(string_split(t, ' '), '_') AS joined, lower(hex(k)) AS hx, hamming(left(b, 7), right(b, 7)) AS ham,
    levenshtein(n, t) AS lev, b || ':' || k AS fmt, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') AS caps, array_to_string(list_transform(string_split(t, ' '), lambda x: lower(x[1]) || x[2:]), ' ') AS decaps, strlen(n) AS bytes, n[2] AS c1, instr(t, 'E') - 1 AS ix,
    upper(t[1]) || lower(t)[2:] AS cap, lower(t[1]) || t[2:] AS decap, array_to_string(list_transform(string_split(n, ''), lambda x: CASE WHEN x = lower(x) THEN upper(x) ELSE lower(x) END), '') AS swapped, array_to_string(w, '_') AS snake, array_to_string(w, '-') AS slug,
    w[1] || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || x[2:]), '') AS camel, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '') AS upperCamel, 1 - levenshtein(n, t) / greatest(length(n), length(t)) > 0.2 AS alike, 4 AS r FROM p""",
)
_text(
    "cypher", "math_functions",
    """MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal / 1000 AS x RETURN k, round(math.sinh(x), 3) AS sh, round(math.cosh(x), 3) AS ch, round(math.tanh(x), 6) AS th, round(math.sigmoid(x), 6) AS sg, round(math.sigmoidPrime(x), 6) AS sp, round(x, 1, 'UP') + 0.0 AS up,
    round(x, 1, 'DOWN') + 0.0 AS down, round(x, 0, 'CEILING') + 0.0 AS ceiling, round(x, 0, 'FLOOR') + 0.0 AS floor, math.maxLong() AS most, math.minLong() AS least, round(math.round(x)) AS near, round(atan2(x, 2), 6) AS at, round(exp(x) + log(abs(x) + 1) + sqrt(abs(x)) + log10(abs(x) + 1), 3) AS mix, sign(x) AS s, pi() > e() AS bigger""",
    """WITH c AS (SELECT c_custkey AS k, c_acctbal / 1000 AS x FROM customer) SELECT k, round(sinh(x), 3) AS sh, round(cosh(x), 3) AS ch, round(tanh(x), 6) AS th, round(1 / (1 + exp(-x)), 6) AS sg, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS sp, sign(x) * ceil(abs(x * 10)) / 10 + 0.0 AS up,
    sign(x) * floor(abs(x * 10)) / 10 + 0.0 AS down, ceil(x) + 0.0 AS ceiling, floor(x) + 0.0 AS floor, 9223372036854775807 AS most, -9223372036854775808 AS least, floor(x + 0.5) + 0.0 AS near, round(atan2(x, 2), 6) AS at, round(exp(x) + ln(abs(x) + 1) + sqrt(abs(x)) + log10(abs(x) + 1), 3) AS mix, CAST(sign(x) AS BIGINT) AS s, true AS bigger FROM c""",
)
_text(
    "cypher", "date_functions",
    """MATCH (o:Order) WITH o.o_orderkey AS k, o.o_orderdate AS t RETURN k, date.add(date.field(t, 'day'), 2, 'h') AS added, date.field(t, 'year') AS y, date.field(t, 'month') AS m, date.field(t, 'dayOfWeek') AS dow, date.field(t, 'dayOfYear') AS doy, date.field(t, 'week') AS w, date.format(t, 'yyyy/MM/dd') AS f,
    date.toISO8601(t) AS iso, date.convert(k, 'h', 'm') AS mins, date.parse(format(t, 'yyyy-MM-dd'), 'yyyy-MM-dd') AS ms, date.fields(format(t, 'yyyy-MM-dd'), 'yyyy-MM-dd').month AS fm, toString(date.truncate('month', t)) AS first, datetime.truncate('year', t) = localdatetime.truncate('year', t) AS same,
    duration.inDays(date('1990-01-01'), t).days AS days, duration.inMonths(date('1990-01-31'), t).months AS months, duration.between(date('1990-01-01'), t).months AS between, duration.inSeconds(date('1990-01-01'), t).seconds AS secs, localtime.truncate('hour', localtime('10:20:30')) AS hour,
    date.fromISO8601('1990-01-01T00:00:00Z') AS epoch, datetime.fromEpochMillis(k) > datetime.fromEpoch(0, 0) AS later, duration('P1Y2M3DT4H').months AS d""",
    """SELECT o_orderkey AS k, day(o_orderdate) + 7200000 AS added, year(o_orderdate) AS y, month(o_orderdate) AS m, isodow(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, week(o_orderdate) AS w, strftime(o_orderdate, '%Y/%m/%d') AS f, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, o_orderkey * 60 AS mins,
    epoch_ms(date_trunc('day', o_orderdate)) AS ms, month(o_orderdate) AS fm, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS first, true AS same, date_diff('day', TIMESTAMP '1990-01-01', date_trunc('day', o_orderdate)) AS days, datesub('month', TIMESTAMP '1990-01-31', o_orderdate) AS months,
    datesub('month', TIMESTAMP '1990-01-01', o_orderdate) AS between, epoch_us(o_orderdate) // 1000000 - epoch(TIMESTAMP '1990-01-01')::BIGINT AS secs, 36000000000000 AS hour, epoch_ms(TIMESTAMP '1990-01-01') AS epoch, o_orderkey > 0 AS later, 14 AS d FROM orders""",
)
_text(
    "cypher", "list_functions",
    """MATCH (p:Part) WITH p.p_partkey AS k, range(1, p.p_size % 7 + 2) AS v, p.p_size AS s RETURN k, agg.first(v) AS f, agg.last(v) AS l, agg.nth(v, 1) AS n, agg.median(v) AS med, agg.product(v) AS prod, agg.slice(v, 0, 2) AS sl, agg.percentiles(v, [0.5])[0] AS p50, agg.statistics(v).mean AS mean,
    agg.statistics(v).count AS cnt, agg.maxItems(v, v).items AS mx, agg.minItems(v, v).value AS mn, coll.flatten([v, v]) AS fl, size(coll.pairsMin(v)) AS pairs, coll.remove(v, 0) AS rest, coll.toSet(v + v) AS st, size(coll.unionAll(v, v)) AS un, coll.indexOf(v, 2) AS ix, coll.insert(v, 0, 0)[0] AS ins,
    coll.max(v) AS most, convert.toList(s)[0] AS tl, toStringList(v)[0] AS ts, toFloatList(v)[0] AS tf, toIntegerList(v)[0] AS ti, toBooleanList(['true'])[0] AS tb, convert.toString(s) AS cs, convert.toInteger(convert.toString(s)) AS ci, convert.toFloat('2.5') AS cf, convert.toBoolean(s) AS cb,
    convert.toJson(v) AS js, size(convert.fromJsonList(convert.toJson(v))) AS fj, valueType(s) AS vt, s IS :: INTEGER AS typed, isEmpty(tail(v)) AS empty, reduce(t = 0, x IN v | t + x) AS total""",
    """WITH p AS (SELECT p_partkey AS k, range(1, p_size % 7 + 3) AS v, p_size AS s FROM part) SELECT k, v[1] AS f, v[-1] AS l, v[2] AS n, list_median(v) AS med, list_product(v) AS prod, v[1:2] AS sl, list_median(v) AS p50, list_avg(v) AS mean, len(v) AS cnt, [v[-1]] AS mx, 1 AS mn, list_concat(v, v) AS fl,
    len(v) - 1 AS pairs, v[2:] AS rest, v AS st, 2 * len(v) AS un, 1 AS ix, 0 AS ins, v[-1] AS most, s AS tl, '1' AS ts, 1.0 AS tf, 1 AS ti, true AS tb, CAST(s AS VARCHAR) AS cs, s AS ci, 2.5 AS cf, s <> 0 AS cb, replace(CAST(v AS VARCHAR), ' ', '') AS js, len(v) AS fj, 'INTEGER NOT NULL' AS vt, true AS typed,
    len(v) = 1 AS empty, list_sum(v) AS total FROM p""",
    after=lambda df: df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("sl", "mx", "fl", "rest", "st")}),
)
ORACLES["cypher_list_functions"] = f"SELECT * REPLACE ({', '.join(f'array_to_string({c}, chr(44)) AS {c}' for c in ('sl', 'mx', 'fl', 'rest', 'st'))}) FROM ({ORACLES['cypher_list_functions']})"
_text(
    "cypher", "map_functions",
    """MATCH (n:Nation) WITH n.n_nationkey AS k, {a: n.n_name, b: 'x', c: toString(n.n_regionkey)} AS m RETURN k, convert.toJson(map.removeKey(m, 'a')) AS rk, convert.toJson(map.removeKeys(m, ['a', 'c'])) AS rks, convert.toJson(map.submap(m, ['b'])) AS sub, map.values(m, ['c', 'a'])[1] AS v,
    convert.toJson(map.setKey(m, 'd', 'y')) AS sk, map.sortedProperties(m)[0][1] AS sp, convert.toJson(map.clean(m, ['a'], ['x'])) AS cl, convert.toJson(map.fromLists(['p', 'q'], [m.b, m.c])) AS fl, convert.toJson(map.fromPairs([['p', m.b], ['p', m.c]])) AS fp, map.merge(m, {b: 'z'})['b'] AS mg,
    map.flatten({x: {y: m.a}})['x.y'] AS ft, map.unflatten({`x.y`: m.a}).x.y AS uf, size(map.groupBy([m, m], 'b')['x']) AS gb, convert.toJson(map.mergeList([convert.toMap(m)])) AS ml, convert.fromJsonMap(convert.toJson(convert.toMap(m)))['b'] AS fj, n {.n_name, twice: k * 2}.twice AS pr""".replace("WITH n.n_nationkey AS k,", "WITH n, n.n_nationkey AS k,"),
    """SELECT CAST(n_nationkey AS BIGINT) AS k, '{"b":"x","c":"' || n_regionkey || '"}' AS rk, '{"b":"x"}' AS rks, '{"b":"x"}' AS sub, n_name AS v, '{"a":"' || n_name || '","b":"x","c":"' || n_regionkey || '","d":"y"}' AS sk, n_name AS sp, '{"c":"' || n_regionkey || '"}' AS cl, '{"p":"x","q":"' || n_regionkey || '"}' AS fl,
    '{"p":"' || n_regionkey || '"}' AS fp, 'z' AS mg, n_name AS ft, n_name AS uf, 2 AS gb, '{"a":"' || n_name || '","b":"x","c":"' || n_regionkey || '"}' AS ml, 'x' AS fj, n_nationkey * 2 AS pr FROM nation""",
)
_text(
    "cypher", "utility_functions",
    """MATCH (c:Customer) WITH c.c_custkey AS k, c.c_name AS n RETURN k, util.md5(n) AS md5, util.sha1(n) AS sha1, util.sha256(n) AS sha, size(util.sha512(n)) AS s5, util.decompress(util.compress(n)) AS zipped, util.validate(k >= 0, 'bad') AS ok, normalize(n) AS nf, isNormalized(n) AS isnf, size(create.uuid()) AS u, size(create.uuidBase64()) AS u64,
    number.format(k) AS shown, number.format(k, '0.00') AS fixed, round(point.distance(point({x: k, y: 0}), point({x: 0, y: k})), 6) AS dist, point.withinBBox(point({x: k, y: k}), point({x: 0, y: 0}), point({x: 50, y: 50})) AS box, round(point.distance(point({longitude: 0, latitude: 0}), point({longitude: 1, latitude: 0}))) AS deg""",
    """SELECT c_custkey AS k, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha, 128 AS s5, c_name AS zipped, true AS ok, c_name AS nf, true AS isnf, 36 AS u, 22 AS u64, format('{:,}', c_custkey) AS shown, printf('%.2f', c_custkey::DOUBLE) AS fixed, round(sqrt(2.0 * c_custkey * c_custkey), 6) AS dist,
    c_custkey BETWEEN 0 AND 50 AS box, round(2 * 6371000 * asin(sin(radians(0.5)))) AS deg FROM customer""",
)


def _vectors(spark: SparkSession, d: str) -> Graph:
    return Graph({"V": (table(spark, d, "embeddings"), "vec_id")})


_E = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_text(
    "sql", "vector_functions",
    """SELECT vec_id, vector.dimension(embedding) AS dim, round(vector.magnitude(embedding), 6) AS mag, round(vector.l1Norm(embedding), 6) AS l1, round(vector.lInfNorm(embedding), 6) AS linf, round(vector.variance(embedding), 6) AS va, round(vector.stdDev(embedding), 6) AS sd, vector.hasNaN(embedding) AS nan, vector.hasInf(embedding) AS inf,
    vector.hasNull(embedding) AS nul, vector.isNormalized(vector.normalize(embedding)) AS unit, round(vector.dotProduct(embedding, vector.scale(embedding, 2)), 6) AS dot, round(vector.cosineSimilarity(embedding, vector.add(embedding, embedding)), 6) AS co, round(vector.magnitude(vector.subtract(embedding, embedding)), 6) AS zero,
    round(vector.magnitude(vector.multiply(embedding, embedding)), 6) AS sq, round(vector.magnitude(vector.clip(embedding, 0, 1)), 6) AS clipped, round(vector.sparsity(embedding, 0.05), 6) AS sparse, round(vector.sparseDot(vector.denseToSparse(embedding), vector.denseToSparse(embedding)), 6) AS sd2,
    vector.approxDistance(vector.quantizeBinary(embedding), vector.quantizeBinary(vector.scale(embedding, -1))) AS ham, vector.dimension(vector.sparseToDense(vector.denseToSparse(embedding, 0.1))) AS dense, vector.quantizeInt8(embedding).quantized[0] BETWEEN -128 AND 127 AS q8,
    round(vector.magnitude(vector.subtract(vector.dequantizeInt8(vector.quantizeInt8(embedding)), embedding)), 1) AS err, round(vector.rrfScore(vec_id, 3), 9) AS rrf, round(vector.hybridScore(0.5, 0.1, 0.7), 6) AS hy, vector.normalizeScores(embedding)[0] >= 0 AS nrm, round(vector.multiScore(embedding, 'MAX'), 6) AS ms, round(vector.scoreTransform(4, 'SIGMOID'), 6) AS st FROM V""",
    f"""{_E} SELECT vec_id, len(v) AS dim, round(sqrt(list_dot_product(v, v)), 6) AS mag, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS linf, round(list_var_pop(v), 6) AS va, round(list_stddev_pop(v), 6) AS sd, false AS nan, false AS inf, false AS nul, true AS unit,
    round(2 * list_dot_product(v, v), 6) AS dot, 1.0 AS co, 0.0 AS zero, round(sqrt(list_sum(list_transform(v, lambda x: pow(x, 4)))), 6) AS sq, round(sqrt(list_sum(list_transform(v, lambda x: pow(greatest(0, least(1, x)), 2)))), 6) AS clipped, round(len(list_filter(v, lambda x: abs(x) <= 0.05)) / len(v), 6) AS sparse, round(list_dot_product(v, v), 6) AS sd2,
    len(list_filter(v, lambda x: x <> 0))::DOUBLE AS ham, len(v) AS dense, true AS q8, 0.0 AS err, round(1.0 / (60 + vec_id) + 1.0 / 63, 9) AS rrf, 0.38 AS hy, true AS nrm, round(list_max(v), 6) AS ms, round(1 / (1 + exp(-4)), 6) AS st FROM e""",
    _vectors,
)
_text(
    "cypher", "vector_functions",
    """MATCH (v:V) WITH v.vec_id AS k, v.embedding AS e RETURN k, vector_dimension_count(e) AS n, round(vector.norm(e), 6) AS nrm, round(vector_distance(e, vector_create([0.0])), 1) IS NULL AS odd, round(vector_distance_manhattan(e, e), 6) AS zero, round(vector_distance_cosine(e, e), 6) AS c0, round(vector.distance.euclidean(e, vector.scale(e, 2)), 6) AS d,
    round(vector.similarity.cosine(e, vector.scale(e, 3)), 6) AS one, round(vector.similarity.euclidean(e, vector.scale(e, 2)), 6) AS sim""",
    f"""{_E} SELECT vec_id AS k, len(v) AS n, round(sqrt(list_dot_product(v, v)), 6) AS nrm, true AS odd, 0.0 AS zero, 0.0 AS c0, round(sqrt(list_dot_product(v, v)), 6) AS d, 1.0 AS one, round(1 / (1 + list_dot_product(v, v)), 6) AS sim FROM e""",
    _vectors,
)
_text(
    "sql", "functions",
    """SELECT p_partkey, pow(p_size, 2) AS sq, encode(p_name, 'base64') AS enc, decode(encode(p_name, 'base64'), 'base64') AS back, ifempty('', p_brand) AS ie, format('%s/%s', p_brand, p_type) AS f, strcmpci(p_name, upper(p_name)) AS same, map('k', p_size).keys()[0] AS mk, eval('1 + 2') AS three, bytecount(p_name) AS b,
    p_name IS DEFINED AS d, nope IS NOT DEFINED AS nd, p_size <=> null AS ns, p_name INSTANCEOF Part AS io FROM Part WHERE map('k', p_size) CONTAINSKEY 'k' AND p_size != 7 AND map('k', p_size) CONTAINSVALUE p_size""",
    """SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS sq, base64(encode(p_name)) AS enc, p_name AS back, p_brand AS ie, p_brand || '/' || p_type AS f, 0 AS same, 'k' AS mk, 3 AS three, strlen(p_name) AS b, true AS d, true AS nd, p_size IS NULL AS ns, true AS io FROM part WHERE p_size <> 7""",
)
_text(
    "sql", "geometry",
    """SELECT p_partkey AS k, geo.asText(geo.point(p_size, p_partkey)) AS pt, geo.x(geo.point(p_size, 2)) AS x, geo.y(geo.point(1, p_size)) AS y, geo.area(rectangle(0, 0, p_size, 2)) AS area, geo.contains(rectangle(0, 0, 10, 10), geo.point(p_size, 5)) AS inside, geo.within(geo.point(p_size, 5), rectangle(0, 0, 10, 10)) AS within,
    geo.intersects(rectangle(0, 0, p_size, 1), rectangle(10, 0, 20, 1)) AS met, geo.disjoint(rectangle(0, 0, p_size, 1), rectangle(10, 0, 20, 1)) AS apart, geo.touches(rectangle(0, 0, p_size, 1), rectangle(10, 0, 20, 1)) AS touch, geo.overlaps(rectangle(0, 0, p_size, 1), rectangle(10, 0, 20, 1)) AS lap,
    geo.equals(rectangle(0, 0, p_size, 1), rectangle(0, 0, 10, 1)) AS same, geo.crosses(geo.lineString([[0, 0], [p_size, 0]]), geo.polygon([[5, -1], [7, -1], [7, 1], [5, 1]])) AS cross, geo.dWithin(geo.point(p_size, 0), geo.point(0, 0), 12) AS near, geo.distance(geo.point(p_size, 0), rectangle(0, 0, 10, 10)) AS dist,
    geo.envelope(geo.lineString([[0, 0], [p_size, 3]])) AS env, geo.asGeoJson(geo.point(p_size, 1)) AS js, geo.area(geo.buffer(geo.point(0, 0), p_size)) > 3 * p_size * p_size AS wide, geo.geomFromText('POINT (1 2)') AS back, geo.point(p_size, 5).isWithin(rectangle(0, 0, 10, 10)) AS m, p_name.lastIndexOf('a') >= -1 AS li,
    p_size.convert('STRING') AS cv, p_name.javaType() AS jt FROM Part WHERE p_size > 0""",
    """SELECT p_partkey AS k, 'POINT (' || p_size || ' ' || p_partkey || ')' AS pt, p_size::DOUBLE AS x, p_size::DOUBLE AS y, 2.0 * p_size AS area, p_size < 10 AS inside, p_size < 10 AS within, p_size >= 10 AS met, p_size < 10 AS apart, p_size = 10 AS touch, p_size > 10 AND p_size < 20 AS lap, p_size = 10 AS same, p_size > 5 AS cross, p_size <= 12 AS near,
    greatest(p_size - 10, 0)::DOUBLE AS dist, 'POLYGON ((0 0, ' || p_size || ' 0, ' || p_size || ' 3, 0 3, 0 0))' AS env, '{"type":"Point","coordinates":[' || p_size || '.0,1.0]}' AS js, true AS wide, 'POINT (1 2)' AS back, p_size < 10 AS m, true AS li, CAST(p_size AS VARCHAR) AS cv, 'java.lang.String' AS jt FROM part WHERE p_size > 0""",
)
_text(
    "cypher", "node_functions",
    "MATCH (c:Customer) RETURN c.c_custkey AS k, node.id(c) AS id, node.labels(c)[0] AS l, node.degree(c) AS d, node.degree.out(c, 'PLACED') AS o, node.degree.in(c, 'PLACED') AS i, node.relationship.exists(c, 'PLACED') AS e, node.relationship.types(c, ['PLACED', 'LIVES_IN'])[0] AS t",
    "SELECT c_custkey AS k, c_custkey AS id, 'Customer' AS l, count(o_orderkey) + 1 AS d, count(o_orderkey) AS o, 0 AS i, count(o_orderkey) > 0 AS e, 'LIVES_IN' AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
_text(
    "cypher", "path_functions",
    "MATCH q = (n:Nation)-[r:PART_OF]->(g:Region) RETURN n.n_name AS name, size(path.elements(q)) AS parts, path.slice(q, 1, 1)[0] AS last, rel.type(r) AS t, rel.startNode(r) AS s, rel.endNode(r) AS e, rel.id(r) AS i",
    "SELECT n_name AS name, 3 AS parts, n_regionkey AS last, 'PART_OF' AS t, n_nationkey AS s, n_regionkey AS e, n_nationkey AS i FROM nation",
)


# procedures


def _market(spark: SparkSession, d: str, edges: Callable[[SparkSession, str], DataFrame] = market) -> Graph:
    e = edges(spark, d)
    return Graph({"N": (e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), "id")}, {"TO": (e, "src", "dst")}, {"TO": ("N", "N")})


def _shop(spark: SparkSession, d: str) -> Graph:
    e = bought(spark, d)
    return Graph({"N": (e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), "id")}, {"TO": (e, "src", "dst")}, {"TO": ("N", "N")})


_text("cypher", "call_page_rank", "CALL algo.pagerank({maxIterations: 8, tolerance: 0}) YIELD node, score RETURN id(node) AS node, round(score, 9) AS score", _rank_sql(8), _market, lambda df: df.withColumn("score", F.round("score", 9)))
_text("cypher", "call_wcc", "CALL algo.wcc() YIELD node, componentId RETURN id(node) AS node, componentId AS component", _wcc_sql(12), _shop)
_text("cypher", "call_degree", "CALL algo.degree() YIELD node AS who, inDegree, outDegree, degree RETURN id(who) AS node, inDegree AS in_degree, outDegree AS out_degree, degree", ORACLES["algo_degree"], _shop)
_text("cypher", "call_triangles", "CALL algo.triangleCount({relTypes: 'TO'}) YIELD node, triangles RETURN id(node) AS node, triangles", f"SELECT node, triangles FROM ({ORACLES['algo_triangle_count']})", lambda spark, d: _market(spark, d, market_lines))
_text(
    "cypher", "call_link_scores", "MATCH (a:N {id: 3}) CALL algo.commonNeighbors(a) YIELD node2, commonNeighbors RETURN id(node2) AS node, commonNeighbors AS common",
    f"WITH {_MB}, own AS (SELECT dst AS via FROM b WHERE src = 3) SELECT b.dst AS node, count(*) AS common FROM own JOIN b ON b.src = via WHERE b.dst <> 3 GROUP BY 1", _market,
)
_text("cypher", "call_bfs", "MATCH (a:Nation {n_nationkey: 3}) CALL algo.bfs(a, 'PART_OF') YIELD node, depth RETURN node.r_name AS name, depth", "SELECT r_name AS name, 1 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3")
_text(
    "cypher", "call_bipartite", "CALL algo.bipartite() YIELD node, isBipartite RETURN isBipartite AS yes, count(*) AS n", f"WITH {_BOTH} SELECT true AS yes, count(DISTINCT src) AS n FROM b", _shop,
)
_text("cypher", "call_metadata", "CALL db.labels() YIELD label RETURN label AS name UNION ALL CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS name", "SELECT unnest(['Customer', 'Order', 'Part', 'Supplier', 'Nation', 'Region', 'PLACED', 'CONTAINS', 'SUPPLIED_BY', 'LIVES_IN', 'BASED_IN', 'PART_OF']) AS name")
_text("cypher", "call_stats", "CALL meta.stats() YIELD nodeCount, relCount RETURN nodeCount AS n, relCount AS e", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n, (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS e")
_text("cypher", "call_articulation_points", "CALL algo.articulationPoints({relTypes: 'PART_OF'}) YIELD node RETURN node.r_name AS name", "SELECT r_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) > 1")
_text("cypher", "call_subquery", "MATCH (r:Region) WITH count(*) AS n CALL { MATCH (x:Nation) WHERE x.n_regionkey = 1 RETURN x.n_name AS name } RETURN n, name", "SELECT (SELECT count(*) FROM region) AS n, n_name AS name FROM nation WHERE n_regionkey = 1")
