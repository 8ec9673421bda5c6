"""Statements that change data or schema, on a small graph, with what is left worked out by hand."""

import pytest

from loomgraph.plans.changes import cypher_change, sql_script
from loomgraph.plans.cypher import CypherError, cypher
from loomgraph.plans.dialect import SqlError
from test_library import people, rows


def names(g):
    return rows(cypher(g, "MATCH (n:P) RETURN n.id AS id, n.name AS name, n.age AS age"))


def links(g, t="KNOWS"):
    return sorted((r["a" if t == "KNOWS" else "src"], r["b" if t == "KNOWS" else "dst"]) for r in g.edges[t][0].collect())


def test_create(spark):
    g = people(spark)
    new, out = cypher_change(g, "CREATE (x:P {name: 'eve', age: 9})-[:KNOWS {w: 3.0}]->(y:P {name: 'fay'}) RETURN x.name AS n, id(y) - id(x) AS d")
    assert rows(out) == [("eve", 1)] and names(new)[4:] == [(5, "eve", 9), (6, "fay", None)] and links(new)[-1] == (5, 6)
    assert len(names(g)) == 4  # the graph before is as it was
    new, _ = cypher_change(g, "MATCH (a:P) WHERE a.age > 3 CREATE (a)-[:OWNS]->(:Thing {of: a.name})")
    assert sorted(r["of"] for r in new.vertices["Thing"][0].collect()) == ["bob", "cid"] and len(links(new, "OWNS")) == 2 and new.ends["OWNS"] == ("P", "Thing")


def test_set_and_remove(spark):
    g = people(spark)
    new, out = cypher_change(g, "MATCH (n:P {team: 'red'}) SET n.age = n.age + 10, n.tall = true RETURN n.name AS name, n.age AS age")
    assert rows(out) == [("ann", 13), ("bob", 15)]
    assert rows(cypher(new, "MATCH (n:P) RETURN n.age AS age, n.tall AS tall")) == [(1, None), (13, True), (15, True), (7, None)]
    new, _ = cypher_change(g, "MATCH (n:P {id: 1}) SET n += {name: 'x'} REMOVE n.age")
    assert names(new)[0] == (1, "x", None)
    new, _ = cypher_change(g, "MATCH (n:P {id: 1}) SET n = {name: 'y'}")
    assert rows(cypher(new, "MATCH (n:P {id: 1}) RETURN n.name AS a, n.age AS b, n.team AS c")) == [("y", None, None)]
    new, _ = cypher_change(g, "MATCH (a:P)-[r:KNOWS]->(b:P {id: 3}) SET r.w = 0.5")
    assert sorted(r["w"] for r in new.edges["KNOWS"][0].collect()) == [0.5, 0.5, 1.0, 1.0]
    new, _ = cypher_change(g, "MATCH (n:P {id: 1}) FOREACH (k IN [1, 2] | CREATE (:Mark {of: n.id * 10 + k}))")
    assert sorted(r["of"] for r in new.vertices["Mark"][0].collect()) == [11, 12]


def test_merge(spark):
    g = people(spark)
    new, out = cypher_change(g, "UNWIND ['ann', 'zoe', 'zoe'] AS n MERGE (x:P {name: n}) ON CREATE SET x.age = 1 ON MATCH SET x.age = 100 RETURN n, x.age AS age")
    assert rows(out) == [("ann", 100), ("zoe", 1), ("zoe", 1)]
    assert names(new) == [(1, "ann", 100), (2, "bob", 5), (3, "cid", 7), (4, "dee", 1), (5, "zoe", 1)]
    new, _ = cypher_change(g, "MATCH (a:P {id: 1}), (b:P) WHERE b.id > 1 MERGE (a)-[:KNOWS]->(b)")
    assert links(new) == [(1, 2), (1, 3), (1, 4), (2, 3), (3, 1)]


def test_delete(spark):
    g = people(spark)
    with pytest.raises(CypherError):
        cypher_change(g, "MATCH (n:P {id: 1}) DELETE n")
    assert len(names(cypher_change(g, "MATCH (n:P {id: 4}) DELETE n")[0])) == 3
    new, _ = cypher_change(g, "MATCH (n:P {id: 1}) DETACH DELETE n")
    assert [x[0] for x in names(new)] == [2, 3, 4] and links(new) == [(2, 3)]
    assert links(cypher_change(g, "MATCH (a:P {id: 1})-[r:KNOWS]->() DELETE r")[0]) == [(2, 3), (3, 1)]


def test_sql_changes(spark):
    g = people(spark)
    new, out = sql_script(g, "INSERT INTO P (id, name) VALUES (9, 'eve'), (10, 'fay'); INSERT INTO P SET name = 'gus', age = 2; INSERT INTO P CONTENT {\"name\": 'hal'}; SELECT count(*) AS n FROM P")
    assert rows(out) == [(8,)] and sorted(names(new))[4:] == [(9, "eve", None), (10, "fay", None), (11, "gus", 2), (12, "hal", None)]
    new, out = sql_script(g, "UPDATE P SET age += 1, team = 'green' WHERE team = 'red'; SELECT team, sum(age) AS s FROM P GROUP BY team ORDER BY s")
    assert rows(out) == [("blue", 7), ("green", 10), (None, 1)]
    _, out = sql_script(g, "UPDATE P SET age = 50 UPSERT WHERE name = 'new'")
    assert rows(out) == [(1,)]
    new, _ = sql_script(g, "UPDATE P SET age = 50 UPSERT WHERE name = 'new'; UPDATE P SET age = 51 UPSERT WHERE name = 'new'")
    assert [x for x in names(new) if x[1] == "new"] == [(5, "new", 51)]
    new, _ = sql_script(g, "UPDATE P REMOVE team WHERE id = 1; UPDATE P MERGE {extra: 1} WHERE id = 2")
    assert rows(new.vertices["P"][0].select("id", "team", "extra")) == [(1, None, None), (2, "red", 1), (3, "blue", None), (4, None, None)]
    new, out = sql_script(g, "DELETE VERTEX P WHERE id = 1")
    assert rows(out) == [(1,)] and links(new) == [(2, 3)]
    assert links(sql_script(g, "DELETE EDGE KNOWS WHERE w > 1.5")[0]) == [(1, 2), (3, 1)]
    new, out = sql_script(g, "CREATE EDGE KNOWS FROM (SELECT FROM P WHERE id = 4) TO (SELECT FROM P WHERE id < 3) SET w = 7; CREATE EDGE KNOWS FROM (SELECT FROM P WHERE id = 4) TO (SELECT FROM P WHERE id < 4) IF NOT EXISTS")
    assert rows(out) == [(1,)] and links(new)[-3:] == [(4, 1), (4, 2), (4, 3)]
    new, _ = sql_script(g, "CREATE VERTEX TYPE Q; CREATE PROPERTY Q.n LONG; INSERT INTO Q FROM (SELECT id AS n FROM P WHERE id > 2); CREATE EDGE TYPE OF FROM Q TO P; ALTER PROPERTY Q.n NAME m; DROP PROPERTY P.team; TRUNCATE TYPE KNOWS")
    assert sorted(r["m"] for r in new.vertices["Q"][0].collect()) == [3, 4] and "team" not in new.vertices["P"][0].columns and links(new) == [] and new.ends["OF"] == ("Q", "P")
    new, out = sql_script(g, "CREATE MATERIALIZED VIEW v AS SELECT team, count(*) AS n FROM P GROUP BY team; INSERT INTO P (id, team) VALUES (7, 'red'); REFRESH MATERIALIZED VIEW v; SELECT n FROM v WHERE team = 'red'")
    assert rows(out) == [(3,)]
    new, out = sql_script(g, "BEGIN; DELETE FROM P; ROLLBACK; IF (1 > 2) { DELETE FROM P; } IF (:yes = 1) { UPDATE P SET age = 0; } RETURN SELECT max(age) AS m FROM P", yes=1)
    assert rows(out) == [(0,)] and len(names(new)) == 4
    new, _ = sql_script(g, "CREATE VERTEX TYPE Old EXTENDS P; MOVE VERTEX (SELECT FROM P WHERE id = 1) TO TYPE:Old")
    assert [r["name"] for r in new.vertices["Old"][0].collect()] == ["ann"] and len(names(new)) == 3 and links(new) == [(2, 3)]
    with pytest.raises(SqlError):
        sql_script(g, "DROP TYPE Nothing")
    assert "Scan" in sql_script(g, "EXPLAIN SELECT name FROM P")[1].first()[0] and rows(sql_script(g, "PROFILE SELECT name FROM P")[1].select("rows")) == [(4,)]
