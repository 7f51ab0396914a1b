from __future__ import annotations

import math
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from manyfold.plans.ast import ParseError, QueryError
from manyfold.plans.compiler import Options, cost
from manyfold.plans.parser import parse, parse_script
from manyfold.session import Engine

ROWS = [(1, 1, "a", 1.0, True), (2, 1, "b", 2.0, False), (3, 2, None, None, None), (4, 2, "a%", math.nan, True), (5, None, "B\\x", 5.0, False)]


@pytest.fixture
def e(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame(ROWS, "id long, g long, name string, v double, flag boolean"), key="id")
    e.register("u", spark.createDataFrame([(1, 1), (2, None), (3, 3)], "uid long, k long"), key="uid")
    e.register("person", spark.createDataFrame([("a", "Ann"), ("b", "Bob"), ("c", "Cy")], "pid string, name string"), key="pid")
    docs = [(1, '{"tags": ["x", "y"], "n": {"m": 1}, "b": true}'), (2, '{"n": {"m": 1.0}, "tags": []}'), (3, None), (4, "no json"), (5, '{"n": {"m": "1"}}')]
    e.register("d", spark.createDataFrame(docs, "id long, doc string"), key="id", doc="doc")
    e.register("v", spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 3.0])], "id long, emb array<double>"), key="id", vector="emb")
    return e


def ids(df):
    return [r[0] for r in df.collect()]


# -- the parser

GOOD = [
    "SELECT * FROM t", "select a, t.b from t where a = 1 and b != 'x''y' or not (c <= -2.5)", "SELECT COUNT(*) FROM t GROUP BY a, b HAVING SUM(c) > 1 AND COUNT(*) < 3",
    "SELECT a FROM t KNN emb <|3|> [1.0, -2] USING EXACT", "SELECT a FROM t TRAVERSE e DEPTH 2 LIMIT 3 OFFSET 1", "RELATE a:x1->knows->b:y-2 SET {\"k\": {\"z\": \"}\"}} AT 5",
    "INSERT INTO t VALUES (1, 'x'), (2, NULL)", "DELETE FROM t WHERE a IN () RETURNING *", "SELECT a FROM (SELECT * FROM t) AS x ORDER BY a", "RETURN $x + 1", "ANALYZE t", "DROP INDEX t.a",
]
BAD = [
    "", ";", "SELECT", "SELECT FROM t", "SELECT * FROM", "SELECT * FROM t WHERE", "SELECT a b FROM t", "SELECT * FROM t; garbage", "'", "SELECT * FROM t WHERE a = 'x", "SELECT * FROM t -- c",
    "SELECT * FROM t WHERE a <> 1", 'SELECT "a" FROM t', "SELECT * FROM t LIMIT -1", "SELECT * FROM t JOIN t ON t.a = t.b", "SELECT * FROM a JOIN b ON a.x < b.y", "SELECT SUM(*) FROM t",
    "SELECT * FROM t HAVING COUNT(*) > 1", "SELECT NULLIF(1) FROM t", "RELATE a->b->c", "{", "SELECT * FROM t WHERE a @> '{'", "SELECT NTILE(0) OVER () FROM t", "SELECT " + "(" * 300 + "1", "\x00", "SELECT 99999999999999999999 FROM t",
]


@pytest.mark.parametrize("q", GOOD)
def test_reads(q):
    assert parse(q) is not None and parse(q) == parse(q.replace("SELECT", "sElEcT"))


@pytest.mark.parametrize("q", BAD)
def test_refuses(q):
    with pytest.raises(QueryError):
        parse(q)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("SELECT FROM WHERE t a = 1 ( ) , 'x' AND NOT IN GROUP BY * COUNT OVER CASE WHEN THEN END -> <| |> [ ] ; $v ? { } UNION WITH AS LIMIT".split()), max_size=14).map(" ".join) | st.text(max_size=30))
def test_only_parse_errors(q):
    try:
        parse_script(q)
    except ParseError:
        pass


# -- meaning


def test_null_order_and_ties(e):
    assert ids(e.query("SELECT id FROM t ORDER BY name")) == [5, 1, 4, 2, 3]
    assert ids(e.query("SELECT id FROM t ORDER BY g DESC")) == [5, 3, 4, 1, 2]
    assert [r[0] for r in e.query("SELECT u.k FROM u LEFT JOIN t ON u.uid = t.id ORDER BY u.k").collect()] == [None, 1, 3]


def test_three_valued_logic(e):
    assert ids(e.query("SELECT id FROM t WHERE NOT (g = 1) ORDER BY id")) == [3, 4]
    assert ids(e.query("SELECT id FROM t WHERE flag IS NOT TRUE ORDER BY id")) == [2, 5]
    assert ids(e.query("SELECT id FROM t WHERE flag ORDER BY id")) == [1, 4]
    assert ids(e.query("SELECT id FROM t WHERE g NOT IN (1, NULL)")) == []
    assert ids(e.query("SELECT id FROM t WHERE g IN ()")) == [] and ids(e.query("SELECT id FROM t WHERE g NOT IN () ORDER BY id")) == [1, 2, 3, 4]
    assert ids(e.query("SELECT id FROM t WHERE id NOT IN (SELECT k FROM u)")) == []
    assert ids(e.query("SELECT id FROM t WHERE id NOT IN (SELECT k FROM u WHERE k > 0) ORDER BY id")) == [2, 4, 5]


def test_nan_is_less_than_anything(e, spark):
    assert ids(e.query("SELECT id FROM t WHERE v < 0")) == [4] and ids(e.query("SELECT id FROM t WHERE v != v")) == [4]
    strict = Engine(spark, Options(nan_less=False))
    strict.register("t", e.tables["t"].df)
    assert 4 not in ids(strict.query("SELECT id FROM t WHERE v < 0"))


def test_like_has_no_escape(e):
    assert ids(e.query("SELECT id FROM t WHERE name LIKE 'B\\_'")) == [5] and ids(e.query("SELECT id FROM t WHERE name ILIKE 'b%'  ORDER BY id")) == [2, 5]


@pytest.mark.parametrize("q", [
    "SELECT id FROM t WHERE name = 1", "SELECT id FROM t WHERE flag = 1", "SELECT id FROM t WHERE name LIKE 5", "SELECT SUM(name) FROM t", "SELECT nope FROM t", "SELECT * FROM nope",
    "SELECT *, COUNT(*) FROM t", "SELECT id, COUNT(*) FROM t", "SELECT id FROM t WHERE id", "SELECT id FROM t WHERE id = (SELECT uid FROM u)", "SELECT id FROM t WHERE id IN (SELECT uid, k FROM u)",
    "SELECT CASE WHEN flag THEN 1 ELSE 'x' END AS c FROM t", "SELECT id FROM t WHERE MATCH(name, 'a') OR id = 1", "SELECT id FROM t KNN name <|2|> [1.0]",
])
def test_names_and_kinds_are_checked(e, q):
    with pytest.raises((QueryError, ValueError)):
        e.query(q).collect()


def test_aggregates(e):
    assert e.query("SELECT COUNT(*) , SUM(v) AS s FROM t WHERE id > 9").collect()[0].asDict() == {"count": 0, "s": None}
    got = {r["g"]: (r["n"], r["sum_id"]) for r in e.query("SELECT g, COUNT(name) AS n, SUM(id) FROM t GROUP BY g").collect()}
    assert got == {1: (2, 3), 2: (1, 7), None: (1, 5)}
    assert ids(e.query("SELECT g FROM t GROUP BY g HAVING MAX(id) > 3 AND COUNT(*) = 1")) == [None]


def test_windows(e):
    got = e.query("SELECT id, SUM(id) OVER (ORDER BY id) AS whole, SUM(id) OVER (ORDER BY id ROWS 1 PRECEDING) AS two, COUNT(id) OVER (ORDER BY id ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS ahead, NTILE(2) OVER (ORDER BY id) AS half, RANK() OVER () AS r FROM t").collect()
    assert [(r["whole"], r["two"], r["ahead"], r["half"], r["r"]) for r in sorted(got)] == [(15, 1, 2, 1, 1), (15, 3, 2, 1, 1), (15, 5, 1, 1, 1), (15, 7, 1, 2, 1), (15, 9, 1, 2, 1)]
    back = e.query("SELECT id, SUM(id) OVER (ORDER BY id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS s, FIRST_VALUE(name) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 3 PRECEDING) AS f FROM t").collect()
    assert [(r["s"], r["f"]) for r in sorted(back)] == [(1, "a"), (1, "a"), (3, None), (6, None), (9, None)]


def test_sets(e):
    assert sorted(ids(e.query("SELECT g FROM t WHERE g > 0 INTERSECT ALL SELECT g FROM t WHERE id < 4"))) == [1, 1, 2, 2]
    assert sorted(ids(e.query("SELECT g AS x FROM t WHERE g = 2 UNION SELECT uid AS x FROM u"))) == [1, 2, 3]
    assert ids(e.query("SELECT g AS x FROM t EXCEPT SELECT k AS x FROM u")) == [2]
    with pytest.raises(ValueError, match="one side"):
        e.query("SELECT v AS x FROM t UNION SELECT uid AS x FROM u").collect()


def test_recursion_ends(e):
    q = "WITH RECURSIVE r AS (SELECT id AS n FROM t WHERE id = 1 UNION{} SELECT id AS n FROM t WHERE g IN (SELECT n FROM r)) SELECT n FROM r"
    assert sorted(ids(e.query(q.format("")))) == [1, 2, 3, 4]
    e.options.recursion_limit = 2
    assert len(ids(e.query(q.format(" ALL")))) > 3


def test_cte_shadows_and_joins(e):
    assert ids(e.query("WITH t AS (SELECT uid FROM u) SELECT COUNT(*) AS n FROM t")) == [3]
    assert ids(e.query("WITH x AS (SELECT uid FROM u) SELECT COUNT(*) AS n FROM t JOIN x ON t.id = x.uid")) == [3]


def test_limit_is_implied(spark):
    e = Engine(spark)
    e.register("n", spark.range(1500).toDF("id"), "id")
    assert e.query("SELECT id FROM n").count() == 1000 and e.query("SELECT id FROM n LIMIT 1200").count() == 1200
    assert sum(1 for _ in e.stream("SELECT id FROM n")) == 1500


def test_documents(e):
    assert ids(e.query("SELECT id FROM d WHERE doc -> 'n.m' = 1 ORDER BY id")) == [1, 2] and ids(e.query("SELECT id FROM d WHERE doc -> 'n.m' = '1'")) == [5]
    assert ids(e.query("SELECT id FROM d WHERE doc -> 'b' = TRUE")) == [1] and ids(e.query("SELECT id FROM d WHERE doc -> 'n' IS NULL ORDER BY id")) == [1, 2, 3, 4, 5]
    assert ids(e.query("SELECT id FROM d WHERE doc @> '{\"n\": {\"m\": 1}}' ORDER BY id")) == [1, 2] and ids(e.query("SELECT id FROM d WHERE doc @> {\"tags\": [\"y\"]}")) == [1]
    assert ids(e.query("SELECT id FROM d WHERE NOT doc @> '{\"tags\": []}' ORDER BY id")) == [3, 4, 5]


def test_vectors(e):
    assert ids(e.query("SELECT id FROM v KNN emb <|2|> [0.9, 0.0]")) == [2, 1]
    for mode in ("EXACT", "AUTO", "FILTERED"):
        assert ids(e.query(f"SELECT id FROM v WHERE id != 2 KNN emb <|1|> [0.9, 0.0] USING {mode}")) == [1]
    assert ids(e.query("SELECT id FROM v KNN emb <|0|> [0.0, 0.0]")) == [] and len(ids(e.query("SELECT id FROM v KNN emb <|2|> [0.9, 0.0] USING QUANTIZED"))) == 2


def test_graph(e):
    e.script('RELATE person:a->knows->person:b SET {"w": 1} AT 17; RELATE person:b->knows->person:c; RELATE person:a->knows->person:b SET {"w": 1} AT 17')
    with pytest.raises(QueryError, match="EDGE_CONFLICT"):
        e.query("RELATE person:a->knows->person:b SET {\"w\": 2}")
    e.query("RELATE person:a->knows->person:b ON CONFLICT DO NOTHING")
    got = {r[0]: tuple(r)[1:] for r in e.query("SELECT name, ->knows{payload, ts_unix}->person AS f, <-knows<-person AS b, ->knows->person->knows->person AS two FROM person").collect()}
    assert got == {"Ann": ('{"payload":{"w":1},"ts_unix":17}', None, "c"), "Bob": ('{"payload":null,"ts_unix":null}', "a", None), "Cy": (None, "b", None)}
    assert ids(e.query("SELECT pid FROM person TRAVERSE knows DEPTH 1")) == ["a", "b"] and ids(e.query("SELECT pid FROM person WHERE pid != 'b' TRAVERSE knows DEPTH 2")) == ["a", "c"]


def test_full_text(spark):
    e = Engine(spark)
    e.register("docs", spark.createDataFrame([(1, "the cat sat"), (2, "cat cat cat"), (3, "Dógs only"), (4, None)], "id long, body string"), "id")
    assert ids(e.query("SELECT id FROM docs WHERE MATCH(body, 'CAT')")) == [2, 1] and ids(e.query("SELECT id FROM docs WHERE MATCH(body, 'cat') AND id < 2")) == [1]
    assert ids(e.query("SELECT id FROM docs WHERE MATCH(body, 'the') AND MATCH(body, 'cat')")) == [1] and ids(e.query("SELECT id FROM docs WHERE MATCH(body, 'zzz')")) == []


def test_changes_and_versions(e):
    before = e.tx
    assert ids(e.query("UPDATE t SET name = 'z' WHERE g = 1")) == [2]
    assert sorted(ids(e.query("DELETE FROM t WHERE v > 1 RETURNING id"))) == [2, 5]
    assert ids(e.query("SELECT id FROM t ORDER BY id")) == [1, 3, 4]
    assert ids(e.query_at("SELECT name FROM t WHERE id = 1", before)) == ["a"]
    assert e.query("INSERT INTO u (uid, k) VALUES (1, 9), (7, 7) ON CONFLICT (uid) DO NOTHING RETURNING uid").collect() == [(7,)]
    e.query("INSERT INTO u (uid, k) VALUES (2, 8) ON CONFLICT (uid) DO UPDATE SET k = excluded.k")
    assert sorted(map(tuple, e.query("SELECT uid, k FROM u").collect())) == [(1, 1), (2, 8), (3, 3), (7, 7)]
    for q in ("INSERT INTO u VALUES ('x', 1)", "INSERT INTO u (uid) VALUES (1)", "UPDATE t SET nope = 1"):
        with pytest.raises(QueryError):
            e.query(q)


def test_script_prepared_and_views(e):
    assert ids(e.script("LET $a = 2; SELECT id FROM t WHERE id = $a")) == [2] and ids(e.query("RETURN 1 + 2 * 3")) == [7]
    p = e.prepare("SELECT id FROM t WHERE g = ? AND name = $2", ("int", "text"))
    assert ids(p.run(1, "b")) == [2]
    for wrong in ((1,), ("x", "b")):
        with pytest.raises(QueryError):
            p.run(*wrong)
    e.create_view("big", "SELECT id, g FROM t WHERE id > 2")
    assert ids(e.query("SELECT COUNT(*) AS n FROM big")) == [3]
    e.query("DELETE FROM t WHERE id = 4")
    assert e.refresh_view("big") == {"inserted": 0, "deleted": 1, "unchanged": 2}
    assert e.cached("SELECT id FROM t") is e.cached("SELECT id FROM t")
    e.drop_view("big")
    with pytest.raises(QueryError):
        e.drop_view("big")


def test_explain_analyze_and_budget(e):
    e.query("ANALYZE t")
    lines = ids(e.query("EXPLAIN SELECT id FROM t WHERE g = 1 LIMIT 3"))
    assert lines[0] == "FullScan t WHERE (g = 1)" and "LIMIT 3" in lines and any(x.startswith("ESTIMATED_ROWS") for x in lines)
    assert "ACTUAL_ROWS 2" in e.explain_analyze("SELECT id FROM t WHERE g = 1")
    e.budget = 5
    with pytest.raises(QueryError, match="budget"):
        e.query("SELECT id FROM t")
    assert cost(parse("SELECT * FROM t CROSS JOIN u")) > cost(parse("SELECT * FROM t"))


def test_filters_reach_the_scan(spark):
    e = Engine(spark, Options(implicit_limit=None, nan_less=False))
    e.register("orders", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    plan = e.query("SELECT o_custkey FROM orders WHERE o_orderkey = 7 AND o_totalprice > 10")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "GreaterThan(o_totalprice" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]


def test_random_filters_agree_with_duckdb(spark):
    r = random.Random(42)
    rows = [(i, r.choice([None, *range(-2, 4)]), r.choice([None, "a", "b", "ab", ""])) for i in range(60)]
    e = Engine(spark)
    e.register("t", spark.createDataFrame(rows, "id long, a long, b string"), "id")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t (id BIGINT, a BIGINT, b VARCHAR)")
    duck.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)

    def test(depth: int) -> str:
        if depth and r.random() < 0.6:
            return f"({test(depth - 1)} {r.choice(['AND', 'OR'])} {test(depth - 1)})" if r.random() < 0.8 else f"NOT ({test(depth - 1)})"
        return r.choice([f"a {r.choice(['=', '!=', '<', '<=', '>', '>='])} {r.randint(-2, 3)}", f"b {r.choice(['=', '!=', '<'])} '{r.choice('ab')}'", f"a {r.choice(['', 'NOT '])}IN (1, 2{r.choice(['', ', NULL'])})", "a IS NULL", "b IS NOT NULL", "a BETWEEN 0 AND 2", "b LIKE 'a%'", "COALESCE(a, 7) > NULLIF(a, 1)"])

    for _ in range(25):
        q = f"SELECT id FROM t WHERE {test(3)}"
        assert sorted(ids(e.query(q))) == sorted(x[0] for x in duck.execute(q).fetchall()), q
