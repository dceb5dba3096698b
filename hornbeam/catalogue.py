"""Registered queries: each operator over the whole star-schema tables, read as a graph, with its DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .operators import lifecycle, mutate, retrieval, temporal, text, vector
from .plans.catalog import Catalog
from .plans.engine import Engine
from .plans.indexes import attach
from .shared import stage_table
from .streaming.coordinator import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(label: str, col: str):
    return F.concat(F.lit(f"{label}:"), F.col(col).cast("string"))


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The star schema as a graph, planned once an application and folder."""
    return _star_catalog(spark.sparkContext.applicationId, spark, sf_dir)


@functools.lru_cache(maxsize=4)
def _star_catalog(application: str, spark: SparkSession, sf_dir: str) -> Catalog:
    """Every label, edge type and property is a projection of one table."""
    t = functools.cache(lambda n: table(spark, sf_dir, n))
    keys = {"region": ("region", "r_regionkey"), "nation": ("nation", "n_nationkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "order": ("orders", "o_orderkey")}
    c = Catalog(spark)
    for label, (name, key) in keys.items():
        c.label(label, t(name).select(_id(label, key)))
    c.edge("in_region", t("nation").select(_id("nation", "n_nationkey"), _id("region", "n_regionkey")))
    c.edge("in_nation", t("customer").select(_id("customer", "c_custkey"), _id("nation", "c_nationkey")))
    c.edge("based_in", t("supplier").select(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey")))
    c.edge("placed", t("orders").select(_id("customer", "o_custkey"), _id("order", "o_orderkey")))
    # (l_orderkey, l_linenumber) repeats, so an edge is a row: its id hashes all columns.
    c.edge("contains", t("lineitem").select(_id("order", "l_orderkey"), _id("part", "l_partkey"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.hex(F.xxhash64("*")))))
    c.edge("child_of", t("part").filter("p_partkey > 1").select(_id("part", "p_partkey"), F.concat(F.lit("part:"), F.expr("(p_partkey div 2)").cast("string"))))
    names = [t(n).select(_id(x, k), F.col(v)) for x, (n, k), v in ((x, keys[x], v) for x, v in (("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name")))]
    c.property("name", names[0].union(names[1]).union(names[2]).union(names[3]).union(names[4]), "str")
    c.property("mktsegment", t("customer").select(_id("customer", "c_custkey"), "c_mktsegment"), "str")
    c.property("acctbal", t("supplier").select(_id("supplier", "s_suppkey"), "s_acctbal"), "float")
    c.property("totalprice", t("orders").select(_id("order", "o_orderkey"), "o_totalprice"), "float")
    c.property("status", t("orders").select(_id("order", "o_orderkey"), "o_orderstatus"), "str")
    c.property("size", t("part").select(_id("part", "p_partkey"), F.col("p_size").cast("long")), "int")
    c.property("brand", t("part").select(_id("part", "p_partkey"), "p_brand"), "str")
    c.property("retailprice", t("part").select(_id("part", "p_partkey"), "p_retailprice"), "float")
    return c


def rules(name: str, query: str, sql: str, program: str = "", **casts: str) -> None:
    """Registers a goal query; ``casts`` give answer columns another type; joined is a list as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(spark, star_catalog(spark, sf_dir)).consult(program).query(query)
        return df.withColumns({k: F.array_join(F.col(k).cast("array<string>"), ",") if v == "joined" else F.col(k).cast(v) for k, v in casts.items()}) if casts else df

    QUERIES[name] = run
    ORACLES[name] = sql


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


_C, _O, _P, _S, _N, _R = ("'customer:' || c_custkey", "'order:' || o_orderkey", "'part:' || p_partkey", "'supplier:' || s_suppkey", "'nation:' || n_nationkey", "'region:' || r_regionkey")
_TREE = "tree AS (SELECT 'part:' || p_partkey AS s, 'part:' || (p_partkey // 2) AS t FROM part WHERE p_partkey > 1)"

# -- scans
rules("scan_label", "? nation(X).", f'SELECT {_N} AS "X" FROM nation')
rules("scan_node", "? node(X).", f'SELECT {_R} AS "X" FROM region UNION SELECT {_N} FROM nation UNION SELECT {_C} FROM customer UNION SELECT {_S} FROM supplier UNION SELECT {_P} FROM part UNION SELECT {_O} FROM orders')
rules("scan_edge_type", "? placed(C, O).", f'SELECT DISTINCT \'customer:\' || o_custkey AS "C", {_O} AS "O" FROM orders')
rules("point_node", "? label('part:7', L).", "SELECT 'part' AS \"L\" FROM part WHERE p_partkey = 7")
rules("outgoing_edges", "? placed('customer:7', O).", f'SELECT DISTINCT {_O} AS "O" FROM orders WHERE o_custkey = 7')
rules("incoming_edges", "? in_region(N, 'region:1').", f'SELECT {_N} AS "N" FROM nation WHERE n_regionkey = 1')
rules("label_index", "? label(X, supplier).", f'SELECT {_S} AS "X" FROM supplier')
rules("prop_exact", '? prop_mktsegment(C, "BUILDING").', f"SELECT {_C} AS \"C\" FROM customer WHERE c_mktsegment = 'BUILDING'")
rules("prop_scan", "? property(X, size, V).", f'SELECT DISTINCT {_P} AS "X", CAST(p_size AS BIGINT) AS "V" FROM part')
rules("prop_of_entity", "? property('part:7', K, _).", "SELECT unnest(['name', 'size', 'brand', 'retailprice']) AS \"K\" FROM part WHERE p_partkey = 7")
rules("edge_identity", "? edge_id('nation:3', in_region, R, I).", f"SELECT 'region:' || n_regionkey AS \"R\", 'nation:3:in_region:region:' || n_regionkey AS \"I\" FROM nation WHERE n_nationkey = 3")
rules("atom_is_no_string", "? prop_mktsegment(C, building).", f'SELECT {_C} AS "C" FROM customer WHERE false')
rules("undefined_fails", "? no_such_relation(X).", "SELECT CAST(NULL AS VARCHAR) AS \"X\" WHERE false")

# -- joins
rules("conj_join", '? placed(C, O), prop_mktsegment(C, "BUILDING"), prop_totalprice(O, P), P > 200000.', f"SELECT DISTINCT {_C} AS \"C\", {_O} AS \"O\", o_totalprice AS \"P\" FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
rules("theta_join", "? based_in(X, N), based_in(Y, N), prop_acctbal(X, A), prop_acctbal(Y, B), A < B.", "SELECT DISTINCT 'supplier:' || x.s_suppkey AS \"X\", 'supplier:' || y.s_suppkey AS \"Y\", 'nation:' || x.s_nationkey AS \"N\", x.s_acctbal AS \"A\", y.s_acctbal AS \"B\" FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey WHERE x.s_acctbal < y.s_acctbal")
rules("self_join_neq", "? neighbour(X, Y).", "SELECT 'supplier:' || x.s_suppkey AS \"X\", 'supplier:' || y.s_suppkey AS \"Y\" FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey", "neighbour(X, Y) :- based_in(X, N), based_in(Y, N), X \\= Y.")
rules("semi_join", "? customer(C), big(C).", f'SELECT {_C} AS "C" FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)', "big(C) :- placed(C, O), prop_totalprice(O, P), '>'(P, 400000).")
rules("anti_join", "? customer(C), \\+ placed(C, _).", f'SELECT {_C} AS "C" FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)')
rules("anti_join_condition", "? customer(C), \\+ (placed(C, O), prop_totalprice(O, P), P > 100000).", f'SELECT {_C} AS "C", CAST(NULL AS VARCHAR) AS "O", CAST(NULL AS VARCHAR) AS "P" FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)')
rules("cross_join", "? region(A), region(B).", 'SELECT \'region:\' || a.r_regionkey AS "A", \'region:\' || b.r_regionkey AS "B" FROM region a, region b')
rules("three_way_join", "? in_region(N, R), in_nation(C, N), prop_name(R, RN), prop_name(N, NN).", f'SELECT {_N} AS "N", {_R} AS "R", {_C} AS "C", r_name AS "RN", n_name AS "NN" FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey')

# -- unions and control
rules("rule_union", "? located(X, N).", f'SELECT {_C} AS "X", \'nation:\' || c_nationkey AS "N" FROM customer UNION SELECT {_S}, \'nation:\' || s_nationkey FROM supplier', "located(X, N) :- in_nation(X, N). located(X, N) :- based_in(X, N).")
rules("rule_shadows_relation", "? in_region(N, R).", "SELECT 'a' AS \"N\", 'b' AS \"R\"", "in_region(a, b).")
rules("disjunction", "? prop_size(P, S), (S < 3 ; S > 48).", f'SELECT DISTINCT {_P} AS "P", CAST(p_size AS BIGINT) AS "S" FROM part WHERE p_size < 3 OR p_size > 48')
rules("if_then", "? prop_size(P, S), (S > 25 -> prop_brand(P, B)).", f'SELECT DISTINCT {_P} AS "P", CAST(p_size AS BIGINT) AS "S", p_brand AS "B" FROM part WHERE p_size > 25')
rules("set_difference", "? supplier_nation(N), \\+ rich_nation(N).", "SELECT 'nation:' || s_nationkey AS \"N\" FROM supplier EXCEPT SELECT 'nation:' || s_nationkey FROM supplier WHERE s_acctbal > 5000", "supplier_nation(N) :- based_in(_, N). rich_nation(N) :- based_in(S, N), prop_acctbal(S, A), '>'(A, 5000).")
rules("set_intersection", "? placed(C, _), in_nation(C, 'nation:1').", "SELECT 'customer:' || o_custkey AS \"C\" FROM orders INTERSECT SELECT 'customer:' || c_custkey FROM customer WHERE c_nationkey = 1")
rules("once_first", "? region(R), once(in_region(N, R)).", 'SELECT \'region:\' || n_regionkey AS "R", min(\'nation:\' || n_nationkey) AS "N" FROM nation GROUP BY n_regionkey')
rules("cut_first", "? region(R), first_nation(R, N).", 'SELECT \'region:\' || n_regionkey AS "R", min(\'nation:\' || n_nationkey) AS "N" FROM nation GROUP BY n_regionkey', "first_nation(R, N) :- in_region(N, R), !. first_nation(_, none).")
rules("call_closure", "? call(in_region, N, 'region:2').", f'SELECT {_N} AS "N" FROM nation WHERE n_regionkey = 2')

# -- scalars
rules("arith_is", "? prop_size(P, S), X is 2 * S + 1, Y is S / 4.", f'SELECT DISTINCT {_P} AS "P", CAST(p_size AS BIGINT) AS "S", CAST(2 * p_size + 1 AS BIGINT) AS "X", p_size / 4.0::DOUBLE AS "Y" FROM part')
rules("arith_mod_div", "? prop_size(P, S), X is S - 25, M is X mod 7, R is X rem 7, D is X // 7.", f'SELECT DISTINCT {_P} AS "P", CAST(p_size AS BIGINT) AS "S", CAST(p_size - 25 AS BIGINT) AS "X", CAST((((p_size - 25) % 7) + 7) % 7 AS BIGINT) AS "M", CAST((p_size - 25) % 7 AS BIGINT) AS "R", CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS "D" FROM part')
rules("arith_compare", "? prop_size(P, S), S =\\= 10, S >= 5, S =< 20.", f'SELECT DISTINCT {_P} AS "P", CAST(p_size AS BIGINT) AS "S" FROM part WHERE p_size <> 10 AND p_size BETWEEN 5 AND 20')
rules("arith_min_max_abs", "? prop_size(P, S), A is abs(S - 25), B is min(A, 10), C is max(A, 10).", f'SELECT DISTINCT {_P} AS "P", CAST(p_size AS BIGINT) AS "S", CAST(abs(p_size - 25) AS BIGINT) AS "A", CAST(least(abs(p_size - 25), 10) AS BIGINT) AS "B", CAST(greatest(abs(p_size - 25), 10) AS BIGINT) AS "C" FROM part')
rules("type_tests", "? property(X, K, V), integer(V).", f"SELECT DISTINCT {_P} AS \"X\", 'size' AS \"K\", CAST(p_size AS VARCHAR) AS \"V\" FROM part")
rules("term_order", '? prop_brand(P, B), B @< "Brand#2".', f"SELECT DISTINCT {_P} AS \"P\", p_brand AS \"B\" FROM part WHERE p_brand < 'Brand#2'")
rules("list_member", "? member(K, [size, brand]), property('part:7', K, _).", "SELECT unnest(['size', 'brand']) AS \"K\" FROM part WHERE p_partkey = 7")
rules("list_split", "? append(A, B, [1, 2, 3]), length(A, N), length(B, M).", "SELECT * FROM (VALUES ('', '1,2,3', 0::BIGINT, 3::BIGINT), ('1', '2,3', 1, 2), ('1,2', '3', 2, 1), ('1,2,3', '', 3, 0)) t(\"A\", \"B\", \"N\", \"M\")", A="joined", B="joined")
rules("list_nth", "? region(R), nth0(1, [a, b, c], X), nth1(1, [a, b, c], Y).", f'SELECT {_R} AS "R", \'b\' AS "X", \'a\' AS "Y" FROM region')
rules("chars_reverse", "? nation(N), prop_name(N, T), string_chars(T, L), reverse(L, M), string_chars(U, M), length(L, K).", f'SELECT {_N} AS "N", n_name AS "T", array_to_string(string_split(n_name, \'\'), \',\') AS "L", array_to_string(list_reverse(string_split(n_name, \'\')), \',\') AS "M", reverse(n_name) AS "U", CAST(length(n_name) AS BIGINT) AS "K" FROM nation', L="joined", M="joined")
rules("codes", '? region(R), prop_name(R, T), string_codes(T, L), nth0(0, L, C).', f'SELECT {_R} AS "R", r_name AS "T", array_to_string([ascii(x) for x in string_split(r_name, \'\')], \',\') AS "L", CAST(ascii(r_name) AS BIGINT) AS "C" FROM region', L="joined")
rules("number_text", "? prop_size(P, S), number_string(S, T).", f'SELECT DISTINCT {_P} AS "P", CAST(p_size AS BIGINT) AS "S", CAST(p_size AS VARCHAR) AS "T" FROM part')
rules("terms", "? functor(point(1, 2), F, A), point(1, 2) =.. [_ | L], arg(2, point(1, 2), X).", "SELECT 'point' AS \"F\", 2::BIGINT AS \"A\", '1,2' AS \"L\", 2::BIGINT AS \"X\"", L="joined")

# -- graph
rules("out_degree", "? customer(C), out_degree(C, N).", f'SELECT {_C} AS "C", CAST(1 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS BIGINT) AS "N" FROM customer')
rules("in_degree", "? part(P), in_degree(P, N).", f'SELECT {_P} AS "P", CAST((SELECT count(*) FROM lineitem WHERE l_partkey = p.p_partkey) + (SELECT count(*) FROM part q WHERE q.p_partkey > 1 AND q.p_partkey // 2 = p.p_partkey) AS BIGINT) AS "N" FROM part p')
rules("degree", "? region(R), degree(R, N).", f'SELECT {_R} AS "R", (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS "N" FROM region')
rules("neighbors", "? neighbors(X, child_of, Y).", f'WITH {_TREE} SELECT s AS "X", t AS "Y" FROM tree')
rules("labels_view", "? supplier(X), labels(X, L).", f"SELECT {_S} AS \"X\", 'supplier' AS \"L\" FROM supplier", L="joined")
rules("edges_view", "? in_edges('region:1', in_region, E).", "SELECT '[' || string_agg('{\"id\":\"' || n || ':in_region:region:1\",\"edge_type\":\"in_region\",\"source\":\"' || n || '\",\"target\":\"region:1\"}', ',' ORDER BY n || ':in_region:region:1') || ']' AS \"E\" FROM (SELECT 'nation:' || n_nationkey AS n FROM nation WHERE n_regionkey = 1)")
rules("node_view", "? node_view('region:1', V).", "SELECT '{\"id\":\"region:1\",\"labels\":[\"region\"],\"properties\":{\"name\":\"' || (SELECT r_name FROM region WHERE r_regionkey = 1) || '\"},\"out_edges\":[],\"in_edges\":[' || string_agg('{\"id\":\"' || n || ':in_region:region:1\",\"edge_type\":\"in_region\",\"source\":\"' || n || '\",\"target\":\"region:1\"}', ',' ORDER BY n || ':in_region:region:1') || ']}' AS \"V\" FROM (SELECT 'nation:' || n_nationkey AS n FROM nation WHERE n_regionkey = 1)")
rules("reachable", "? reachable('customer:7', X).", """WITH RECURSIVE e AS (SELECT 'customer:' || o_custkey AS s, 'order:' || o_orderkey AS t FROM orders UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem UNION SELECT 'part:' || p_partkey, 'part:' || (p_partkey // 2) FROM part WHERE p_partkey > 1 UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
  r(x) AS (SELECT t FROM e WHERE s = 'customer:7' UNION SELECT e.t FROM r JOIN e ON e.s = r.x) SELECT x AS "X" FROM r""")
rules("reachable_bounded", "? reachable('part:1000', X, 3).", "SELECT 'part:' || unnest([500, 250, 125]) AS \"X\" FROM part WHERE p_partkey = 1000")
rules("shortest_path", "? shortest_path('part:100', 'part:3', P), length(P, N).", "SELECT 'part:100,part:50,part:25,part:12,part:6,part:3' AS \"P\", 6::BIGINT AS \"N\" FROM part WHERE p_partkey = 100", P="joined")
_UP = f"WITH RECURSIVE {_TREE}, up(x, y, d) AS (SELECT s, s, 0 FROM tree UNION SELECT up.x, t, d + 1 FROM up JOIN tree ON tree.s = up.y)"
_UP_RULES = "up(X, X, 0) :- child_of(X, _). up(From, Top, Steps) :- up(From, Mid, Fewer), child_of(Mid, Top), is(Steps, '+'(1, Fewer))."
rules("linear_recursion", "? below(X, Y).", f'WITH RECURSIVE {_TREE}, r(x, y) AS (SELECT s, t FROM tree UNION SELECT r.x, t FROM r JOIN tree ON tree.s = r.y) SELECT x AS "X", y AS "Y" FROM r', ":- table below/2. below(X, Y) :- child_of(X, Y). below(X, Y) :- child_of(X, Z), below(Z, Y).")
rules("bound_recursion", "? below('part:777', Y).", f"WITH RECURSIVE {_TREE}, r(y) AS (SELECT t FROM tree WHERE s = 'part:777' UNION SELECT t FROM r JOIN tree ON tree.s = r.y) SELECT y AS \"Y\" FROM r", "below(X, Y) :- child_of(X, Y). below(X, Y) :- child_of(X, Z), below(Z, Y).")
rules("nonlinear_recursion", "? below('part:777', Y).", f"WITH RECURSIVE {_TREE}, r(y) AS (SELECT t FROM tree WHERE s = 'part:777' UNION SELECT t FROM r JOIN tree ON tree.s = r.y) SELECT y AS \"Y\" FROM r", "below(X, Y) :- child_of(X, Y). below(X, Y) :- below(X, Z), below(Z, Y).")
rules("mutual_recursion", "? even(X, 'part:1').", f"{_UP} SELECT x AS \"X\" FROM up WHERE y = 'part:1' AND d % 2 = 0 AND d > 0", "odd(X, Y) :- child_of(X, Y). odd(X, Y) :- child_of(X, Z), even(Z, Y). even(X, Y) :- child_of(X, Z), odd(Z, Y).")
rules("lineage", "? up('part:900', Y, D).", f"{_UP} SELECT y AS \"Y\", CAST(d AS BIGINT) AS \"D\" FROM up WHERE x = 'part:900'", _UP_RULES)
rules("tree_distance", "? up('part:100', L, A), up('part:75', L, B), D is A + B.", f"{_UP} SELECT a.y AS \"L\", CAST(a.d AS BIGINT) AS \"A\", CAST(b.d AS BIGINT) AS \"B\", CAST(a.d + b.d AS BIGINT) AS \"D\" FROM up a JOIN up b ON a.y = b.y WHERE a.x = 'part:100' AND b.x = 'part:75'", _UP_RULES)
rules("tree_lca", "? lca('part:100', 'part:75', L).", f"{_UP} SELECT a.y AS \"L\" FROM up a JOIN up b ON a.y = b.y WHERE a.x = 'part:100' AND b.x = 'part:75' ORDER BY a.d LIMIT 1", _UP_RULES + " common(X, Y, L, D) :- up(X, L, D), up(Y, L, _). lca(X, Y, L) :- common(X, Y, L, D), \\+(closer(X, Y, D)). closer(X, Y, D) :- common(X, Y, _, E), '<'(E, D).")


@query("edge_counts", "SELECT * FROM (VALUES ('in_region', (SELECT count(*) FROM nation)), ('in_nation', (SELECT count(*) FROM customer)), ('based_in', (SELECT count(*) FROM supplier)), ('placed', (SELECT count(*) FROM orders)), ('child_of', (SELECT count(*) FROM part WHERE p_partkey > 1)), ('contains', (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)))) t(\"K\", n)")
def edge_counts(spark, sf):
    return Engine(spark, star_catalog(spark, sf)).aggregate("? edge_id(S, K, T, I).", ["K"], n=F.count("*"))


@query("introspect", "SELECT * FROM (VALUES ('big', 1::BIGINT, 'big(C) :- placed(C, O), prop_totalprice(O, P), ''>''(P, 400000).')) t(\"N\", \"A\", \"T\")")
def introspect(spark, sf):
    return Engine(spark, star_catalog(spark, sf)).consult("big(C) :- placed(C, O), prop_totalprice(O, P), '>'(P, 400000). region_of(a, b).").query("? rule(N, A, T).")


@query("rule_dependencies", "SELECT * FROM (VALUES ('a/1', 'b/1'), ('a/1', 'region/1'), ('b/1', 'region/1')) t(\"A\", \"B\")")
def rule_dependencies(spark, sf):
    return Engine(spark, star_catalog(spark, sf)).consult("a(X) :- b(X), region(X). b(X) :- region(X).").query("? rule_depends_on(A, B).")


@query("proof", "SELECT 'customer:' || o_custkey AS \"C\", 'fact placed(customer:' || o_custkey || ', order:7); rule buyer/1#1' AS proof FROM orders WHERE o_orderkey = 7")
def proof(spark, sf):
    return Engine(spark, star_catalog(spark, sf)).consult("buyer(C) :- placed(C, 'order:7').").prove("? buyer(C).").withColumn("proof", F.array_join("proof", "; "))


@query("explain_plan", "SELECT * FROM (VALUES ('placed/2', 'free,free', 'edge_scan'), ('prop_mktsegment/2', 'bound,bound', 'entity_property'), ('>/2', 'free,bound', 'builtin')) t(predicate, arguments, access)")
def explain_plan(spark, sf):
    rows = Engine(spark, star_catalog(spark, sf)).explain('? placed(C, O), prop_mktsegment(C, "BUILDING"), P > 1.')
    return spark.createDataFrame([(r["predicate"], ",".join(r["arguments"]), r["access"]) for r in rows], "predicate string, arguments string, access string")


# -- text
_BM25 = r"""WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
  h AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN ('the', 'hash', 'pathetic') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
  x AS (SELECT doc_id, lang, h.term, tf, df, dl, avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM h JOIN d USING (term), s)"""


@query("bm25_all", _BM25 + " SELECT doc_id, round(sum(score), 6) AS score FROM x GROUP BY doc_id")
def bm25_all(spark, sf):
    scored = text.bm25_explain(table(spark, sf, "documents"), "The hash, the PATHETIC")
    return scored.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


@query("bm25_topk", _BM25 + " SELECT doc_id, round(sum(score), 6) AS score, row_number() OVER (ORDER BY round(sum(score), 9) DESC, doc_id) AS rank FROM x GROUP BY doc_id ORDER BY rank LIMIT 20")
def bm25_topk(spark, sf):
    return text.bm25(table(spark, sf, "documents"), "the hash pathetic", 20).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("bm25_filtered", _BM25 + " SELECT doc_id, round(2.5 * sum(score), 6) AS score FROM x WHERE lang = 'de' GROUP BY doc_id")
def bm25_filtered(spark, sf):
    scored = text.bm25_explain(table(spark, sf, "documents"), "the hash pathetic", weight=2.5, where=F.col("lang") == "de")
    return scored.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


@query("bm25_explain", _BM25 + " SELECT doc_id, term, tf, df, CAST(dl AS BIGINT) AS dl, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl, round(score, 6) AS score FROM x")
def bm25_explain(spark, sf):
    return text.bm25_explain(table(spark, sf, "documents"), "the hash pathetic").select("doc_id", "term", "tf", "df", F.col("dl").cast("long").alias("dl"), *(F.round(c, 6).alias(c) for c in ("idf", "avgdl", "score")))


@query("page_2", _BM25 + ", r AS (SELECT doc_id, row_number() OVER (ORDER BY round(sum(score), 9) DESC, doc_id) AS rank FROM x GROUP BY doc_id) SELECT doc_id, rank, 10 + 10 AS next_offset, false AS exhausted FROM r WHERE rank > 10 AND rank <= 20")
def page_2(spark, sf):
    scored = text.bm25(table(spark, sf, "documents"), "the hash pathetic").drop("rank")
    return text.page(scored, 10, 10, 256).select("doc_id", F.col("rank").cast("long"), "next_offset", "exhausted")


@query("chunk_paragraph", None)
def chunk_paragraph(spark, sf):
    return text.chunked(table(spark, sf, "documents"), "paragraph").select("doc_id", "ordinal", "start", "end", "fingerprint")


@query("chunk_window", None)
def chunk_window(spark, sf):
    return text.chunked(table(spark, sf, "documents"), "window", size=100, overlap=20).select("doc_id", "ordinal", "start", "end", "fingerprint")


@query("chunk_whole", "SELECT doc_id, 0 AS ordinal, 0 AS start, CAST(octet_length(encode(text)) AS INTEGER) AS \"end\", sha256(text) AS fingerprint FROM documents WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''")
def chunk_whole(spark, sf):
    return text.chunked(table(spark, sf, "documents"), "whole").select("doc_id", "ordinal", "start", "end", "fingerprint")


# -- vectors
_Q = [round(0.1 * ((i * 7) % 11 - 5), 3) for i in range(64)]
_QS = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"
_COS = f"list_dot_product(embedding::DOUBLE[], {_QS}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_QS}, {_QS})))"


@query("vector_topk", f"SELECT vec_id AS doc_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 10")
def vector_topk(spark, sf):
    return vector.search(table(spark, sf, "embeddings"), _Q, 10).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("vector_threshold", f"SELECT vec_id AS doc_id, round({_COS}, 6) AS score FROM embeddings WHERE {_COS} >= 0.1")
def vector_threshold(spark, sf):
    return vector.search(table(spark, sf, "embeddings"), _Q, threshold=0.1).select("doc_id", F.round("score", 6).alias("score"))


@query("vector_filtered", f"SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], {_QS}), 5) AS score FROM embeddings WHERE label IN (1, 2)")
def vector_filtered(spark, sf):
    return vector.search(table(spark, sf, "embeddings"), _Q, metric="dot", where=F.col("label").isin(1, 2)).select("doc_id", F.round("score", 5).alias("score"))


@query("vector_similar", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7), s AS (SELECT vec_id AS entity, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM e, q WHERE vec_id <> 7) SELECT entity, round(score, 6) AS score FROM s WHERE score >= 0")
def vector_similar(spark, sf):
    return vector.similar(table(spark, sf, "embeddings"), 7).select("entity", F.round("score", 6).alias("score"))


@query("vector_problems", "SELECT vec_id, 'norm' AS problem FROM embeddings WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-4")
def vector_problems(spark, sf):
    return vector.problems(table(spark, sf, "embeddings"), 64, True).select("vec_id", "problem")


# -- time
def utc(col: str):
    """A zoneless time as UTC, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(col)))


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", utc("ts").alias("at"))


def sessions(spark, sf) -> DataFrame:
    """Each event lasts until the user's next one; the last is open."""
    w = W.partitionBy("user_id").orderBy("at", "id")
    return events(spark, sf).withColumn("valid_to", F.lead("at").over(w)).withColumnRenamed("at", "valid_from")


_EV = "SELECT event_id AS id, user_id, event_type, ts AS at_ FROM events"
_SE = "SELECT event_id AS id, user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events"
_DAY = "2024-01-05"


@query("temporal_on", f"SELECT id FROM ({_EV}) WHERE at_ >= TIMESTAMP '{_DAY}' AND at_ < TIMESTAMP '{_DAY}' + INTERVAL 1 DAY")
def temporal_on(spark, sf):
    return temporal.on_day(events(spark, sf), _DAY).select("id")


@query("temporal_between", f"SELECT id FROM ({_EV}) WHERE at_ >= TIMESTAMP '2024-01-03 02:00:00' AND at_ < TIMESTAMP '2024-01-09'")
def temporal_between(spark, sf):
    return temporal.between(events(spark, sf), "2024-01-03T00:00:00-02:00", "2024-01-09").select("id")


@query("event_after", f"SELECT id FROM ({_EV}) WHERE at_ > TIMESTAMP '{_DAY}' ORDER BY at_, id LIMIT 20")
def event_after(spark, sf):
    return temporal.after(events(spark, sf), _DAY, 20).select("id")


@query("event_before", f"SELECT id FROM ({_EV}) WHERE at_ < TIMESTAMP '{_DAY}' ORDER BY at_ DESC, id DESC LIMIT 20")
def event_before(spark, sf):
    return temporal.before(events(spark, sf), _DAY, 20).select("id")


@query("valid_at", f"SELECT id FROM ({_SE}) WHERE valid_from <= TIMESTAMP '{_DAY}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_DAY}')")
def valid_at(spark, sf):
    return temporal.valid_at(sessions(spark, sf), _DAY).select("id")


@query("valid_overlaps", f"SELECT id FROM ({_SE}) WHERE valid_from < TIMESTAMP '2024-01-07' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_DAY}')")
def valid_overlaps(spark, sf):
    return temporal.valid_overlaps(sessions(spark, sf), _DAY, "2024-01-07").select("id")


@query("validity_stats", f"SELECT count(*) AS total, count(*) FILTER (valid_to IS NULL) AS open_ended, strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') AS lo, strftime(max(valid_to), '%Y-%m-%d %H:%M:%S') AS hi FROM ({_SE})")
def validity_stats(spark, sf):
    s = temporal.stats(sessions(spark, sf).withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")}))
    shown = lambda c: F.date_format(F.to_utc_timestamp(F.col(c), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return s.select("total", "open_ended", shown("min_start").alias("lo"), shown("max_end").alias("hi"))


@query("as_of_join", "SELECT p.event_id AS id, coalesce(v.event_id, -1) AS version FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def as_of_join(spark, sf):
    e = events(spark, sf)
    versions = e.filter("event_type = 'view'").groupBy("user_id", F.col("at").alias("valid_from")).agg(F.max("id").alias("version"))
    return temporal.as_of(versions, e.filter("event_type = 'purchase'").select("user_id", "at", "id"), "user_id").select("id", F.coalesce("version", F.lit(-1)).alias("version"))


_BY_TYPE = "SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS te FROM events"


@query("overlap_join", f"WITH s AS (SELECT * FROM ({_BY_TYPE}) WHERE te IS NULL OR te > ts) SELECT a.event_id AS a, b.event_id AS b FROM s a JOIN s b ON a.user_id = b.user_id AND a.ts < coalesce(b.te, TIMESTAMP '9999-12-31') AND b.ts < coalesce(a.te, TIMESTAMP '9999-12-31') WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def overlap_join(spark, sf):
    """Purchases and views of a user whose intervals, each up to the next of its kind, overlap."""
    w = W.partitionBy("user_id", "event_type").orderBy("at", "id")
    s = events(spark, sf).withColumn("valid_to", F.lead("at").over(w)).withColumnRenamed("at", "valid_from").filter("valid_to is null or valid_to > valid_from")
    side = lambda kind: s.filter(F.col("event_type") == kind).select("user_id", "id", "valid_from", "valid_to")
    return temporal.overlap_join(side("purchase"), side("view"), ["user_id"]).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


# -- hybrid retrieval
def _rankings(spark, sf):
    lexical = text.bm25(table(spark, sf, "documents"), "the hash pathetic", 100)
    return {"bm25": lexical, "vector": vector.search(table(spark, sf, "embeddings"), _Q, 100)}


_RRF = _BM25 + f", l AS (SELECT doc_id, row_number() OVER (ORDER BY round(sum(score), 9) DESC, doc_id) AS r FROM x GROUP BY doc_id ORDER BY r LIMIT 100), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings ORDER BY r LIMIT 100), f AS (SELECT doc_id, coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0) AS s, l.r AS lr, v.r AS vr FROM l FULL JOIN v USING (doc_id))"


@query("rrf_hybrid", _RRF + " SELECT doc_id, round(s, 9) AS fused_score, coalesce(lr, 0) AS bm25_rank, coalesce(vr, 0) AS vector_rank FROM f")
def rrf_hybrid(spark, sf):
    return retrieval.fuse(_rankings(spark, sf)).select("doc_id", F.round("fused_score", 9).alias("fused_score"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bm25_rank", "vector_rank")))


@query("hybrid_filtered", _RRF + ", c AS (SELECT doc_id, row_number() OVER (ORDER BY round(s, 12) DESC, doc_id) AS fused_rank FROM f) SELECT doc_id, fused_rank FROM c JOIN documents d USING (doc_id) WHERE fused_rank <= 256 AND lang = 'en' AND n_chars > 500 ORDER BY fused_rank LIMIT 10")
def hybrid_filtered(spark, sf):
    docs = table(spark, sf, "documents")
    out = retrieval.filtered(retrieval.fuse(_rankings(spark, sf)), retrieval.Budget(10, 256), docs.filter("lang = 'en'"), docs.filter("n_chars > 500"))
    return out.select("doc_id", F.col("fused_rank").cast("long"))


@query("retrieval_quality", "WITH r AS (SELECT CAST(user_id AS VARCHAR) AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), j AS (SELECT CAST(user_id AS VARCHAR) AS query_id, event_id AS doc_id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS rel FROM events), g AS (SELECT * FROM j WHERE rel > 0), p AS (SELECT query_id, max(1.0::DOUBLE / rank) AS mrr, sum(CASE WHEN rank <= 10 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN g USING (query_id, doc_id) GROUP BY query_id), i AS (SELECT query_id, sum(CASE WHEN k <= 10 THEN (pow(2, rel) - 1) / log2(k + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS k FROM g) GROUP BY query_id) SELECT count(*) AS queries, round(avg(coalesce(mrr, 0)), 6) AS mrr, round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg_10 FROM i LEFT JOIN p USING (query_id)")
def retrieval_quality(spark, sf):
    e = table(spark, sf, "events").withColumn("query_id", F.col("user_id").cast("string")).withColumn("doc_id", F.col("event_id"))
    ranked = e.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("value").desc(), "doc_id"))).select("query_id", "doc_id", "rank")
    judged = e.select("query_id", "doc_id", F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0).alias("rel"))
    return retrieval.quality(ranked, judged).select("queries", F.round("mrr", 6).alias("mrr"), F.round("ndcg_10", 6).alias("ndcg_10"))


def _indexed(spark, sf) -> Engine:
    """Documents, vectors, events and sessions as goals; document and vector ids are the same atoms."""
    name = lambda c: F.col(c).cast("string")
    docs = table(spark, sf, "documents").select(name("doc_id").alias("id"), "text")
    vecs = table(spark, sf, "embeddings").select(name("vec_id").alias("id"), "embedding")
    ev = events(spark, sf).select(name("id").alias("id"), "user_id", "at")
    return attach(Engine(spark, Catalog(spark).property("lang", table(spark, sf, "documents").select(name("doc_id"), "lang"), "str")), docs, vecs, ev, sessions(spark, sf).withColumn("id", name("id")))


@query("goal_bm25", _BM25 + """ SELECT CAST(doc_id AS VARCHAR) AS "D", round(sum(score), 6) AS "S" FROM x WHERE lang = 'fr' GROUP BY doc_id""")
def goal_bm25(spark, sf):
    return _indexed(spark, sf).query('? prop_lang(D, "fr"), bm25("the hash pathetic", D, S).').select("D", F.round("S", 6).alias("S"))


@query("goal_vector_similar", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7), s AS (SELECT vec_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS s FROM e, q WHERE vec_id <> 7) SELECT CAST(vec_id AS VARCHAR) AS "D", round(s, 6) AS "S" FROM s WHERE s > 0.1""")
def goal_vector_similar(spark, sf):
    return _indexed(spark, sf).query("? vector_similar('7', D, S), S > 0.1.").select("D", F.round("S", 6).alias("S"))


@query("goal_times", f"""SELECT CAST(id AS VARCHAR) AS "E" FROM ({_SE}) WHERE valid_from >= TIMESTAMP '2024-01-04' AND valid_from < TIMESTAMP '2024-01-06' AND valid_from <= TIMESTAMP '{_DAY}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_DAY}')""")
def goal_times(spark, sf):
    return _indexed(spark, sf).query(f'? temporal_between("2024-01-04", "2024-01-06", E), valid_at("{_DAY}", E).')


@query("goal_retrieve", _RRF + """ SELECT CAST(doc_id AS VARCHAR) AS "D" FROM (SELECT doc_id, row_number() OVER (ORDER BY round(sum(score), 9) DESC, CAST(doc_id AS VARCHAR)) AS r FROM x GROUP BY doc_id) WHERE r <= 10""")
def goal_retrieve(spark, sf):
    return _indexed(spark, sf).query('? retrieve("the hash pathetic", {top_k: 10}, D, Details).').select("D")


# -- mutations and lifecycle
def _graph(spark, sf) -> mutate.Graph:
    t = lambda n: table(spark, sf, n)
    props = lambda *kv: F.create_map(*kv).cast("map<string,string>")
    nodes = t("customer").select(_id("customer", "c_custkey").alias("id"), F.array(F.lit("customer")).alias("labels"), props(F.lit("segment"), F.to_json(F.array("c_mktsegment")).substr(F.lit(2), F.length(F.to_json(F.array("c_mktsegment"))) - 2)).alias("properties"), F.lit(1).cast("long").alias("version"))
    nodes = nodes.unionByName(t("orders").select(_id("order", "o_orderkey").alias("id"), F.array(F.lit("order")).alias("labels"), props(F.lit("price"), F.col("o_totalprice").cast("string")).alias("properties"), F.lit(1).cast("long").alias("version")))
    edges = t("orders").select(F.concat(F.lit("placed:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("placed").alias("edge_type"), _id("customer", "o_custkey").alias("source"), _id("order", "o_orderkey").alias("target"), props().alias("properties"), F.lit(1).cast("long").alias("version"))
    return mutate.Graph(nodes, edges, spark.createDataFrame([], mutate.OUTBOX))


@query("apply_patch", "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN '\"debt\"' END AS note, CASE WHEN c_acctbal >= 0 OR c_mktsegment <> 'BUILDING' THEN '\"' || c_mktsegment || '\"' END AS segment, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM customer")
def apply_patch(spark, sf):
    poor = table(spark, sf, "customer").filter("c_acctbal < 0")
    patches = poor.select(_id("customer", "c_custkey").alias("id"), F.create_map(F.lit("note"), F.lit('"debt"')).alias("set"), F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("segment"))).otherwise(F.array().cast("array<string>")).alias("remove"))
    g = mutate.patch_nodes(_graph(spark, sf), patches)
    return g.nodes.filter(F.array_contains("labels", "customer")).select("id", F.col("properties")["note"].alias("note"), F.col("properties")["segment"].alias("segment"), "version")


@query("cascade_delete", "SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) + (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0) AS edges, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0) AS edge_events, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS node_events")
def cascade_delete(spark, sf):
    g = mutate.delete_nodes(_graph(spark, sf), table(spark, sf, "customer").filter("c_acctbal < 0").select(_id("customer", "c_custkey").alias("id")))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    o = stage_table(spark, g.outbox, "outbox")
    return count(g.nodes, "nodes").crossJoin(count(g.edges, "edges")).crossJoin(count(o.filter("entity_kind = 'edge'"), "edge_events")).crossJoin(count(o.filter("entity_kind = 'node'"), "node_events"))


@query("fact_upsert", "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'customer,debtor' ELSE 'customer' END AS labels, CASE WHEN c_acctbal < 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer")
def fact_upsert(spark, sf):
    poor = table(spark, sf, "customer").filter("c_acctbal < 0")
    none = F.lit(None)
    facts = poor.select(F.lit("debtor").alias("name"), _id("customer", "c_custkey").alias("a"), none.cast("string").alias("b"), none.cast("map<string,string>").alias("properties"))
    facts = facts.unionByName(poor.select(F.lit("prop_nation").alias("name"), _id("customer", "c_custkey").alias("a"), F.col("c_nationkey").cast("string").alias("b"), none.cast("map<string,string>").alias("properties")))
    g = mutate.upsert_facts(_graph(spark, sf), facts)
    return g.nodes.filter(F.array_contains("labels", "customer")).select("id", F.array_join("labels", ",").alias("labels"), F.col("properties")["nation"].alias("nation"))


@query("retract_pattern", "SELECT 'placed:' || o_orderkey AS id FROM orders WHERE o_custkey <> 7")
def retract_pattern(spark, sf):
    return mutate.retract_facts(_graph(spark, sf), "placed", "customer:7").edges.select("id")


@query("outbox_stale", "SELECT event_id AS sequence, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'current' ELSE 'stale' END AS status FROM events")
def outbox_stale(spark, sf):
    v = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    box = table(spark, sf, "events").select(F.col("event_id").alias("sequence"), F.lit("node").alias("entity_kind"), F.col("user_id").cast("string").alias("entity_id"), v.alias("source_version"))
    return lifecycle.current_events(box).select("sequence", "status")


@query("outbox_compaction", "SELECT event_id AS sequence FROM events WHERE event_id > 300")
def outbox_compaction(spark, sf):
    box = table(spark, sf, "events").select(F.col("event_id").alias("sequence"))
    return mutate.compacted(box, spark.createDataFrame([("bm25", 900), ("vector", 300)], "target string, published long"))


@query("manifest_diff", "SELECT CAST(p_partkey AS VARCHAR) AS entity, CASE WHEN p_size < 20 THEN 'delete' WHEN p_size > 30 THEN 'insert' WHEN p_retailprice > 1500 THEN 'update' ELSE 'keep' END AS action FROM part")
def manifest_diff(spark, sf):
    """Documents of parts up to size 30 were indexed, those from size 20 are wanted, the dear ones with new content."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity"), F.lit("body").alias("field"), F.lit("0").alias("chunk_id"), F.sha2("p_name", 256).alias("fingerprint"), "p_size", "p_retailprice")
    new = rows.filter("p_size >= 20").withColumn("fingerprint", F.when(F.col("p_retailprice") > 1500, F.lit("changed")).otherwise(F.col("fingerprint")))
    return lifecycle.manifest_diff(rows.filter("p_size <= 30"), new).select("entity", "action")


@query("job_metrics", "SELECT * FROM (VALUES ('completed', 1::BIGINT), ('retry', 1::BIGINT), ('leased', 1::BIGINT), ('pending', (SELECT count(*) - 3 FROM part))) t(state, jobs)")
def job_metrics(spark, sf):
    none = F.lit(None).cast("long")
    jobs = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.col("p_partkey").alias("created_at"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"), none.alias("leased_until"), none.alias("not_before"))
    jobs = lifecycle.claim_jobs(jobs, 100, 3)
    done = lifecycle.finish_jobs(jobs, spark.createDataFrame([("1", True), ("2", False)], "document_id string, ok boolean"), 100)
    return lifecycle.job_metrics(done)


# -- extensions
@query("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty, round(avg(l_discount), 6) AS disc, max(l_tax) AS tax FROM lineitem GROUP BY ALL")
def agg_group(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.max("l_tax").alias("tax"))


@query("agg_cube", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query("agg_rollup", "SELECT coalesce(n_regionkey, -1) AS region, coalesce(c_nationkey, -1) AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)")
def agg_rollup(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rolled = j.rollup("n_regionkey", "c_nationkey").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("n_regionkey", F.lit(-1)).alias("region"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"), "n")


@query("distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def distinct_count(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))


@query("window_rank", "SELECT s_suppkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS q FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)")
def window_rank(spark, sf):
    w = W.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc())
    return table(spark, sf, "supplier").select("s_suppkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(W.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")).cast("long").alias("q"))


@query("window_frame", "SELECT event_id, coalesce(lag(event_id) OVER w, -1) AS before, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_frame(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.coalesce(F.lag("event_id").over(w), F.lit(-1)).alias("before"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("m"))


@query("tumble", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumble(spark, sf):
    return windowed_counts(table(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("slide", "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")
def slide(spark, sf):
    return windowed_counts(table(spark, sf, "events"), "1 hour", "30 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session(spark, sf):
    w = F.session_window("ts", "6 hours").alias("w")
    return table(spark, sf, "events").groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("topk_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def topk_per_group(spark, sf):
    w = W.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, sf, "customer").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("c_nationkey", "c_custkey")


from . import catalogue_stored  # noqa: E402, F401
