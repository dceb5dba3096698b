import pytest
from pyspark.sql import functions as F

from hornbeam import shared
from hornbeam.facade import Database
from hornbeam.operators import lifecycle, temporal, text
from hornbeam.operators.stored import Log
from hornbeam.plans import engine as engines
from hornbeam.plans.catalog import Catalog
from hornbeam.plans.engine import Engine, TableStore
from hornbeam.plans.indexes import attach

REACH = "reach(X, Y) :- link(X, Y). reach(X, Y) :- link(X, Z), reach(Z, Y)."


def _catalog(spark):
    return Catalog(spark).edge("link", spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string"))


def test_answer_tables_are_found_by_another_engine(spark, tmp_path, monkeypatch):
    ask = lambda e: {(r["X"], r["Y"]) for r in e.query("? reach(X, Y).").collect()}
    want = ask(Engine(spark, _catalog(spark), tables=TableStore(spark, str(tmp_path), "v1")).consult(REACH))
    assert len(want) == 12
    with monkeypatch.context() as m:
        m.setattr(Engine, "_semi_naive", lambda *a: pytest.fail("computed anew"))
        assert ask(Engine(spark, _catalog(spark), tables=TableStore(spark, str(tmp_path), "v1")).consult(REACH)) == want
    # Other rules, or another version of the data, are other tables.
    assert ask(Engine(spark, _catalog(spark), tables=TableStore(spark, str(tmp_path), "v1")).consult(REACH + " reach(d, d).")) == want | {("d", "d")}
    other = Catalog(spark).edge("link", spark.createDataFrame([("a", "b")], "source string, target string"))
    assert ask(Engine(spark, other, tables=TableStore(spark, str(tmp_path), "v2")).consult(REACH)) == {("a", "b")}


def test_the_least_used_tables_go(spark, monkeypatch):
    monkeypatch.setattr(engines, "MOST_TABLES", 2)
    e = Engine(spark, _catalog(spark)).consult(REACH)
    for x in ("a", "b", "a", "c"):
        e.query(f"? reach({x}, Y).").count()
    assert len(e._tables) == 2 and any("a" in str(k) for k in e._tables)
    assert e.metrics == {"computed": 3, "found": 1, "read": 0}


def test_directives(spark):
    seen = []
    e = Engine(spark)
    e.directives["note"] = lambda *args: seen.append(args)
    e.consult(":- dynamic p/1. :- note(a, 1). :- unheard_of(x). p(1).")
    assert len(seen) == 1 and e.ask("? p(1).")


def test_answer_limits_are_told(spark):
    docs = spark.createDataFrame([(str(i), "word") for i in range(5)], "id string, text string")
    e = attach(Engine(spark, Catalog(spark)), docs, answer_limit=3)
    assert e.query('? bm25("word", D, S).').count() == 3 and e.exhausted == ["bm25"]
    e = attach(Engine(spark, Catalog(spark)), docs, answer_limit=5)
    assert e.query('? bm25("word", D, S).').count() == 5 and e.exhausted == []


def test_times_of_one_entity(spark):
    rows = spark.createDataFrame([("a", "2026-01-01", "2026-02-01"), ("b", "2026-01-01", None), ("a", "2026-03-01", None)], "id string, s string, e string").select("id", F.to_timestamp("s").alias("valid_from"), F.to_timestamp("e").alias("valid_to"))
    assert temporal.valid_at_for_entity(rows, "a", "2026-01-10").count() == 1 and temporal.overlaps_for_entity(rows, "a", "2026-01-10", "2026-04-01").count() == 2
    assert temporal.between_for_entity(rows.withColumnRenamed("valid_from", "at"), "b", "2026-01-01", "2026-01-02").count() == 1


def test_access_path_reads_the_lesser_share(spark, tmp_path):
    days = spark.range(100).select(F.col("id"), F.timestamp_seconds(F.col("id") * 86_400).alias("valid_from"), F.timestamp_seconds(F.col("id") * 86_400 + 3600).alias("valid_to"))
    bounds = temporal.stats(days).first().asDict()
    early, late = temporal.access_path(bounds, "1970-01-05"), temporal.access_path(bounds, "1970-04-05")
    assert early[0] == "start" and early[1] < 0.1 and late[0] == "end" and late[1] < 0.1
    assert temporal.access_path({**bounds, "open_ended": 100}, "1970-04-05")[0] == "start"
    assert temporal.ordered_by(days, str(tmp_path / "t"), "end").count() == 100


def test_han_words_by_dictionary(spark):
    assert text.segmented("我爱北京天安门 Hello2 のx", frozenset(["北京", "天安门", "天安"]), 3) == ["我", "爱", "北京", "天安门", "hello2", "の", "x"]
    df = spark.createDataFrame([("北京Abc",), (None,)], "t string")
    assert [r["w"] for r in df.select(text.dictionary_terms(["北京"])("t").alias("w")).collect()] == [["北京", "abc"], []]


def test_profiles_and_generations_are_found_again(spark, tmp_path):
    log = lambda n: Log(spark, str(tmp_path / n))
    p = lifecycle.Profiles(True, log("p"))
    p.put(lifecycle.Profile("x", 1, ("doc",), bm25={"body": 2.0}))
    p.activate("x", 1)
    again = lifecycle.Profiles(True, log("p"))
    assert again.held == p.held and again.active == {"x": 1}
    with pytest.raises(ValueError):
        again.put(lifecycle.Profile("x", 1, ("other",)))
    with pytest.raises(ValueError):
        lifecycle.Profiles(False, log("q")).put(lifecycle.Profile("v", 1, vector={"body": "m"}))
    g = lifecycle.Generations(log("g"))
    for step in ("build", "validate", "activate"):
        one = g.act(step, g.active or max(g.states, default=0) or g.create())
    assert one == "active" and lifecycle.Generations(log("g")).active == 1


def test_a_database_in_a_folder(spark, tmp_path):
    def ok(db, **request):
        answer = db.handle(request)
        assert answer["type"] == "success", answer
        return answer["data"]

    db = Database(spark, path=str(tmp_path / "db"))
    ok(db, command="add_node", id="a", labels=["doc"], properties={"body": "red apple"})
    ok(db, command="add_rules", text=':- index_profile(p, 1, {labels: [doc], bm25: {body: 1.5}}). :- activate_index_profile(p, 1). fruit(X) :- doc(X).')
    assert ok(db, command="query", query="? fruit(X), set_node_property(a, colour, \"red\").") == [{"X": "a"}]
    assert ok(db, command="query", query="? remove_node_property(zz, colour).") == []
    db = Database(spark, path=str(tmp_path / "db"))
    assert ok(db, command="get_node", id="a")["properties"] == {"body": "red apple", "colour": "red"}
    assert ok(db, command="query", query="? fruit(X).") == [{"X": "a"}] and len(ok(db, command="node_versions", id="a")) == 2
    assert ok(db, command="list_index_profiles") == [{"name": "p", "version": 1, "active": True}]
    assert db.handle({"command": "query", "query": "? set_node_property(X, colour, 1)."})["type"] == "error"


def test_code_is_shipped_through_the_shared_folder(spark, monkeypatch):
    sent = []
    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.setattr(shared, "_shipped", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, p: sent.append(p))
    shared.ship(spark)
    shared.ship(spark)
    (uri,) = sent
    rows = spark.read.format("binaryFile").load(uri).select("length").collect()
    assert uri.endswith(".zip") and rows[0]["length"] > 10_000


def test_as_of_join_over_many_buckets(spark):
    import random

    r = random.Random(1)
    at = lambda: r.randrange(0, 40 * 86_400, 3600)
    versions = [(r.choice(["a", "b", None]), at(), i) for i in range(60)]
    probes = [(r.choice(["a", "b", "c", None]), at(), i) for i in range(80)]
    time = lambda df: df.withColumn("t", F.timestamp_seconds("t"))
    v = time(spark.createDataFrame(versions, "k string, t long, v long")).withColumnRenamed("t", "valid_from")
    p = time(spark.createDataFrame(probes, "k string, t long, p long")).withColumnRenamed("t", "at")
    got = {x["p"]: x["valid_from"] and x["valid_from"].timestamp() for x in temporal.as_of(v, p, "k", bucket_seconds=86_400).collect()}
    for k, t, i in probes:
        best = max((s for q, s, _ in versions if q == k and s <= t), default=None)
        assert (None if got[i] is None else int(got[i])) == best


def test_fnv1a():
    from hornbeam.functions.scalars import fnv1a

    assert fnv1a(b"") == 0xCBF29CE484222325 and fnv1a(b"a") == 0xAF63DC4C8601EC8C and fnv1a(b"foobar") == 0x85944171F73967E8
