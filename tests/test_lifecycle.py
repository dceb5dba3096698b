import json
import threading
import urllib.request
from io import StringIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornbeam import bulk, server
from hornbeam.facade import Config, Database
from hornbeam.operators import ann, embedding, history, mutate, prepared, retrieval, text
from hornbeam.operators.graph_store import GraphStore
from hornbeam.operators.lifecycle import Profile, Profiles
from hornbeam.operators.stored import KeyedTable, Log
from hornbeam.operators.text_index import TextIndex
from hornbeam.sources import graph_files
from hornbeam.streaming import coordinator, targets

NODE_ROWS = "id string, labels array<string>, properties map<string,string>"


def nodes_of(spark, *rows):
    return spark.createDataFrame([(i, labels, {k: json.dumps(v) for k, v in props.items()}) for i, labels, props in rows], NODE_ROWS)


def test_keyed_tables_follow_a_dictionary(spark, tmp_path):
    """Random commits, read back after each: the table holds what a dictionary would."""
    rng = np.random.default_rng(3)
    table, want = KeyedTable(spark, str(tmp_path / "t"), "k long, v long", ["k"]), {}
    for step in range(20):
        put = {int(k): step for k in rng.integers(0, 12, 4)}
        gone = [int(k) for k in rng.integers(0, 12, 2) if int(k) not in put]
        table.commit(spark.createDataFrame(list(put.items()), "k long, v long"), spark.createDataFrame([(k,) for k in gone], "k long"))
        for k in gone:
            want.pop(k, None)
        want |= put
        if step % 4 == 3:
            assert {r["k"]: r["v"] for r in KeyedTable(spark, str(tmp_path / "t"), "k long, v long", ["k"]).read().collect()} == want
    table.compact()
    table.vacuum()
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    with pytest.raises(ValueError):
        Log(spark, str(tmp_path / "t/log")).append(table.log.last()[0], {})


def test_stored_text_index_equals_a_new_one(spark, tmp_path):
    docs = {f"d{i}": " ".join(["alpha", "beta", "gamma", "delta", "epsilon"][j] for j in range(5) if (i >> j) & 1) for i in range(32)}
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=4)
    frame = lambda d: spark.createDataFrame(list(d.items()), "entity string, content string")
    index.put(frame(docs))
    change = {"d3": "beta beta beta", "d40": "alpha omega", "d7": ""}
    index.put(frame(change), frame({"d31": ""}).select(F.concat_ws("\x1f", "entity", F.lit("text"), F.lit("0")).alias("doc_id")))
    docs |= change
    del docs["d31"]
    for query in ("alpha beta", "omega", "nothing"):
        want = {r["doc_id"]: r["score"] for r in text.bm25(frame(docs).withColumnRenamed("entity", "doc_id").withColumnRenamed("content", "text"), query).collect()}
        got = {r["entity"]: r["score"] for r in index.search(query, by="entity").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert [r["entity"] for r in index.search("alpha", by="entity", entities=["d1", "d2"]).collect()] == ["d1"]
    one = spark.createDataFrame([("d1",), ("d5",)], "entity string")
    assert index.search_for_entities("alpha", one).count() == 2 and index.search("alpha", fields=["title"]).count() == 0
    with pytest.raises(ValueError):
        index.explain("alpha", weights={"text": 0.0})


def test_targets_follow_the_graph(spark, tmp_path):
    profiles = Profiles()
    profiles.put(Profile("p", 1, ("doc",), bm25={"body": 1.0}, vector={"body": "m"}, temporal={"at": "event", "a..b": "validity"}))
    profiles.activate("p", 1)
    g = mutate.create_nodes(mutate.Graph.empty(spark), nodes_of(spark, ("x", ["doc"], {"body": "red apple", "at": "2026-01-01T00:00:00Z", "a": "2026-01-01T00:00:00Z", "b": "2026-02-01T00:00:00Z"}), ("y", ["doc"], {"body": "green pear"}), ("z", ["other"], {"body": "red"})))
    now = {"g": g}
    nodes = lambda: now["g"].nodes
    made = {"bm25": targets.Bm25Target(spark, str(tmp_path / "b"), nodes, profiles, 4), "vector": targets.VectorTarget(spark, str(tmp_path / "v"), nodes, profiles, 16, lambda: 100), "temporal": targets.TemporalTarget(spark, str(tmp_path / "t"), nodes, profiles)}
    versions = lambda: nodes().select(F.lit("node").alias("entity_kind"), F.col("id").alias("entity_id"), "version")
    held = [coordinator.Target(k, t, versions=versions, state=Log(spark, str(tmp_path / f"state-{k}"))) for k, t in made.items()]

    def feed():
        for t in held:
            coordinator.run_batch(t, mutate.events_after(now["g"].outbox, t.published), t.last_batch + 1)

    feed()
    hits = lambda q: [r["entity"] for r in made["bm25"].index.search(q, by="entity").collect()]
    assert hits("red") == ["x"] and made["temporal"].events().count() == 1 and made["temporal"].validity().count() == 1
    assert {r["entity"]: r["state"] for r in made["vector"].jobs.read().collect()} == {"x": "pending", "y": "pending"}
    # Two changes of x in one batch and one of y: the older event of x is stale.
    now["g"] = mutate.patch_nodes(now["g"], spark.createDataFrame([("x", {"body": '"blue plum"'}, ["at"])], "id string, set map<string,string>, remove array<string>"))
    now["g"] = mutate.patch_nodes(now["g"], spark.createDataFrame([("x", {"n": "1"}, [])], "id string, set map<string,string>, remove array<string>"))
    now["g"] = mutate.delete_nodes(now["g"], spark.createDataFrame([("y",)], "id string"))
    feed()
    assert hits("red") == [] and hits("plum") == ["x"] and hits("pear") == [] and made["temporal"].events().count() == 0
    assert {r["entity"] for r in made["vector"].jobs.read().collect()} == {"x"} and all(t.stale == 1 for t in held)
    assert coordinator.wait(held, 1) == [] and coordinator.wait(held, 10**6, 20) == ["bm25", "vector", "temporal"]
    profiles.put(Profile("p", 2, ("other",), bm25={"body": 1.0}))
    profiles.activate("p", 2)
    for t in made.values():
        t.rebuild()
    assert hits("red") == ["z"] and hits("plum") == [] and made["vector"].jobs.read().count() == 0


def test_a_target_told_to_fail(spark):
    box = spark.createDataFrame([(1, "node", "a", 1, "upsert", ["k"])], mutate.OUTBOX)
    double = targets.RecordingTarget(failures=2)
    coordinator.run_batch(coordinator.Target("t", double, attempts=3), box, 0)
    assert double.calls == 3 and double.applied == [(0, 1, "a", "upsert")]
    with pytest.raises(coordinator.TargetFailed):
        coordinator.run_batch(coordinator.Target("t", targets.RecordingTarget(9), attempts=2), box, 0)


def test_embedding_worker(spark, tmp_path):
    profiles = Profiles()
    profiles.put(Profile("p", 1, ("doc",), vector={"body": "m"}))
    profiles.activate("p", 1)
    now = {"n": nodes_of(spark, ("x", ["doc"], {"body": "good text"}), ("y", ["doc"], {"body": "a bad one"}), ("z", ["doc"], {"body": "w" * 99})).withColumn("version", F.lit(1).cast("long"))}
    target = targets.VectorTarget(spark, str(tmp_path / "v"), lambda: now["n"], profiles, 16, lambda: 100)
    target.rebuild()

    class Moody:
        """A provider that fails for some texts."""

        def embed(self, texts):
            return [[float("nan")] * 16 if "bad" in t else v for t, v in zip(texts, embedding.HashingProvider(16).embed(texts))]

    model = embedding.ModelProfile("m", 1, 16, max_chars=50)
    assert embedding.run_worker(target, Moody(), model, 100) == {"completed": 1, "retry": 2}
    rows = {r["entity"]: r for r in target.jobs.read().collect()}
    assert rows["y"]["problem"] == "finite" and rows["z"]["problem"] == "length" and rows["y"]["not_before"] == 102
    (v,) = target.vectors.read().collect()
    assert v["entity"] == "x" and abs(sum(a * a for a in v["embedding"]) - 1) < 1e-5
    assert embedding.run_worker(target, Moody(), model, 101) == {}
    assert embedding.run_worker(target, Moody(), model, 200, max_attempts=2) == {"dead": 2}
    # A job whose text has changed since is stale.
    now["n"] = nodes_of(spark, ("x", ["doc"], {"body": "newer text"})).withColumn("version", F.lit(2).cast("long"))
    target.rebuild()
    now["n"] = nodes_of(spark, ("x", ["doc"], {"body": "newest text"})).withColumn("version", F.lit(3).cast("long"))
    assert embedding.run_worker(target, Moody(), model, 300) == {"stale": 1} and target.vectors.read().count() == 0
    with pytest.raises(ValueError):
        embedding.ModelProfile("m", 1, 0)
    with pytest.raises(ValueError):
        held = embedding.ModelProfiles()
        held.put(model)
        held.put(embedding.ModelProfile("m", 1, 8))


def test_providers_over_http():
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "input" in body:
                answer = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))][: 1 if body["model"] == "short" else None]}
            else:
                answer = [[float(len(body["inputs"]))]]
            data = json.dumps(answer).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_port}"
    assert embedding.BatchProvider(url, "m").embed(["a", "bbb"]) == [[1.0], [3.0]] == embedding.SingleProvider(url).embed(["a", "bbb"])
    with pytest.raises(ValueError):
        embedding.BatchProvider(url, "short").embed(["a", "bbb"])
    http.shutdown()


def test_cells_find_what_the_exact_search_finds(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.5 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    index = ann.CellIndex(spark, str(tmp_path / "ix"))
    first = index.publish(vectors, cells=32)
    assert index.publish(vectors, cells=32) == first and index.log.numbers() == [1]
    index.check()
    queries = vectors.filter("id % 100 = 0").withColumnRenamed("id", "query")
    exact = ann.search_exact(spark, vectors, queries, 10, block=7).cache()
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 700):
        want = sorted(range(2000), key=lambda i: (-(x[q] @ x[i]), i))[:10]
        assert [r["doc_id"] for r in exact.filter(F.col("query") == q).orderBy("rank").collect()] == want
    found = index.search_all(queries, 10, probes=8)
    assert found.count() == 200 and ann.recall(found, exact) >= 0.9
    assert index.search(rows[5][1], 1).first()["doc_id"] == 5
    assert index.status(vectors)["stale"] is False and index.status(vectors.limit(10))["stale"] is True
    with pytest.raises(ValueError):
        index.publish(vectors.union(spark.createDataFrame([(1, [1.0])], vectors.schema)))
    with pytest.raises(ValueError):
        index.search([0.0] * 16)


def test_text_index_splits_its_buckets(spark, tmp_path, monkeypatch):
    """A bucket is written by more tasks the more text there is; a document that comes twice, one without words and none are counted as before."""
    from hornbeam.operators import text_index

    monkeypatch.setattr(text_index, "TASK_CHARS", 40)
    rows = [(str(i), "the hash " * (1 + i % 3) + f"w{i}") for i in range(60)] + [("5", "the hash the hash the hash w5"), ("60", ""), ("61", None)]
    index = TextIndex(spark, str(tmp_path / "ix"), 2)
    index.put(spark.createDataFrame(rows, "entity string, content string"))
    assert len(list((tmp_path / "ix" / "postings").rglob("*.parquet"))) > 8
    want = {}
    for e, c in rows:
        for w in (c or "").split():
            want[e, w] = want.get((e, w), 0) + 1
    assert {(r["entity"], r["term"]): r["tf"] for r in index.postings.read().collect()} == want
    assert index.stats()[0] == 63
    index.postings.compact()
    assert index.postings.read().count() == len(want) and index.postings.log.last()[1]["slices"] > 1


def test_cells_find_enough_where_few_probes_do_not(spark, tmp_path):
    """Vectors without clusters, as at 0.1 GB of the registered query: ten of sixteen cells aren't enough."""
    x = np.random.default_rng(3).normal(size=(6000, 64))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>").repartition(3).cache()
    index = ann.CellIndex(spark, str(tmp_path / "ix"))
    assert 10 < index.publish(vectors, cells=16)["probes"] <= 16
    queries = vectors.filter("id % 20 = 0").withColumnRenamed("id", "query")
    exact = ann.search_exact(spark, vectors, queries, 10).cache()
    found = index.search_all(queries, 10, probes=10)
    assert found.count() == 3000 and ann.recall(found, exact) >= 0.9


def test_cell_search_of_many_queries_multiplies_blocks(spark, tmp_path, monkeypatch):
    """No row a pair of query and vector; blocks of queries and slices of cells give what one of each gives, ties by id."""
    x = np.random.default_rng(4).normal(size=(300, 8))
    x[100:200] = x[:100]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>")
    queries = vectors.filter("id % 10 = 0").withColumnRenamed("id", "query")
    rows = lambda df: sorted((r["query"], r["rank"], r["doc_id"]) for r in df.collect())
    one = ann.CellIndex(spark, str(tmp_path / "one"))
    one.publish(vectors, cells=4)
    found = one.search_all(queries, 5, probes=4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "CELL_FILE", 20)
    many = ann.CellIndex(spark, str(tmp_path / "many"))
    many.publish(vectors, cells=4)
    assert rows(many.search_all(queries, 5, probes=4)) == rows(found) == rows(ann.search_exact(spark, vectors, queries, 5))


def test_versions_and_as_of(spark):
    h, g = spark.createDataFrame([], history.HISTORY), mutate.Graph.empty(spark)
    steps = [
        (lambda g: mutate.create_nodes(g, nodes_of(spark, ("a", ["x"], {"k": 1}), ("b", ["x"], {}))), "2026-01-01"),
        (lambda g: mutate.update_nodes(g, spark.createDataFrame([("a", {"m": "2"})], "id string, properties map<string,string>")), "2026-02-01"),
        (lambda g: mutate.delete_nodes(g, spark.createDataFrame([("a",)], "id string")), "2026-03-01"),
        (lambda g: mutate.create_nodes(g, nodes_of(spark, ("a", ["y"], {}))), "2026-04-01"),
    ]
    for step, at in steps:
        after = step(g)
        h, g = history.recorded(h, g, after, F.lit(at).cast("timestamp")), after
    then = lambda at: {r["id"]: (r["properties"], r["version"]) for r in history.nodes_at(h, F.lit(at).cast("timestamp")).collect()}
    assert then("2025-12-31") == {} and then("2026-01-15") == {"a": ({"k": "1"}, 1), "b": ({}, 1)}
    assert then("2026-02-01")["a"] == ({"m": "2"}, 2) and "a" not in then("2026-03-02") and then("2026-05-01")["a"] == ({}, 1)
    rows = history.node_versions(h, "a").collect()
    assert [(r["version"], r["valid_to"] and r["valid_to"].month) for r in rows] == [(1, 2), (2, 3), (1, None)]
    with pytest.raises(ValueError):
        mutate.update_nodes(g, spark.createDataFrame([("none", {})], "id string, properties map<string,string>"))


def test_entities_edges_and_prefixes(spark):
    g = mutate.create_nodes(mutate.Graph.empty(spark), nodes_of(spark, ("a", ["x"], {}), ("b", ["x"], {}), ("e", ["x"], {})))
    g = mutate.create_edges(g, spark.createDataFrame([("e", "t", "a", "b", {}), ("f", "t", "a", "b", {"w": "1"})], "id string, edge_type string, source string, target string, properties map<string,string>"))
    g = mutate.patch_entity(g, "f", {"w": "2"}, [])
    edge = g.edges.filter("id = 'f'").first()
    assert edge["properties"] == {"w": "2"} and edge["version"] == 2
    last = g.outbox.orderBy(F.col("sequence").desc()).first()
    assert (last["entity_kind"], last["entity_id"], last["source_version"], last["changed"]) == ("edge", "f", 2, ["w"])
    assert mutate.entity_kind(g, "a") == "node"
    with pytest.raises(ValueError, match="ambiguous"):
        mutate.patch_entity(g, "e", {}, ["w"])
    with pytest.raises(KeyError, match="missing"):
        mutate.patch_entity(g, "none", {}, ["w"])
    with pytest.raises(ValueError, match="twice"):
        mutate.patch_nodes(g, spark.createDataFrame([("a", {"k": "1"}, []), ("a", {"k": "2"}, [])], "id string, set map<string,string>, remove array<string>"))
    assert [r["sequence"] for r in mutate.events_after(g.outbox, 3, 2).collect()] == [4, 5]
    assert [r["id"] for r in mutate.with_prefix(g.edges, "f").collect()] == ["f"]
    g = mutate.create_memories(g, spark.createDataFrame([("m1", "note", 'say "hi"', "2026-01-01T00:00:00Z"), ("m2", "plan", "x", "2026-03-01T00:00:00Z")], "id string, memory_type string, content string, created_at string"))
    assert [r["id"] for r in mutate.memories(g.nodes, "note").collect()] == ["m1"]
    assert [r["id"] for r in mutate.memories(mutate.expire_memories(g, "2026-02-01T00:00:00Z").nodes).collect()] == ["m2"]


def test_json_round_trip(spark, tmp_path):
    nodes = nodes_of(spark, ("a\"b", ["x", "y"], {"s": 'q"uo\\te', "n": 1.5, "l": [1, "two", None], "o": {"k": True}}), ("c", [], {}))
    edges = spark.createDataFrame([("e", "t", "c", "c", {"w": "1"}, 3)], mutate.EDGES)
    graph_files.write_graph_json(nodes, edges, str(tmp_path / "g"))
    back = graph_files.read_graph_json(spark, str(tmp_path / "g"))
    load = lambda df: sorted((r["id"], {k: json.loads(v) for k, v in r["properties"].items()}) for r in df.collect())
    assert load(back[0]) == load(nodes) and load(back[1]) == load(edges) and back[1].first()["edge_type"] == "t"


def test_fact_files_are_split_and_packs_resume(spark, tmp_path):
    facts = "".join(f"node(n{i}, [taxon, 'odd one'], {{size: {i}, names: [{{text: \"T{i}.\", n: [1, 2.5]}}], \"is it\": true}}).\nlink(n{i}, n{i + 1}).\n" for i in range(300))
    (tmp_path / "a.pl").write_text(facts + "% the end.\n")
    (tmp_path / "b.pl").write_text('says(n1, "a line.\nanother line.\n").\nlink(n1, n5, {w: 2}).\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        read = graph_files.read_facts(spark, [str(tmp_path / "a.pl"), str(tmp_path / "b.pl")]).cache()
        assert read.count() == 602
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    row = read.filter("name = 'node' and a = 'n7'").first()
    assert json.loads(row["b"]) == ["taxon", "odd one"] and {k: json.loads(v) for k, v in row["properties"].items()} == {"size": 7, "names": [{"text": "T7.", "n": [1, 2.5]}], "is it": True}
    assert read.filter("name = 'says'").first()["b"] == "a line.\nanother line.\n" and read.filter("properties['w'] = '2'").first()["b"] == "n5"
    graph_files.write_facts(read, str(tmp_path / "out"))
    again = graph_files.read_facts(spark, str(tmp_path / "out"))
    key = lambda df: sorted((r["name"], r["a"], r["b"] or "", sorted((r["properties"] or {}).items())) for r in df.collect())
    assert key(again) == key(read)

    bulk.main(["compile", str(tmp_path / "pack"), str(tmp_path / "a.pl")], spark)
    calls = []

    def flaky(part):
        calls.append(part.count())
        if len(calls) == 5:
            raise RuntimeError("lost")

    session = graph_files.BulkSession(spark, str(tmp_path / "session"))
    with pytest.raises(RuntimeError):
        graph_files.load_pack(spark, str(tmp_path / "pack"), session, flaky)
    assert session.state["checkpoint"] == 4 and session.state["state"] == "writing"
    assert graph_files.load_pack(spark, str(tmp_path / "pack"), session, flaky) == 12 and sum(calls[:4] + calls[5:]) == 600
    assert graph_files.load_pack(spark, str(tmp_path / "pack"), session, flaky) == 0 and session.state["state"] == "complete"
    with pytest.raises(ValueError):
        session.checkpoint(1)
    spark.createDataFrame([("node", "zz", "[]", {}, 7, 0)], "name string, a string, b string, properties map<string,string>, record_sum long, part int").write.partitionBy("part").mode("append").parquet(str(tmp_path / "pack/facts"))
    with pytest.raises(ValueError, match="checksum"):
        graph_files.read_pack(spark, str(tmp_path / "pack"))


def test_bulk_load_into_a_stored_graph(spark, tmp_path):
    (tmp_path / "f.pl").write_text("node(a, [x], {k: 1}).\nknows(a, b).\nnode(c).\n")
    graph_files.write_pack(graph_files.read_facts(spark, str(tmp_path / "f.pl")), str(tmp_path / "pack"), parts=2)
    assert bulk.main(["load", str(tmp_path / "db"), str(tmp_path / "pack")], spark) == {"parts": 2, "nodes": 3, "edges": 1}
    assert bulk.main(["load", str(tmp_path / "db"), str(tmp_path / "pack")], spark)["parts"] == 0
    store = GraphStore(spark, str(tmp_path / "db"))
    assert {r["id"]: (r["labels"], r["properties"]) for r in store.nodes.read().collect()} == {"a": (["x"], {"k": "1"}), "b": ([], {}), "c": ([], {})}
    kinds = [(r["entity_kind"], r["entity_id"]) for r in store.outbox.read().orderBy("sequence").collect()]
    assert kinds[-1] == ("projection", "rebuild_required") and len(kinds) == 5
    store.put_raw("config", [("a1", "x"), ("a2", "y"), ("b", "z")])
    store.put_raw("config", [("a1", None)])
    assert store.get_raw("config", "a1") is None and [tuple(r) for r in store.scan_prefix("config", "a").collect()] == [("a2", "y")]
    assert store.history.read().count() == 3


def test_taxonomy_and_wiki(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("".join("\t|\t".join(r) + "\t|\n" for r in [["1", "1", "no rank", "", "8", "0", "1", "0", "0", "0", "0", "0"], ["2", "1", "species", "", "0", "0", "11", "0", "0", "0", "1", "0"]]))
    (tmp_path / "names.dmp").write_text("2\t|\tHomo\t|\t\t|\tscientific name\t|\n2\t|\tMan \"x\"\t|\tman\t|\tcommon name\t|\n")
    (tmp_path / "merged.dmp").write_text("9\t|\t2\t|\n")
    (tmp_path / "delnodes.dmp").write_text("7\t|\n8\t|\n")
    facts = graph_files.taxonomy_facts(spark, str(tmp_path))
    rows = {(r["name"], r["a"]): r for r in facts.collect()}
    two = {k: json.loads(v) for k, v in rows["node", "tax_2"]["properties"].items()}
    assert two["scientific_name"] == "Homo" and two["genetic_code_id"] == 11 and [n["text"] for n in two["names"]] == ["Homo", 'Man "x"']
    assert rows["merged_into", "tax_9"]["b"] == "tax_2" and json.loads(rows["node", "tax_8"]["b"]) == ["deleted_taxon"] and rows["taxonomy_parent", "tax_2"]["b"] == "tax_1"
    assert mutate.upsert_facts(mutate.Graph.empty(spark), facts).nodes.count() == 5
    (tmp_path / "w" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "w" / "top.md").write_text("# hi\nthere")
    (tmp_path / "w" / "deep" / "er" / "a b+c.md").write_text("x" * 5000)
    wiki = {r["id"]: r for r in graph_files.read_wiki(spark, str(tmp_path / "w")).collect()}
    assert wiki["wiki:top.md"]["labels"] == ["article"] and wiki["wiki:deep/er/a b+c.md"]["labels"] == ["article", "deep", "er"]
    assert json.loads(wiki["wiki:deep/er/a b+c.md"]["properties"]["title"]) == "a b+c" and len(json.loads(wiki["wiki:deep/er/a b+c.md"]["properties"]["content"])) == 5000


def test_prepared_retrieval(spark, tmp_path):
    docs = spark.createDataFrame([("a", "engineering"), ("b", "engineering team"), ("c", "apple")], "id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    calls = []

    class Provider:
        def embed(self, texts):
            calls.append(texts)
            return [[1.0, 0.1] for _ in texts]

    r = prepared.Retriever(spark, docs, vectors, provider=Provider(), wait=lambda least, ms: ["bm25"] if least > 5 else [], watermark=lambda: 5)
    p = r.prepare(prepared.Request("hybrid", "engineering"))
    for _ in range(2):
        rows = {x["doc_id"]: x["details"] for x in r.retrieve(p.handle).collect()}
    assert len(calls) == 1 and rows["a"]["fused_rank"] == 1 and rows["c"]["bm25"] is None and rows["b"]["bm25"]["rank"] == 2 and rows["a"]["vector"]["watermark"] == 5
    assert rows["a"]["mode"] == "hybrid" and rows["a"]["exact"] is True
    only = r.retrieve(p.handle, graph=spark.createDataFrame([("b",)], "doc_id string")).collect()
    assert [x["doc_id"] for x in only] == ["b"] and only[0]["details"]["exhausted"] is True
    near = r.prepare(prepared.Request("vector", source="b", budget=retrieval.Budget(top_k=2, candidate_k=2)))
    assert [x["doc_id"] for x in r.retrieve(near.handle).collect()] == ["b", "a"] and len(calls) == 1
    assert r.tabled(p.handle) is r.tabled(p.handle)
    with pytest.raises(TimeoutError):
        r.prepare(prepared.Request("lexical", "x", least_sequence=9))
    for bad in ({"mode": "odd"}, {"mode": "lexical"}, {"mode": "vector"}, {"mode": "vector", "vector": (1.0,), "source": "a"}):
        with pytest.raises(ValueError):
            prepared.Request(**bad)
    with pytest.raises(KeyError):
        r.retrieve("none")
    with pytest.raises(ValueError):
        prepared.Retriever(spark, docs, vectors, strategy="disabled").prepare(prepared.Request("vector", "x"))
    from hornbeam.plans.catalog import Catalog
    from hornbeam.plans.engine import Engine
    from hornbeam.plans.indexes import attach

    engine = attach(Engine(spark, Catalog(spark)), retriever=r)
    found = engine.query(f"? retrieve({p.handle}, {{}}, E, D).").collect()
    assert {x["E"] for x in found} == {"a", "b", "c"} and json.loads(found[0]["D"])["mode"] == "hybrid"


def test_database_with_indexes(spark):
    db = Database(spark, Config(embedding=True, dimension=32))

    def ok(**request):
        answer = db.handle(request)
        assert answer["type"] == "success", answer
        return answer["data"]

    ok(command="add_node", id="a", labels=["doc"], properties={"body": "red apple tree"})
    ok(command="put_index_profile", name="p", version=1, labels=["doc"], bm25={"body": 2.0}, vector={"body": "m"})
    ok(command="activate_index_profile", name="p", version=1)
    ok(command="add_node", id="b", labels=["doc"], properties={"body": "green apple"})
    assert ok(command="wait_indexes") == [], ok(command="index_status")["targets"]
    assert [h["entity"] for h in ok(command="search", query="apple")] == ["b", "a"]
    assert ok(command="run_embedding_worker") == {"completed": 2} and ok(command="embedding_jobs") == {"completed": 2}
    handle = ok(command="prepare_retrieval", mode="hybrid", text="apple tree")
    rows = ok(command="retrieve", handle=handle)
    assert rows[0]["doc_id"] == "a" and rows[0]["details"]["vector"]["rank"] == 1
    assert {r["E"] for r in ok(command="query", query=f"? retrieve({handle}, {{}}, E, _).")} == {"a", "b"}
    status = ok(command="rebuild_vector_index", cells=2)
    assert status["strategy"] == "cells" and status["vectors"] == 2 and status["stale"] is False
    ok(command="update_node", id="a", properties={"body": "yellow"})
    assert [h["entity"] for h in ok(command="search", query="apple")] == ["b"] and len(ok(command="node_versions", id="a")) == 2
    assert ok(command="embedding_jobs") == {"completed": 1, "pending": 1}
    ok(command="set_entity_property", id="a", key="k", value=[1])
    assert db.handle({"command": "set_entity_property", "id": "zz", "key": "k", "value": 1})["code"] == "KeyError"
    assert ok(command="generation_action", action="create") == 1 and ok(command="generation_action", action="build", generation=1) == "building"
    assert len(ok(command="mutation_events", after=2)) == 2 and ok(command="node_at", id="a", at="2020-01-01") is None

    http = server.make_server(db)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    post = lambda path, body: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", json.dumps(body).encode()), timeout=120).read().decode()
    assert json.loads(post("/command", {"command": "get_node", "id": "b"}))["data"]["properties"]["body"] == "green apple"
    events = post("/stream", {"query": "? doc(X)."})
    assert events.startswith("event: started") and events.count("event: chunk") == 2 and events.rstrip().endswith('data: {"answers": 2}')
    assert "event: error" in post("/stream", {"query": "? ("})
    with pytest.raises(urllib.error.HTTPError):
        post("/command", {"command": "none"})
    http.shutdown()
    out = StringIO()
    server.serve_lines(db, StringIO('{"command": "get_node", "id": "b"}\nnonsense\n'), out)
    assert [json.loads(x)["type"] for x in out.getvalue().splitlines()] == ["success", "error"]
    out = StringIO()
    server.repl(db, StringIO("fruit(X) :- doc(X).\n? fruit(X).\n.get_node {\"id\": \"b\"}\n.quit\n"), out)
    assert "2 answers" in out.getvalue() and "green apple" in out.getvalue()
