"""Registered queries of what is stored or batched: indexes, versions, files, mutations, all-query searches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .catalogue import _BM25, _RRF, _Q, ORACLES, _graph, _id, events, query, table
from .operators import ann, history, mutate, retrieval
from .operators.prepared import Request, Retriever
from .operators.text_index import TextIndex
from .shared import new_folder, stage_table
from .sources import graph_files
from .streaming import coordinator, targets

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES["chunk_paragraph"] = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), o AS (
  SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY i) - octet_length(encode(line)) - 1 AS at_, trim(line, {_WS}) AS body FROM l
), p AS (
  SELECT *, lag(body) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM o
), g AS (
  SELECT *, sum(CASE WHEN starts_with(body, '#') OR prior IS NULL OR prior = '' OR starts_with(prior, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p WHERE body <> ''
), c AS (
  SELECT doc_id, g, min(at_) AS at_, string_agg(line, chr(10) ORDER BY i) AS raw FROM g GROUP BY doc_id, g
)
SELECT doc_id, CAST(g - 1 AS INTEGER) AS ordinal, CAST(at_ + octet_length(encode(raw)) - octet_length(encode(ltrim(raw, {_WS}))) AS INTEGER) AS start,
       CAST(at_ + octet_length(encode(rtrim(raw, {_WS}))) AS INTEGER) AS "end", sha256(trim(raw, {_WS})) AS fingerprint
FROM c
"""

ORACLES["chunk_window"] = r"""
WITH p AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+|[^\x00-\x7F]|[\x00-\x7F]')) AS piece, generate_subscripts(regexp_extract_all(text, '[0-9A-Za-z_]+|[^\x00-\x7F]|[\x00-\x7F]'), 1) AS i FROM documents WHERE text IS NOT NULL
), o AS (
  SELECT *, sum(octet_length(encode(piece))) OVER w AS b, sum(length(piece)) OVER w AS c FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM o WHERE regexp_full_match(piece, '[0-9A-Za-z_]+|[^\x00-\x7F]')
), first AS (
  SELECT doc_id, k // 80 AS w, b - octet_length(encode(piece)) AS start, c - length(piece) AS from_, n FROM t WHERE k % 80 = 0 AND (k = 0 OR k + 20 < n)
), last AS (
  SELECT f.doc_id, f.w, t.b AS "end", t.c AS to_ FROM first f JOIN t ON t.doc_id = f.doc_id AND t.k = least(f.w * 80 + 100, f.n) - 1
)
SELECT f.doc_id, CAST(f.w AS INTEGER) AS ordinal, CAST(f.start AS INTEGER) AS start, CAST(l."end" AS INTEGER) AS "end", sha256(substring(d.text, CAST(f.from_ + 1 AS BIGINT), CAST(l.to_ - f.from_ AS BIGINT))) AS fingerprint
FROM first f JOIN last l USING (doc_id, w) JOIN documents d ON d.doc_id = f.doc_id
"""


# -- a stored index
_CHANGED = _BM25.replace("FROM documents)", "FROM (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'hash the ' || source ELSE text END AS text FROM documents WHERE lang <> 'fr'))")


@query("stored_bm25_after_changes", _CHANGED + " SELECT CAST(doc_id AS VARCHAR) AS entity, round(sum(score), 6) AS score FROM x GROUP BY doc_id")
def stored_bm25_after_changes(spark, sf):
    """All documents are put; then those in German get another text and those in French go."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entity"), F.col("text").alias("content"), F.col("lang").alias("language"), "source")
    index = TextIndex(spark, new_folder(spark, "text_index"), 16)
    index.put(docs.drop("source"))
    gone = docs.filter("language = 'fr'").select(F.concat_ws("\x1f", "entity", F.lit("text"), F.lit("0")).alias("doc_id"))
    index.put(docs.filter("language = 'de'").withColumn("content", F.concat(F.lit("hash the "), "source")).drop("source"), gone)
    return index.search("the hash pathetic", by="entity").select("entity", F.round("score", 6).alias("score"))


_indexes: dict[tuple[str, str], TextIndex] = {}


def stored_index(spark, sf) -> TextIndex:
    """The index of all documents, made once an application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = TextIndex(spark, new_folder(spark, "text_index"), 16)
        _indexes[key].put(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entity"), F.col("text").alias("content"), F.col("lang").alias("language")))
    return _indexes[key]


@query("stored_bm25_topk", _BM25 + " SELECT CAST(doc_id AS VARCHAR) AS entity, round(sum(score), 6) AS score FROM x GROUP BY doc_id ORDER BY round(sum(score), 9) DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def stored_bm25_topk(spark, sf):
    return stored_index(spark, sf).search("the hash pathetic", 20, "entity").select("entity", F.round("score", 6).alias("score"))


@query("stored_bm25_filtered", _BM25 + " SELECT CAST(doc_id AS VARCHAR) AS entity, round(3 * sum(score), 6) AS score FROM x WHERE lang IN ('de', 'es') GROUP BY doc_id")
def stored_bm25_filtered(spark, sf):
    return stored_index(spark, sf).search("the hash pathetic", None, "entity", languages=["de", "es"], weights={"text": 3.0}).select("entity", F.round("score", 6).alias("score"))


# -- searches with many queries
_PAIR = "list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _queries(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors, vectors.filter("id % 100 = 0").withColumnRenamed("id", "query")


@query("vector_topk_all", f"SELECT query, doc_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query, v.vec_id AS doc_id, {_PAIR} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_PAIR} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10")
def vector_topk_all(spark, sf):
    """The stated query set, every row whose id is divisible by 100, against all rows."""
    vectors, queries = _queries(spark, sf)
    return ann.search_exact(spark, vectors, queries, 10).select("query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("cells_topk_all", None)
def cells_topk_all(spark, sf):
    """The same queries over a published cell index; approximate, so compared by recall."""
    vectors, queries = _queries(spark, sf)
    index = ann.CellIndex(spark, new_folder(spark, "cells"))
    index.publish(vectors, cells=16)
    return index.search_all(queries, 10, probes=10)


@query("cells_recall", "SELECT true AS enough, count(*) * 10 AS asked FROM embeddings WHERE vec_id % 100 = 0")
def cells_recall(spark, sf):
    exact, found = vector_topk_all(spark, sf), cells_topk_all(spark, sf)
    hit = exact.join(found.select("query", "doc_id", F.lit(1).alias("hit")), ["query", "doc_id"], "left")
    return hit.agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"), F.count("*").alias("asked"))


_RRF_TEXT = _RRF.replace("DESC, doc_id) AS r", "DESC, CAST(doc_id AS VARCHAR)) AS r").replace("DESC, vec_id) AS r", "DESC, CAST(vec_id AS VARCHAR)) AS r")


@query("prepared_hybrid", _RRF_TEXT + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lr, 0) AS bm25_rank, coalesce(vr, 0) AS vector_rank FROM f WHERE doc_id NOT IN (SELECT doc_id FROM f ORDER BY round(s, 12) DESC, CAST(doc_id AS VARCHAR) OFFSET 10)")
def prepared_hybrid(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    r = Retriever(spark, docs, vectors)
    p = r.prepare(Request("hybrid", "the hash pathetic", tuple(_Q), budget=retrieval.Budget(10, 100)))
    rank = lambda n: F.coalesce(F.col(f"details.{n}.rank"), F.lit(0)).cast("long").alias(f"{n}_rank")
    return r.retrieve(p.handle).select("doc_id", rank("bm25"), rank("vector"))


# -- versions
def _history(spark, sf):
    """Each event of a user is a version of it, in the order of time, then id."""
    version = F.row_number().over(W.partitionBy("user_id").orderBy("at", "id")).cast("long")
    return events(spark, sf).select(F.col("user_id").cast("string").alias("id"), version.alias("version"), F.array(F.lit("user")).alias("labels"), F.create_map(F.lit("last"), F.col("event_type")).alias("properties"), F.col("at").alias("valid_from"), (F.col("event_type") == "error").alias("gone"))


_VERSIONS = "SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type, ts FROM events"


@query("node_versions", f"SELECT id, version, event_type AS last, coalesce(strftime(valid_to, '%Y-%m-%d %H:%M:%S'), '-') AS valid_to FROM (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts, version) AS valid_to FROM ({_VERSIONS})) WHERE event_type <> 'error'")
def node_versions(spark, sf):
    out = history.node_versions(_history(spark, sf))
    return out.select("id", "version", F.col("properties")["last"].alias("last"), F.coalesce(F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("valid_to"))


@query("nodes_as_of", f"SELECT id, version, event_type AS last FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, version DESC) AS k FROM ({_VERSIONS}) WHERE ts <= TIMESTAMP '2024-01-05') WHERE k = 1 AND event_type <> 'error'")
def nodes_as_of(spark, sf):
    return history.nodes_at(_history(spark, sf), F.lit("2024-01-05").cast("timestamp")).select("id", "version", F.col("properties")["last"].alias("last"))


# -- mutations
@query("update_nodes", "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN c_nationkey END AS nation, CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS old_keys, CASE WHEN c_acctbal < 0 THEN 2::BIGINT ELSE 1 END AS version FROM customer")
def update_nodes(spark, sf):
    rows = table(spark, sf, "customer").filter("c_acctbal < 0").select(_id("customer", "c_custkey").alias("id"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("properties"))
    g = mutate.update_nodes(_graph(spark, sf), rows)
    return g.nodes.filter(F.array_contains("labels", "customer")).select("id", F.col("properties")["nation"].cast("int").alias("nation"), F.map_contains_key("properties", "segment").cast("int").alias("old_keys"), "version")


@query("relabel", "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debtor' WHEN c_acctbal > 9000 THEN 'customer,rich' ELSE 'customer' END AS labels FROM customer")
def relabel(spark, sf):
    empty = F.array().cast("array<string>")
    c = table(spark, sf, "customer").select(_id("customer", "c_custkey").alias("id"), "c_acctbal")
    poor = c.filter("c_acctbal < 0").select("id", F.array(F.lit("debtor")).alias("add"), F.array(F.lit("customer")).alias("remove"))
    rich = c.filter("c_acctbal > 9000").select("id", F.array(F.lit("rich"), F.lit("customer")).alias("add"), empty.alias("remove"))
    g = mutate.relabel(_graph(spark, sf), poor.unionByName(rich))
    return g.nodes.filter(F.col("id").startswith("customer:")).select("id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query("patch_edges", "SELECT 'placed:' || o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '\"done\"' END AS state, CASE WHEN o_orderstatus = 'F' THEN 2::BIGINT ELSE 1 END AS version FROM orders")
def patch_edges(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("placed:"), F.col("o_orderkey").cast("string")).alias("id"), F.create_map(F.lit("state"), F.lit('"done"')).alias("set"), F.array().cast("array<string>").alias("remove"))
    return mutate.patch_edges(_graph(spark, sf), done).edges.select("id", F.col("properties")["state"].alias("state"), "version")


@query("outbox_tail", "SELECT k + 11 AS sequence FROM range(least(50, (SELECT count(*) FROM customer WHERE c_acctbal < 0) - 10)) t(k)")
def outbox_tail(spark, sf):
    """What follows sequence 10 in the outbox that an update of many nodes leaves, numbered without gaps: the first 50 events."""
    rows = table(spark, sf, "customer").filter("c_acctbal < 0").select(_id("customer", "c_custkey").alias("id"), F.create_map().cast("map<string,string>").alias("properties"))
    return mutate.events_after(mutate.update_nodes(_graph(spark, sf), rows).outbox, 10, 50).select("sequence")


@query("prefix_scan", "SELECT 'placed:' || o_orderkey AS id FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '12')")
def prefix_scan(spark, sf):
    return mutate.with_prefix(_graph(spark, sf).edges, "placed:12").select("id")


@query("edge_by_id", "SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target FROM orders WHERE o_orderkey = 7")
def edge_by_id(spark, sf):
    return _graph(spark, sf).edges.filter("id = 'placed:7'").select("source", "target")


@query("memory_expiry", "SELECT 'm' || event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type = 'signup'")
def memory_expiry(spark, sf):
    rows = events(spark, sf).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), F.col("event_type").alias("memory_type"), F.lit("x").alias("content"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    g = mutate.expire_memories(mutate.create_memories(mutate.Graph.empty(spark), rows), "2024-01-10T00:00:00Z")
    return mutate.memories(g.nodes, "signup").select("id")


# -- outbox to index
@query("outbox_to_index", _CHANGED + " SELECT CAST(doc_id AS VARCHAR) AS entity, round(sum(score), 6) AS score FROM x GROUP BY doc_id")
def outbox_to_index(spark, sf):
    """Documents become nodes, then change; a text target that is fed from the outbox ends where the changed corpus is."""
    from .operators.lifecycle import Profile, Profiles

    docs = table(spark, sf, "documents")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    ident = F.col("doc_id").cast("string").alias("id")
    nodes = docs.select(ident, F.array(F.lit("doc")).alias("labels"), F.create_map(F.lit("body"), quoted(F.col("text"))).alias("properties"))
    held = {"g": mutate.create_nodes(mutate.Graph.empty(spark), nodes)}
    keep = lambda g: mutate.Graph(*(stage_table(spark, getattr(g, t), t) for t in ("nodes", "edges", "outbox")))
    held["g"] = keep(held["g"])
    profiles = Profiles()
    profiles.put(Profile("all", 1, ("doc",), bm25={"body": 1.0}))
    profiles.activate("all", 1)
    apply = targets.Bm25Target(spark, new_folder(spark, "target"), lambda: held["g"].nodes, profiles, 16)
    versions = lambda: held["g"].nodes.select(F.lit("node").alias("entity_kind"), F.col("id").alias("entity_id"), "version")
    target = coordinator.Target("bm25", apply, versions=versions)
    coordinator.run_batch(target, mutate.events_after(held["g"].outbox, target.published), 0)
    patch = docs.filter("lang = 'de'").select(ident, F.create_map(F.lit("body"), quoted(F.concat(F.lit("hash the "), "source"))).alias("set"), F.array().cast("array<string>").alias("remove"))
    held["g"] = keep(mutate.delete_nodes(mutate.patch_nodes(held["g"], patch), docs.filter("lang = 'fr'").select(ident)))
    coordinator.run_batch(target, mutate.events_after(held["g"].outbox, target.published), 1)
    return apply.index.search("the hash pathetic", by="entity").select("entity", F.round("score", 6).alias("score"))


# -- files
@query("json_round_trip", "SELECT 'node' AS what, 'customer:' || c_custkey AS id, c_mktsegment AS value FROM customer UNION ALL SELECT 'node', 'order:' || o_orderkey, NULL FROM orders UNION ALL SELECT 'edge', 'placed:' || o_orderkey, 'customer:' || o_custkey FROM orders")
def json_round_trip(spark, sf):
    folder, g = new_folder(spark, "json"), _graph(spark, sf)
    graph_files.write_graph_json(g.nodes, g.edges, folder)
    nodes, edges = graph_files.read_graph_json(spark, folder)
    segment = F.get(F.from_json(F.concat(F.lit("["), F.col("properties")["segment"], F.lit("]")), "array<string>"), F.lit(0))
    return nodes.select(F.lit("node").alias("what"), "id", segment.alias("value")).unionByName(edges.select(F.lit("edge").alias("what"), "id", F.col("source").alias("value")))


def _facts(spark, sf):
    null = F.lit(None).cast("map<string,string>")
    c = table(spark, sf, "customer")
    nodes = c.select(F.lit("node").alias("name"), _id("customer", "c_custkey").alias("a"), F.lit('["customer"]').alias("b"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("name"), F.concat(F.lit('"'), "c_name", F.lit('"'))).alias("properties"))
    edges = table(spark, sf, "orders").select(F.lit("placed").alias("name"), _id("customer", "o_custkey").alias("a"), _id("order", "o_orderkey").alias("b"), null.alias("properties"))
    return nodes.unionByName(edges)


_FACT_ROWS = "SELECT 'node' AS name, 'customer:' || c_custkey AS a, '[\"customer\"]' AS b, CAST(c_nationkey AS VARCHAR) AS nation FROM customer UNION ALL SELECT 'placed', 'customer:' || o_custkey, 'order:' || o_orderkey, NULL FROM orders"


@query("fact_files", _FACT_ROWS)
def fact_files(spark, sf):
    folder = new_folder(spark, "facts")
    graph_files.write_facts(_facts(spark, sf), folder)
    return graph_files.read_facts(spark, folder).select("name", "a", "b", F.col("properties")["nation"].alias("nation"))


@query("pack_load", _FACT_ROWS)
def pack_load(spark, sf):
    """A pack is compiled, then loaded part by part into a folder."""
    pack, out = new_folder(spark, "pack"), new_folder(spark, "loaded")
    graph_files.write_pack(_facts(spark, sf), pack, parts=4)
    session = graph_files.BulkSession(spark, new_folder(spark, "session"))
    graph_files.load_pack(spark, pack, session, lambda facts: facts.write.parquet(f"{out}/{uuid.uuid4().hex}"))
    return spark.read.option("recursiveFileLookup", True).schema(graph_files.FACTS).parquet(out).select("name", "a", "b", F.col("properties")["nation"].alias("nation"))
