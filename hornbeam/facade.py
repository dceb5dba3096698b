"""One object for programs that speak in commands: graph, rules, indexes and searches behind ``handle(dict)``."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import history, mutate, retrieval, vector
from .operators.embedding import HashingProvider, ModelProfile, run_worker
from .operators.lifecycle import Generations, Profile, Profiles, job_metrics
from .operators.prepared import Request, Retriever
from .operators.graph_store import GraphStore
from .operators.stored import KeyedTable, Log
from .plans.catalog import Catalog
from .functions.scalars import TermError
from .plans.engine import Engine
from .plans.indexes import attach
from .plans.parser import Rule, parse_program
from .plans.terms import Atom, Col, Compound, ListTerm, Obj, Str, Var
from .shared import new_folder, stage_table
from .streaming import coordinator
from .streaming.targets import Bm25Target, TemporalTarget, VectorTarget


@dataclass(frozen=True)
class Config:
    """Settings from a JSON file in the folder, then one in the home folder, then HORNBEAM_* variables."""

    embedding: bool = False
    model: str = "bge_m3_dense_v1"
    dimension: int = 1024
    batch_size: int = 32
    top_k: int = 10

    @classmethod
    def load(cls, folder: str = ".") -> Config:
        out = cls()
        for p in (Path.home() / ".hornbeam.json", Path(folder) / "hornbeam.json"):
            if p.exists():
                out = replace(out, **{k: v for k, v in json.loads(p.read_text()).items() if k in {f.name for f in fields(cls)}})
        for f in fields(cls):
            if (v := os.environ.get(f"HORNBEAM_{f.name.upper()}")) is not None:
                out = replace(out, **{f.name: v.lower() in ("1", "true") if isinstance(f.default, bool) else type(f.default)(v)})
        return out


def _kind(value) -> tuple[str, str | None, float | None]:
    if isinstance(value, bool) or value is None:
        return "atom", {True: "true", False: "false", None: "null"}[value], None
    if isinstance(value, (int, float)):
        return ("int" if float(value).is_integer() else "float"), None, float(value)
    if isinstance(value, (list, dict)):
        return "atom", "array" if isinstance(value, list) else "object", None
    return "str", value, None


class Database:
    """A graph with rules. Every command returns {"type": "success", "data": ...} or {"type": "error", "code", "message"}."""

    def __init__(self, spark: SparkSession, config: Config | None = None, provider=None, path: str | None = None):
        """A database in memory, or, with ``path``, in a folder, where it is found again by the next one."""
        self.spark, self.config = spark, config or Config()
        self.store = GraphStore(spark, path) if path else None
        self.graph = self.store.read() if path else mutate.Graph.empty(spark)
        self.history = self.store.history.read() if path else spark.createDataFrame([], history.HISTORY)
        self.rules = (self.store.get_raw("rules", "program") or "") if path else ""
        log = (lambda name: Log(spark, f"{path}/{name}")) if path else (lambda name: None)
        self.profiles, self.generations = Profiles(self.config.embedding, log("profiles")), Generations(log("generations"))
        self.provider = provider or (HashingProvider(self.config.dimension) if self.config.embedding else None)
        self._engine: Engine | None = None
        self._vectors: KeyedTable | None = None
        self._retriever: Retriever | None = None
        self.targets: dict[str, coordinator.Target] = {}

    def handle(self, request: dict) -> dict:
        try:
            name = request.get("command", "")
            run = getattr(self, f"do_{name}", None)
            if run is None:
                raise ValueError(f"unknown command {name}")
            return {"type": "success", "data": run(**{k: v for k, v in request.items() if k not in ("command", "path") or name in ("import", "export")})}
        except (ValueError, KeyError, TypeError, TimeoutError) as error:
            return {"type": "error", "code": type(error).__name__, "message": str(error)}

    # -- graph

    def _put(self, graph: mutate.Graph) -> int:
        """Writes the new tables, which ends their lineage, feeds the indexes and returns the last sequence number."""
        before = self.graph
        if self.store is not None:
            self.store.write(graph)
            self.graph, self.history = self.store.read(), self.store.history.read()
            self._engine = None
            self._feed()
            return self._last()
        self.graph = mutate.Graph(*(stage_table(self.spark, getattr(graph, t), t) for t in ("nodes", "edges", "outbox")))
        self.history = stage_table(self.spark, history.recorded(self.history, before, self.graph, F.current_timestamp()), "history")
        self._engine = None
        self._feed()
        return self._last()

    def _last(self) -> int:
        return self.graph.outbox.agg(F.max("sequence").alias("m")).first()["m"] or 0

    def _versions(self):
        row = lambda kind, t: t.select(F.lit(kind).alias("entity_kind"), F.col("id").alias("entity_id"), "version")
        return row("node", self.graph.nodes).unionByName(row("edge", self.graph.edges))

    def _feed(self) -> None:
        """Gives every target the events it hasn't published; one that fails stays behind, and ``wait_indexes`` tells so."""
        for t in self.targets.values():
            try:
                coordinator.run_batch(t, mutate.events_after(self.graph.outbox, t.published), t.last_batch + 1)
            except coordinator.TargetFailed:
                continue

    def _json(self, properties: dict) -> dict[str, str]:
        return {k: json.dumps(v, ensure_ascii=False) for k, v in properties.items()}

    def _one(self, table, ident: str, what: str) -> dict:
        rows = table.filter(F.col("id") == ident).limit(1).collect()
        if not rows:
            raise KeyError(f"no {what} {ident}")
        return {k: {p: json.loads(x) for p, x in v.items()} if k == "properties" else v for k, v in rows[0].asDict().items()}

    def do_init(self) -> int:
        return self._put(mutate.Graph.empty(self.spark))

    def do_add_node(self, id: str, labels: list[str], properties: dict | None = None) -> int:
        rows = self.spark.createDataFrame([(id, labels, self._json(properties or {}))], "id string, labels array<string>, properties map<string,string>")
        return self._put(mutate.create_nodes(self.graph, rows))

    def do_get_node(self, id: str) -> dict:
        return self._one(self.graph.nodes, id, "node")

    def do_add_edge(self, edge_type: str, source: str, target: str, id: str | None = None, properties: dict | None = None) -> int:
        rows = self.spark.createDataFrame([(id or f"{source}:{edge_type}:{target}", edge_type, source, target, self._json(properties or {}), 1)], mutate.EDGES)
        return self._put(mutate.create_edges(self.graph, rows))

    def do_get_edge(self, id: str) -> dict:
        return self._one(self.graph.edges, id, "edge")

    def do_edge_ids(self, edge_type: str, source: str, target: str) -> list[str]:
        rows = self.graph.edges.filter((F.col("edge_type") == edge_type) & (F.col("source") == source) & (F.col("target") == target))
        return sorted(r["id"] for r in rows.select("id").distinct().collect())

    def do_patch_node_properties(self, id: str, set: dict | None = None, remove: list[str] | None = None) -> int:
        self._one(self.graph.nodes, id, "node")
        rows = self.spark.createDataFrame([(id, self._json(set or {}), remove or [])], "id string, set map<string,string>, remove array<string>")
        return self._put(mutate.patch_nodes(self.graph, rows))

    def do_update_node(self, id: str, properties: dict) -> int:
        rows = self.spark.createDataFrame([(id, self._json(properties))], "id string, properties map<string,string>")
        return self._put(mutate.update_nodes(self.graph, rows))

    def do_set_entity_property(self, id: str, key: str, value) -> int:
        return self._put(mutate.patch_entity(self.graph, id, self._json({key: value}), []))

    def do_remove_entity_property(self, id: str, key: str) -> int:
        return self._put(mutate.patch_entity(self.graph, id, {}, [key]))

    def do_node_versions(self, id: str) -> list[dict]:
        return [r.asDict() for r in history.node_versions(self.history, id).collect()]

    def do_node_at(self, id: str, at: str) -> dict | None:
        rows = history.nodes_at(self.history, F.lit(at).cast("timestamp"), id).collect()
        return rows[0].asDict() if rows else None

    def do_mutation_events(self, after: int = 0, limit: int | None = None) -> list[dict]:
        return [r.asDict() for r in mutate.events_after(self.graph.outbox, after, limit).collect()]

    def do_create_memory(self, id: str, memory_type: str, content: str, created_at: str) -> int:
        return self._put(mutate.create_memories(self.graph, self.spark.createDataFrame([(id, memory_type, content, created_at)], "id string, memory_type string, content string, created_at string")))

    def do_query_memories(self, memory_type: str | None = None) -> list[str]:
        return sorted(r["id"] for r in mutate.memories(self.graph.nodes, memory_type).select("id").collect())

    def do_expire_memories(self, older_than: str) -> int:
        return self._put(mutate.expire_memories(self.graph, older_than))

    def do_set_node_property(self, id: str, key: str, value) -> int:
        return self.do_patch_node_properties(id, {key: value})

    def do_remove_node_property(self, id: str, key: str) -> int:
        return self.do_patch_node_properties(id, None, [key])

    def do_patch_edge_properties(self, id: str, set: dict | None = None, remove: list[str] | None = None) -> int:
        self._one(self.graph.edges, id, "edge")
        rows = self.spark.createDataFrame([(id, self._json(set or {}), remove or [])], "id string, set map<string,string>, remove array<string>")
        return self._put(mutate.patch_edges(self.graph, rows))

    def do_set_edge_property(self, id: str, key: str, value) -> int:
        return self.do_patch_edge_properties(id, {key: value})

    def do_remove_edge_property(self, id: str, key: str) -> int:
        return self.do_patch_edge_properties(id, None, [key])

    def do_delete_node(self, id: str, cascade: bool = True) -> int:
        return self._put(mutate.delete_nodes(self.graph, self.spark.createDataFrame([(id,)], "id string"), cascade))

    def do_import(self, path: str, format: str = "json") -> dict:
        from .sources import graph_files

        if format == "pl":
            before = self.graph
            self._put(mutate.upsert_facts(self.graph, graph_files.read_facts(self.spark, path)))
            return {"nodes": self.graph.nodes.count() - before.nodes.count(), "edges": self.graph.edges.count() - before.edges.count()}
        if format == "wiki":
            nodes = graph_files.read_wiki(self.spark, path)
            self._put(mutate.create_nodes(self.graph, nodes))
            return {"nodes": nodes.count(), "edges": 0}
        nodes, edges = graph_files.read_graph_json(self.spark, path) if format == "json" else graph_files.read_markdown(self.spark, path)
        if format == "markdown":
            nodes = nodes.withColumn("properties", F.transform_values("properties", lambda _, v: F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)))
        self._put(mutate.create_edges(mutate.create_nodes(self.graph, nodes), edges))
        return {"nodes": nodes.count(), "edges": edges.count()}

    def do_export(self, path: str) -> dict:
        from .sources.graph_files import write_graph_json

        write_graph_json(self.graph.nodes, self.graph.edges, path)
        return {"path": path}

    # -- rules

    def do_add_rules(self, text: str) -> None:
        """Adds rules; ``:- index_profile(name, version, {...})`` and ``:- activate_index_profile(name, version)`` act at once."""
        e = Engine(self.spark)
        plain = lambda t: {k: plain(v) for k, v in t.items} if isinstance(t, Obj) else [plain(x) for x in t.items] if isinstance(t, ListTerm) else t.name if isinstance(t, Atom) else t.value
        e.directives = {"index_profile": lambda n, v, o: self.do_put_index_profile(plain(n), plain(v), **plain(o)), "activate_index_profile": lambda n, v: self.do_activate_index_profile(plain(n), plain(v))}
        e.consult(text)
        self.rules += "\n" + text
        if self.store is not None:
            self.store.put_raw("rules", [("program", self.rules)])
        self._engine = None

    def _setter(self, kind: str, remove: bool):
        """A goal that sets or removes a property of the one node or edge that its bound arguments name."""

        def run(e, f, ident, key, value=None):
            name = lambda t: t.name if isinstance(t, Atom) else t.value if isinstance(t, Str) else None
            i, k = name(ident), name(key)
            if i is None or k is None or (not remove and isinstance(value, (Var, Col))):
                raise TermError(f"{'remove' if remove else 'set'}_{kind}_property needs bound arguments")
            new = {} if remove else self._json({k: value.name if isinstance(value, Atom) else value.value})
            rows = self.spark.createDataFrame([(i, new, [k] if remove else [])], "id string, set map<string,string>, remove array<string>")
            table = self.graph.nodes if kind == "node" else self.graph.edges
            if table.filter(F.col("id") == i).isEmpty():
                return None
            self._put((mutate.patch_nodes if kind == "node" else mutate.patch_edges)(self.graph, rows))
            return f

        return run

    def engine(self) -> Engine:
        if self._engine is None:
            raw = self.graph.nodes.select(F.col("id").alias("entity"), F.explode("properties").alias("key", "json"))
            is_text, is_num = F.col("json").startswith('"'), F.col("json").rlike(r"^-?[0-9]")
            number = F.when(is_num, F.col("json").cast("double"))
            kind = F.when(is_text, "str").when(is_num & (number == F.floor(number)), "int").when(is_num, "float").otherwise("atom")
            text_ = F.when(is_text, F.get(F.from_json(F.concat(F.lit("["), "json", F.lit("]")), "array<string>"), F.lit(0))).when(F.col("json").startswith("["), "array").when(F.col("json").startswith("{"), "object").otherwise(F.col("json"))
            props = stage_table(self.spark, raw.select("entity", "key", kind.alias("kind"), text_.alias("text"), number.alias("number")), "properties")
            rules = [r for r in parse_program(self.rules) if isinstance(r, Rule) or not (isinstance(r.goal, Compound) and r.goal.name.endswith("index_profile"))]
            self._engine = Engine(self.spark, Catalog.of_graph(self.spark, self.graph.nodes, self.graph.edges, props))
            self._engine.load(rules)
            for kind in ("node", "edge"):
                self._engine.external[f"set_{kind}_property", 3] = self._setter(kind, False)
                self._engine.external[f"remove_{kind}_property", 2] = self._setter(kind, True)
            if self._retriever is not None:
                attach(self._engine, retriever=self._retriever)
        return self._engine

    def do_query(self, query: str, limit: int | None = None) -> list[dict]:
        """The answers; a client's result set, cut at ``limit`` if it asks for that."""
        df = self.engine().query(query)
        return [r.asDict(True) for r in (df if limit is None else df.limit(limit)).collect()]

    def stream(self, query: str):
        """The answers one after the other, a partition of them in the driver at a time."""
        for r in self.engine().query(query).toLocalIterator():
            yield r.asDict(True)

    def do_explain(self, query: str) -> list[dict]:
        return self.engine().explain(query)

    # -- indexes

    def do_put_index_profile(self, name: str, version: int, labels: list[str] = (), bm25: dict | None = None, vector: dict | None = None, temporal: dict | None = None) -> None:
        self.profiles.put(Profile(name, version, tuple(labels), (), dict(bm25 or {}), dict(vector or {}), dict(temporal or {})))

    def do_activate_index_profile(self, name: str, version: int) -> None:
        """Activates a profile and projects everything anew."""
        self.profiles.activate(name, version)
        if not self.targets:
            folder, nodes = new_folder(self.spark, "indexes"), lambda: self.graph.nodes
            made = {"bm25": Bm25Target(self.spark, f"{folder}/bm25", nodes, self.profiles), "temporal": TemporalTarget(self.spark, f"{folder}/temporal", nodes, self.profiles)}
            if self.config.embedding:
                made["vector"] = VectorTarget(self.spark, f"{folder}/vector", nodes, self.profiles, self.config.dimension, self._now)
            self.targets = {k: coordinator.Target(k, t, versions=self._versions) for k, t in made.items()}
        for t in self.targets.values():
            t.apply.rebuild()
            t.published = self._last()

    @staticmethod
    def _now() -> int:
        return int(time.time())

    def do_list_index_profiles(self) -> list[dict]:
        return self.profiles.list()

    def do_generation_action(self, action: str, generation: int | None = None):
        """create, list, prune, or a move (build, validate, activate, fail, rollback) of one generation."""
        if action == "create":
            return self.generations.create()
        if action == "prune":
            return self.generations.prune()
        return dict(self.generations.states) if action == "list" else self.generations.act(action, generation)

    def do_index_status(self) -> dict:
        return {"sequence": self._last(), "profiles": self.profiles.list(), "targets": {k: {"published": t.published, "stale": t.stale, "dead": t.dead} for k, t in self.targets.items()}}

    def do_wait_indexes(self, timeout_ms: int = 1000, least: int | None = None) -> list[str]:
        """The targets that haven't published a sequence number, by default the last, when time is up."""
        return coordinator.wait(list(self.targets.values()), self._last() if least is None else least, timeout_ms)

    def _field_weights(self) -> dict[str, float]:
        return {f: w for x in sorted(self.profiles.active.items()) for f, w in self.profiles.held[x].bm25.items()}

    def do_search(self, query: str, top_k: int | None = None, fields: list[str] | None = None, entities: list[str] | None = None) -> list[dict]:
        """BM25 over the stored index of the active profiles' fields, with their weights; the best document of each entity."""
        if "bm25" not in self.targets:
            return []
        found = self.targets["bm25"].apply.index.search(query, top_k or self.config.top_k, "entity", fields=fields, entities=entities, weights=self._field_weights())
        return [r.asDict() for r in found.orderBy("rank").collect()]

    def _node_vectors(self) -> KeyedTable:
        if self._vectors is None:
            self._vectors = KeyedTable(self.spark, new_folder(self.spark, "node_vectors"), "id string, embedding array<double>", ["id"])
        return self._vectors

    def do_embed(self, id: str, vector: list[float]) -> None:
        """Stores a node's vector as given."""
        self._one(self.graph.nodes, id, "node")
        self._node_vectors().commit(self.spark.createDataFrame([(id, [float(x) for x in vector])], "id string, embedding array<double>"))

    def do_run_embedding_worker(self, limit: int = 256, now: int | None = None) -> dict:
        """Embeds queued documents with the provider; the outcomes by state."""
        if "vector" not in self.targets:
            raise ValueError("no vector profile is active")
        return run_worker(self.targets["vector"].apply, self.provider, ModelProfile(self.config.model, 1, self.config.dimension, batch_size=self.config.batch_size), self._now() if now is None else now, limit)

    def do_embedding_jobs(self) -> dict:
        return {r["state"]: r["jobs"] for r in job_metrics(self.targets["vector"].apply.jobs.read()).collect()} if "vector" in self.targets else {}

    def all_vectors(self):
        """id, embedding of nodes: stored ones and those of their documents."""
        own = self._node_vectors().read()
        if "vector" in self.targets:
            own = own.unionByName(self.targets["vector"].apply.vectors.read().select(F.col("entity").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")))
        return own

    def do_vector_search(self, vector_: list[float], top_k: int = 10) -> list[dict]:
        best = vector.search(self.all_vectors(), vector_, None, id_col="id").groupBy("doc_id").agg(F.max("score").alias("score"))
        return [r.asDict() for r in vector.ranked(best, top_k).orderBy("rank").collect()]

    def do_prepare_retrieval(self, **request) -> str:
        """Prepares a request over the stored indexes; returns its handle, an atom that retrieve/4 takes."""
        if self._retriever is None:
            index = self.targets["bm25"].apply.index if "bm25" in self.targets else None
            self._retriever = Retriever(self.spark, index, None, provider=self.provider, wait=lambda least, ms: coordinator.wait(list(self.targets.values()), least, ms), watermark=self._last)
        self._retriever.vectors = self.all_vectors()
        self._engine = None
        budget = retrieval.Budget(**request.pop("budget", {}))
        if request.get("vector") is not None:
            request["vector"] = tuple(request["vector"])
        return self._retriever.prepare(Request(budget=budget, **request)).handle

    def do_retrieve(self, handle: str) -> list[dict]:
        if self._retriever is None:
            raise KeyError(f"no prepared request {handle}")
        return [r.asDict(True) for r in self._retriever.retrieve(handle).collect()]

    def do_vector_index_status(self) -> dict:
        strategy = self._retriever.strategy if self._retriever is not None else "exact"
        cells = self._retriever.cells.status(self.all_vectors()) if self._retriever is not None and self._retriever.cells is not None else {"published": False}
        return {**cells, "strategy": strategy, "vectors": self.all_vectors().count()}

    def do_rebuild_vector_index(self, cells: int = 64) -> dict:
        """Publishes a cell index of all vectors, which prepared requests use from then on while it isn't stale."""
        from .operators.ann import CellIndex

        if self._retriever is None:
            self.do_prepare_retrieval(mode="lexical", text="-")
        if self._retriever.cells is None:
            self._retriever.cells = CellIndex(self.spark, new_folder(self.spark, "cells"))
        self._retriever.cells.publish(self.all_vectors(), cells)
        self._retriever.strategy = "cells"
        return self.do_vector_index_status()

    def do_config(self) -> dict:
        return self.config.__dict__.copy()
