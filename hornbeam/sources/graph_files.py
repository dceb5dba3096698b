"""Graphs from and to JSON, Markdown folders, fact files, packs and taxonomy dumps."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import Log
from ..shared import ship, stage_table

_GRAPH = "nodes array<struct<id:string,labels:array<string>,properties:string>>, edges array<struct<id:string,edge_type:string,type:string,source:string,target:string,properties:string>>"


def _values(c):
    """JSON text by key of a JSON object."""
    return F.transform_values(F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>"), lambda _, v: F.to_json(v))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, labels, properties) and edges(id, edge_type, source, target, properties) of ``{nodes, edges}`` documents, or of a folder that ``write_graph_json`` made.

    Properties are JSON text by key. Nodes without labels and edges without a
    type or an end are skipped; ids that are missing are made from the content.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        schema = _GRAPH.replace("nodes array<struct<", "").split(">>, edges array<struct<")
        n = spark.read.schema(_fields(schema[0])).json(f"{path}/nodes")
        e = spark.read.schema(_fields(schema[1][:-2])).json(f"{path}/edges")
    else:
        doc = spark.read.schema(_GRAPH).json(path, multiLine=True)
        n, e = doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("edges").alias("e")).select("e.*")
    n = n.filter("labels is not null")
    nodes = n.select(F.coalesce("id", F.concat(F.lit("n"), F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 16))).alias("id"), "labels", _values(F.col("properties")).alias("properties"))
    e = e.withColumn("edge_type", F.coalesce("edge_type", "type")).filter("edge_type is not null and source is not null and target is not null")
    edges = e.select(F.coalesce("id", F.concat_ws(":", "source", "edge_type", "target")).alias("id"), "edge_type", "source", "target", _values(F.col("properties")).alias("properties"))
    return nodes, edges


def _fields(struct: str) -> str:
    return struct.replace("array<string>", "ARRAY").replace(":", " ").replace("ARRAY", "array<string>")


def object_text(properties):
    """A JSON object of JSON texts by key."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda x: F.concat(quoted(x["key"]), F.lit(":"), x["value"])), ","), F.lit("}"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in ``path``/nodes and ``path``/edges, written by the executors; ``read_graph_json`` reads them back as they were."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        plain = [c for c in table.columns if c not in ("properties", "version")]
        head = F.to_json(F.struct(*plain))
        table.select(F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"properties":'), object_text(F.col("properties")), F.lit("}")).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


MOST_CHUNK = 4000


def markdown_chunks(text: str, most: int = MOST_CHUNK) -> list[str]:
    """A chunk starts at each ``# `` or ``## `` line and where one would exceed ``most`` characters."""
    out: list[str] = []
    held = ""
    for line in text.splitlines(keepends=True):
        if held and (re.match(r"##? ", line) or len(held) + len(line) > most):
            out.append(held)
            held = ""
        held += line
    return [x for x in [*out, held] if x.strip()]


def read_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``document`` nodes (title, path, content), ``chunk`` nodes and ``contains`` edges of all .md files below a path."""
    ship(spark)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(markdown_chunks)

    title = F.coalesce(F.nullif(F.regexp_extract("content", r"(?m)^# (.+)$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)\.md$", 1))
    docs = files.select(F.concat(F.lit("doc_"), F.substring(F.sha2("path", 256), 1, 16)).alias("id"), "path", "content", title.alias("title"))
    chunks = docs.select("id", F.posexplode(cut("content")).alias("n", "text"))
    ident = F.concat_ws("_", "id", F.col("n").cast("string"))
    nodes = docs.select("id", F.array(F.lit("document")).alias("labels"), F.create_map(F.lit("title"), "title", F.lit("path"), "path", F.lit("content"), "content").alias("properties"))
    nodes = nodes.unionByName(chunks.select(ident.alias("id"), F.array(F.lit("chunk")).alias("labels"), F.create_map(F.lit("content"), F.col("text"), F.lit("ordinal"), F.col("n").cast("string")).alias("properties")))
    edges = chunks.select(F.concat_ws(":", "id", F.lit("contains"), ident).alias("id"), F.lit("contains").alias("edge_type"), F.col("id").alias("source"), ident.alias("target"), F.create_map().cast("map<string,string>").alias("properties"))
    return nodes, edges


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """nodes(id, labels, properties) of a wiki's .md files: ``article`` and the folders above it as labels; title, path and the whole content as properties."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    full = F.url_decode(F.replace(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), F.lit("file://"), F.lit("")))
    inside = F.regexp_replace(F.substring_index(full, root + "/", -1), r"^/+", "")
    rows = files.select(inside.alias("path"), F.col("value").alias("content"))
    parts = F.split("path", "/")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    title = F.regexp_replace(F.element_at(parts, -1), r"\.md$", "")
    properties = F.create_map(F.lit("title"), quoted(title), F.lit("path"), quoted(F.col("path")), F.lit("content"), quoted(F.col("content")))
    return rows.select(F.concat(F.lit("wiki:"), F.col("path")).alias("id"), F.concat(F.array(F.lit("article")), F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("labels"), properties.alias("properties"))


def _dmp(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_taxonomy(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """taxa(id, tax_id, scientific_name, rank) and parents(child, parent) of a taxonomy dump's nodes.dmp and names.dmp."""
    nodes = _dmp(spark, f"{folder}/nodes.dmp", ["tax_id", "parent", "rank"])
    names = _dmp(spark, f"{folder}/names.dmp", ["tax_id", "name", "unique_name", "name_class"]).filter("name_class = 'scientific name'")
    tax = lambda c: F.concat(F.lit("tax_"), c)
    taxa = nodes.join(names, "tax_id", "left").select(tax(F.col("tax_id")).alias("id"), F.col("tax_id").cast("long").alias("tax_id"), F.col("name").alias("scientific_name"), "rank")
    return taxa, nodes.filter("tax_id <> parent").select(tax(F.col("tax_id")).alias("child"), tax(F.col("parent")).alias("parent"))


def taxonomy_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, a, b, properties) facts of a taxonomy dump: taxa with all their names, parents, and merged and deleted numbers."""
    tax = lambda c: F.concat(F.lit("tax_"), c)
    text = lambda c: F.to_json(F.array(F.coalesce(c, F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce(c, F.lit(""))))) - 2)
    columns = ["tax_id", "parent", "rank", "embl", "division_id", "inherited_division", "genetic_code_id", "inherited_code", "mitochondrial_genetic_code_id", "inherited_mitochondrial", "genbank_hidden", "hidden_subtree_root"]
    nodes = _dmp(spark, f"{folder}/nodes.dmp", columns)
    names = _dmp(spark, f"{folder}/names.dmp", ["tax_id", "text", "unique_name", "name_class"])
    scientific = F.max(F.when(F.col("name_class") == "scientific name", F.col("text")))
    listed = names.groupBy("tax_id").agg(scientific.alias("scientific_name"), F.to_json(F.array_sort(F.collect_list(F.struct("text", "unique_name", "name_class")))).alias("names"))
    taxa = nodes.join(listed, "tax_id", "left")
    numbers = [c for c in ("tax_id", "division_id", "genetic_code_id", "mitochondrial_genetic_code_id", "genbank_hidden", "hidden_subtree_root")]
    pairs = [x for c in numbers for x in (F.lit(c), F.coalesce(F.col(c), F.lit("null")))] + [F.lit("scientific_name"), text(F.col("scientific_name")), F.lit("rank"), text(F.col("rank")), F.lit("names"), F.coalesce("names", F.lit("[]"))]
    null = F.lit(None).cast("map<string,string>")
    node = lambda ident, label, properties: (F.lit("node").alias("name"), ident.alias("a"), F.to_json(F.array(F.lit(label))).alias("b"), properties.alias("properties"))
    edge = lambda kind, a, b: (F.lit(kind).alias("name"), a.alias("a"), b.alias("b"), null.alias("properties"))
    out = taxa.select(*node(tax(F.col("tax_id")), "taxon", F.create_map(*pairs))).unionByName(nodes.filter("tax_id <> parent").select(*edge("taxonomy_parent", tax(F.col("tax_id")), tax(F.col("parent")))))
    number = F.create_map(F.lit("tax_id"), F.col("tax_id"))
    merged, deleted = _dmp(spark, f"{folder}/merged.dmp", ["tax_id", "into"]), _dmp(spark, f"{folder}/delnodes.dmp", ["tax_id"])
    out = out.unionByName(merged.select(*node(tax(F.col("tax_id")), "merged_taxon", number))).unionByName(merged.select(*edge("merged_into", tax(F.col("tax_id")), tax(F.col("into")))))
    return out.unionByName(deleted.select(*node(tax(F.col("tax_id")), "deleted_taxon", number)))


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts as fact files, a statement a line, which ``read_facts`` reads back."""
    atom = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    entry = lambda x: F.concat(F.to_json(F.array(x["key"])).substr(F.lit(2), F.length(F.to_json(F.array(x["key"]))) - 2), F.lit(": "), x["value"])
    inside = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("properties")), entry), ", "), F.lit("}"))
    labels = F.concat(F.lit("["), F.array_join(F.transform(F.from_json("b", "array<string>"), atom), ", "), F.lit("]"))
    node = (F.col("name") == "node") & F.col("b").isNotNull()
    prop = F.col("name").startswith("prop_") & F.col("b").isNotNull()
    args = F.when(node, F.concat_ws(", ", atom(F.col("a")), labels, inside)).when(F.col("b").isNull(), atom(F.col("a"))).when(prop, F.concat_ws(", ", atom(F.col("a")), "b"))
    args = args.when(F.col("properties").isNotNull() & (F.size("properties") > 0), F.concat_ws(", ", atom(F.col("a")), atom(F.col("b")), inside)).otherwise(F.concat_ws(", ", atom(F.col("a")), atom(F.col("b"))))
    facts.select(F.concat(atom(F.col("name")), F.lit("("), args, F.lit(").")).alias("value")).write.mode("overwrite").text(path)


FACTS = "name string, a string, b string, properties map<string,string>"
Fact = tuple[str, str, str | None, dict[str, str] | None]


#: A fact of one or two quoted atoms without escapes, of which no argument is read as labels or JSON; it needs no parser.
_PLAIN = re.compile(r"'(?!node'|prop_)([^'\\\n]*)'\('([^'\\\n]*)'(?:, '([^'\\\n]*)')?\)")


def facts_of_statements(texts: list[str]) -> list[Fact]:
    """(name, a, b, properties) rows of ground facts.

    ``name(a)`` has no b; of ``prop_k(a, v)`` b is JSON, of ``name(a, b)`` an id.
    ``node(a, [labels], {properties})`` has its labels as a JSON array in b,
    ``name(a, b, {properties})`` is an edge with properties; properties are JSON
    text by key.
    """
    from ..plans.parser import parse_term
    from ..plans.terms import Atom, Compound, ListTerm, Obj, ground

    def plain(x):
        if isinstance(x, ListTerm):
            return [plain(i) for i in x.items]
        if isinstance(x, Obj):
            return {k: plain(v) for k, v in x.items}
        if isinstance(x, Atom):
            return {"true": True, "false": False, "null": None}.get(x.name, x.name)
        if isinstance(x, Compound):
            raise ValueError(f"a value can't be the term {x.name}/{len(x.args)}")
        return x.value

    ident = lambda x: x.name if isinstance(x, Atom) else str(x.value)
    out: list[Fact] = []
    for text in texts:
        if m := _PLAIN.fullmatch(text):
            out.append((*m.groups(), None))
            continue
        t = parse_term(text)
        if not isinstance(t, Compound) or not ground(t) or len(t.args) > 3 or isinstance(t.args[0], (ListTerm, Obj, Compound)):
            raise ValueError(f"not a ground fact of one to three arguments: {text[:200]}")
        a, b, properties = ident(t.args[0]), None, None
        if len(t.args) == 3:
            last = t.args[2]
            if not isinstance(last, Obj):
                raise ValueError(f"the third argument of a fact is an object: {text[:200]}")
            properties = {k: json.dumps(plain(v), ensure_ascii=False) for k, v in last.items}
        if len(t.args) > 1:
            second = t.args[1]
            if t.name == "node":
                if not isinstance(second, ListTerm):
                    raise ValueError(f"the second argument of a node is a list of labels: {text[:200]}")
                b = json.dumps([ident(x) for x in second.items], ensure_ascii=False)
                properties = properties or {}
            else:
                b = json.dumps(second.name if isinstance(second, Atom) else plain(second), ensure_ascii=False) if t.name.startswith("prop_") else ident(second)
        out.append((t.name, a, b, properties))
    return out


def _fact_batch(held: list[str], file: str):
    import pyarrow as pa

    rows = facts_of_statements(held)
    columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)] + [pa.array([None if r[3] is None else list(r[3].items()) for r in rows], pa.map_(pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([file] * len(rows), pa.string()), pa.array([False] * len(rows))], ["name", "a", "b", "properties", "file", "torn"])


def read_facts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, a, b, properties) of fact files, which are split by byte ranges where a period ends a line.

    A file in which such a period stands inside quotes or brackets is noticed by
    the task that reads on to its next border, and is read again as a whole.
    """
    import pyarrow as pa

    from ..plans.parser import ParseError, statements

    ship(spark)
    schema = f"{FACTS}, file string, torn boolean"

    def work(batches):
        held, file, carried = [], None, ""

        def torn(name):
            return pa.RecordBatch.from_arrays([pa.array([None], t) for t in (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))] + [pa.array([name], pa.string()), pa.array([True])], ["name", "a", "b", "properties", "file", "torn"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    if held:
                        yield _fact_batch(held, file)
                    if carried:
                        yield torn(file)
                    held, file, carried = [], name, ""
                if not carried and _PLAIN.fullmatch(text):
                    held.append(text)
                    if len(held) >= 50_000:
                        yield _fact_batch(held, file)
                        held = []
                    continue
                carried += text if text.rstrip().endswith(".") else text + ".\n"
                try:
                    found = list(statements([carried]))
                    facts = facts_of_statements(found) and found
                except (ParseError, ValueError):
                    if len(carried) > 1 << 24:
                        yield torn(file)
                        carried = " "
                    continue
                carried = ""
                held += facts or []
                if len(held) >= 50_000:
                    yield _fact_batch(held, file)
                    held = []
        if held:
            yield _fact_batch(held, file)
        if carried:
            yield torn(file)

    def whole(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[str] = []
                for s in statements([text]):
                    held.append(s)
                    if len(held) >= 50_000:
                        yield _fact_batch(held, name)
                        held = []
                if held:
                    yield _fact_batch(held, name)

    lines = spark.read.option("lineSep", ".\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    found = stage_table(spark, lines.mapInArrow(work, schema), "facts")
    bad = [r["file"] for r in found.filter("torn").select("file").distinct().collect()]
    out = found.filter("not torn")
    if bad:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("file").isin(bad))
        out = out.filter(~F.col("file").isin(bad)).unionByName(files.mapInArrow(whole, schema))
    return out.select("name", "a", "b", "properties")


#: Parts of a pack, each loaded as one step.
PACK_PARTS = 16


def _record_sum():
    return F.xxhash64("name", "a", "b", F.array_sort(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>")))))


def write_pack(facts: DataFrame, path: str, parts: int = PACK_PARTS) -> dict:
    """Compiles facts into a pack: Parquet in parts by the first argument, a checksum with each record, and a manifest with counts and order-free checksums.

    Facts that only change what is there (``prop_k``) are refused: a pack holds
    nodes, labels and edges. A pack that exists is an error.
    """
    spark = facts.sparkSession
    odd = facts.filter(F.col("name").startswith("prop_")).limit(1).collect()
    if odd:
        raise ValueError(f"a pack holds no property facts: {odd[0]['name']}({odd[0]['a']}, ...)")
    given = facts if "properties" in facts.columns else facts.withColumn("properties", F.lit(None).cast("map<string,string>"))
    rows = given.select("name", "a", "b", "properties").withColumn("record_sum", _record_sum()).dropDuplicates(["name", "a", "b", "record_sum"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int"))
    rows.repartition("part").sortWithinPartitions("part", "name", "a", "b").write.partitionBy("part").mode("errorifexists").parquet(f"{path}/facts")
    manifest = pack_summary(spark.read.parquet(f"{path}/facts")) | {"parts": parts}
    Log(spark, f"{path}/manifest").append(1, manifest)
    return manifest


def pack_summary(facts: DataFrame) -> dict:
    r = facts.agg(F.count("*").alias("n"), F.sum(F.col("record_sum").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("record_sum") != _record_sum()).alias("bad")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} records of the pack don't match their checksums")
    return {"version": 2, "facts": r["n"], "checksum": str(r["s"])}


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """The facts of a pack, after its manifest and every record's checksum have been checked."""
    n, manifest = Log(spark, f"{path}/manifest").last()
    facts = spark.read.parquet(f"{path}/facts")
    if not n or pack_summary(facts) != {k: manifest[k] for k in ("version", "facts", "checksum")}:
        raise ValueError(f"{PurePosixPath(path).name} doesn't match its manifest")
    return facts.select("name", "a", "b", "properties", "part")


class BulkSession:
    """The progress of loading one pack: started, writing with a checkpoint that only grows, complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path)

    @property
    def state(self) -> dict:
        return self.log.last()[1] or {"state": "none", "pack": None, "checkpoint": 0}

    def _put(self, state: dict) -> None:
        self.log.append(self.log.last()[0] + 1, state)
        self.log.keep_last(2)

    def start(self, pack: str) -> int:
        """The checkpoint to go on from; another pack can't start before this one is complete."""
        now = self.state
        if now["state"] in ("started", "writing") and now["pack"] != pack:
            raise ValueError(f"pack {now['pack']} is not complete")
        if now["pack"] != pack:
            self._put({"state": "started", "pack": pack, "checkpoint": 0})
        return self.state["checkpoint"]

    def checkpoint(self, n: int) -> None:
        now = self.state
        if now["state"] not in ("started", "writing") or n <= now["checkpoint"]:
            raise ValueError(f"checkpoint {n} doesn't follow {now['checkpoint']} of a session that is {now['state']}")
        self._put({**now, "state": "writing", "checkpoint": n})

    def complete(self) -> None:
        self._put({**self.state, "state": "complete"})


def load_pack(spark: SparkSession, path: str, session: BulkSession, apply) -> int:
    """Gives each part of a checked pack to ``apply(facts)``, in order, from the session's checkpoint; returns the parts that were applied.

    A pack that was loaded before is not loaded again. After a crash the part
    that was under way is applied once more, which facts allow.
    """
    facts = read_pack(spark, path)
    manifest = Log(spark, f"{path}/manifest").last()[1]
    pack = f"{manifest['facts']}:{manifest['checksum']}"
    done = session.start(pack)
    if session.state["state"] == "complete":
        return 0
    for part in range(done, manifest["parts"]):
        apply(facts.filter(F.col("part") == part).drop("part"))
        session.checkpoint(part + 1)
    session.complete()
    return manifest["parts"] - done
