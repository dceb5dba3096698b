"""Bulk work from the command line: ``python -m hornbeam.bulk compile PACK FACTS...`` and ``load STORE PACK``."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .operators import mutate
from .operators.graph_store import GraphStore
from .sources.graph_files import BulkSession, load_pack, read_facts, write_pack


def compile_pack(spark: SparkSession, out: str, files: list[str]) -> dict:
    return write_pack(read_facts(spark, files), out)


def load(spark: SparkSession, store: str, pack: str) -> dict:
    """Loads a pack into a stored graph, part by part, going on where an earlier run ended; one event tells indexes to rebuild."""
    at = GraphStore(spark, store)
    parts = load_pack(spark, pack, BulkSession(spark, f"{store}/bulk"), lambda facts: at.write(mutate.upsert_facts(at.read(), facts)))
    if parts:
        at.put_raw("rebuild_required", [(pack, "1")])
    return {"parts": parts, "nodes": at.nodes.read().count(), "edges": at.edges.read().count()}


def main(args: list[str], spark: SparkSession | None = None) -> dict:
    spark = spark or SparkSession.builder.getOrCreate()
    if args[:1] == ["compile"] and len(args) > 2:
        answer = compile_pack(spark, args[1], args[2:])
    elif args[:1] == ["load"] and len(args) == 3:
        answer = load(spark, args[1], args[2])
    else:
        raise SystemExit(__doc__)
    print(json.dumps(answer))
    return answer


if __name__ == "__main__":
    main(sys.argv[1:])
