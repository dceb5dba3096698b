"""Prepared retrievals: a request is checked, waits for its indexes, fixes their generations and embeds its query once; its handle is asked many times."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stage_table
from . import retrieval, text, vector
from .ann import CellIndex
from .text_index import TextIndex


@dataclass(frozen=True)
class Request:
    """One query of a mode (lexical, vector or hybrid), given as text, as a vector or as the id of a document whose vector it is."""

    mode: str = "hybrid"
    text: str | None = None
    vector: tuple[float, ...] | None = None
    source: str | None = None
    least_sequence: int = 0
    budget: retrieval.Budget = field(default_factory=retrieval.Budget)

    def __post_init__(self):
        if self.mode not in ("lexical", "vector", "hybrid"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode != "vector" and not (self.text or "").strip():
            raise ValueError(f"a {self.mode} request needs a text")
        if self.mode != "lexical" and self.text is None and self.vector is None and self.source is None:
            raise ValueError(f"a {self.mode} request needs a text, a vector or a source document")
        if (self.vector is not None) + (self.source is not None) > 1:
            raise ValueError("a request has one vector at most")


@dataclass(frozen=True)
class Prepared:
    handle: str
    request: Request
    query_vector: tuple[float, ...] | None
    generations: dict[str, int]
    watermark: int


class Retriever:
    """Prepares requests over a table of documents or a stored text index, and a table of vectors or a published cell index."""

    #: Prepared requests and their results that are kept; the least recently used go first.
    MOST_HELD = 10_000

    def __init__(
        self, spark: SparkSession, documents: DataFrame | TextIndex | None = None, vectors: DataFrame | None = None, cells: CellIndex | None = None,
        provider=None, wait: Callable[[int, int], list[str]] | None = None, watermark: Callable[[], int] | None = None, strategy: str = "exact",
    ):
        if strategy not in ("disabled", "exact", "cells"):
            raise ValueError(f"unknown strategy {strategy}")
        self.spark, self.documents, self.vectors, self.cells, self.provider = spark, documents, vectors, cells, provider
        self.wait, self.watermark, self.strategy = wait, watermark or (lambda: 0), strategy
        self.held: OrderedDict[str, Prepared] = OrderedDict()
        self.tables: OrderedDict[tuple[str, str], DataFrame] = OrderedDict()

    def prepare(self, request: Request) -> Prepared:
        if request.mode != "lexical" and (self.strategy == "disabled" or self.vectors is None and self.cells is None):
            raise ValueError(f"vectors are not enabled, so a {request.mode} request can't be prepared")
        if self.wait is not None and (behind := self.wait(request.least_sequence, request.budget.timeout_ms)):
            raise TimeoutError(f"indexes are behind: {', '.join(behind)}")
        q = request.vector
        if request.mode != "lexical" and q is None:
            if request.source is not None:
                row = self.vectors.filter(F.col("id") == request.source).select("embedding").limit(1).collect()
                if not row:
                    raise KeyError(f"no vector of {request.source}")
                q = tuple(row[0]["embedding"])
            elif self.provider is None:
                raise ValueError("no provider embeds the text")
            else:
                q = tuple(self.provider.embed([request.text])[0])
        generations = {}
        if isinstance(self.documents, TextIndex):
            generations["bm25"] = self.documents.documents.log.last()[0]
        if self.cells is not None:
            generations["vector"] = self.cells.log.last()[0]
        ident = json.dumps([asdict(request), q, generations, self.watermark()], sort_keys=True, default=list)
        made = Prepared("r" + hashlib.sha256(ident.encode()).hexdigest()[:16], request, q, generations, self.watermark())
        self.held[made.handle] = made
        self.held.move_to_end(made.handle)
        while len(self.held) > self.MOST_HELD:
            self.held.popitem(last=False)
        return made

    def _rankings(self, p: Prepared) -> tuple[dict[str, DataFrame], bool]:
        out, exact, k = {}, True, p.request.budget.candidate_k
        if p.request.mode != "vector" and self.documents is not None:
            if isinstance(self.documents, TextIndex):
                out["bm25"] = self.documents.search(p.request.text, k, "entity").withColumnRenamed("entity", "doc_id")
            else:
                out["bm25"] = text.bm25(self.documents, p.request.text, k, "id", "text")
        if p.request.mode != "lexical":
            fresh = self.strategy == "cells" and self.cells is not None and (self.vectors is None or not self.cells.status(self.vectors).get("stale", False))
            if fresh:
                # A filtered request would lose hits that lie in other cells, and falls back to the exact scan in ``retrieve``.
                out["vector"], exact = self.cells.search(list(p.query_vector), k), False
            else:
                out["vector"] = vector.search(self.vectors, list(p.query_vector), k, id_col="id")
            out["vector"] = out["vector"].select("doc_id", "score", "rank")
        return out, exact

    def retrieve(self, handle: str, valid: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
        """doc_id and details of a prepared request's hits.

        ``details`` has mode, strategy, exact, exhausted, fused_rank, fused_score
        and, for each retriever, rank, score, generation and watermark, or null.
        """
        if handle not in self.held:
            raise KeyError(f"no prepared request {handle}")
        p = self.held[handle]
        self.held.move_to_end(handle)
        strategy = self.strategy
        if strategy == "cells" and (valid is not None or graph is not None):
            self.strategy = "exact" if self.vectors is not None else "cells"
        try:
            rankings, exact = self._rankings(p)
        finally:
            used, self.strategy = self.strategy, strategy
        fused = stage_table(self.spark, retrieval.fuse(rankings), "fused")
        stats = retrieval.execution_stats(fused, p.request.budget, valid, graph).first()
        hits = retrieval.filtered(fused, p.request.budget, valid, graph)
        parts = []
        for name in ("bm25", "vector"):
            found = F.struct(F.col(f"{name}_rank").alias("rank"), F.col(f"{name}_score").alias("score"), F.lit(p.generations.get(name)).cast("long").alias("generation"), F.lit(p.watermark).cast("long").alias("watermark")) if name in rankings else None
            empty = F.lit(None).cast("struct<rank:int,score:double,generation:bigint,watermark:bigint>")
            parts.append((F.when(F.col(f"{name}_rank").isNotNull(), found) if found is not None else empty).alias(name))
        details = F.struct(F.lit(p.request.mode).alias("mode"), F.lit(used).alias("strategy"), F.lit(exact).alias("exact"), F.lit(bool(stats["exhausted"])).alias("exhausted"), "fused_rank", "fused_score", *parts)
        return hits.select("doc_id", details.alias("details"))

    def tabled(self, handle: str, options: str = "") -> DataFrame:
        """The hits of a handle as a written table, made once for each handle and options while it is in use."""
        key = (handle, options)
        if key not in self.tables:
            self.tables[key] = stage_table(self.spark, self.retrieve(handle), "retrieved")
        self.tables.move_to_end(key)
        while len(self.tables) > self.MOST_HELD:
            self.tables.popitem(last=False)
        return self.tables[key]
