"""Search and time relations as goals: bm25/3, vector_similar/3, temporal_on/2, temporal_between/3, valid_at/2, valid_overlaps/3 and retrieve/4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TermError
from ..operators import retrieval, temporal, text, vector
from ..operators.prepared import Retriever
from .catalog import Relation
from .engine import Engine, Frame
from .terms import Atom, Col, Int, Obj, Str, Term


def _given(t: Term, what: str) -> str:
    if isinstance(t, (Str, Atom)):
        return t.value if isinstance(t, Str) else t.name
    raise TermError(f"expected bound constant: {what}")


def _narrowed(e: Engine, f: Frame, df: DataFrame, entity: Term, ident: str) -> DataFrame:
    """The index rows of a bound entity, or of the frame's entities."""
    if isinstance(entity, Atom):
        return df.filter(F.col(ident) == entity.name)
    if isinstance(entity, Col) and f.df is not None:
        return df.join(f.df.select(F.col(entity.name).alias(ident)).distinct(), ident, "left_semi")
    return df


def attach(engine: Engine, documents: DataFrame | None = None, vectors: DataFrame | None = None, events: DataFrame | None = None, validity: DataFrame | None = None, retriever: Retriever | None = None, answer_limit: int | None = None) -> Engine:
    """Adds the goals for documents (id, text), vectors (id, embedding), events (id, at) and validity (id, valid_from, valid_to); ids are atoms.

    With a ``retriever``, retrieve/4 also takes the handle of a prepared request,
    whose hits are one table for all goals that ask for it. ``answer_limit``
    bounds what one search goal gives, by score or id; a goal that had more is
    named in ``engine.exhausted``. Without it nothing is bounded.
    """

    def limited(e, name: str, df: DataFrame, *order) -> DataFrame:
        if answer_limit is None:
            return df
        top = df.orderBy(*order).limit(answer_limit + 1)
        if top.count() > answer_limit:
            e.exhausted.append(name)
        return df.orderBy(*order).limit(answer_limit)


    def bm25(e, f, query, entity, score):
        # Statistics are the corpus's; a bound entity's hits are cut out before they are scored.
        hits = text.bm25_explain(documents, _given(query, "query"), "id", "text", narrowed=lambda df: _narrowed(e, f, df, entity, "doc_id"))
        best = hits.groupBy("doc_id").agg(F.sum("score").alias("score"))
        return e._join(Relation.of(limited(e, "bm25", best, F.col("score").desc(), "doc_id").select("doc_id", "score"), ["atom", "float"]), (entity, score), f, Atom("bm25"))

    def similar(e, f, source, target, score):
        found = vector.similar(vectors, _given(source, "source"), "id", "embedding")
        return e._join(Relation.of(limited(e, "vector_similar", found, F.col("score").desc(), "entity").select("entity", "score"), ["atom", "float"]), (target, score), f, Atom("vector_similar"))

    def of_time(rows, select):
        def run(e, f, *args):
            *bounds, entity = args
            found = select(_narrowed(e, f, rows, entity, "id"), *(_given(b, "time") for b in bounds))
            return e._join(Relation.of(limited(e, "time", found.select("id").distinct(), "id"), ["atom"]), (entity,), f, Atom("time"))

        return run

    def retrieve(e, f, query, options, entity, details):
        """Reciprocal rank fusion of the indexes a query has: options may give top_k, candidate_k and a vector."""
        if retriever is not None and isinstance(query, Atom) and query.name in retriever.held:
            hits = retriever.tabled(query.name, repr(options))
            return e._join(Relation.of(hits.select("doc_id", F.to_json("details")), ["atom", "str"]), (entity, details), f, Atom("retrieve"))
        opts = dict(options.items) if isinstance(options, Obj) else {}
        number = lambda k, d: opts[k].value if isinstance(opts.get(k), Int) else d
        budget = retrieval.Budget(number("top_k", 10), number("candidate_k", 256))
        rankings = {}
        if documents is not None:
            rankings["bm25"] = text.bm25(documents, _given(query, "query"), budget.candidate_k, "id", "text")
        if vectors is not None and "vector" in opts:
            rankings["vector"] = vector.search(vectors, [float(x.value) for x in opts["vector"].items], budget.candidate_k, id_col="id")
        allowed = events.select(F.col("id").alias("doc_id")) if events is not None and opts.get("dated") == Atom("true") else None
        hits = retrieval.filtered(retrieval.fuse(rankings), budget, allowed)
        shown = F.to_json(F.struct(*(c for c in hits.columns if c != "doc_id")))
        return e._join(Relation.of(hits.select("doc_id", shown), ["atom", "str"]), (entity, details), f, Atom("retrieve"))

    found = {}
    if documents is not None:
        found["bm25", 3] = bm25
    if vectors is not None:
        found["vector_similar", 3] = similar
    if documents is not None or vectors is not None or retriever is not None:
        found["retrieve", 4] = retrieve
    if events is not None:
        found["temporal_on", 2] = of_time(events, temporal.on_day)
        found["temporal_between", 3] = of_time(events, temporal.between)
    if validity is not None:
        found["valid_at", 2] = of_time(validity, temporal.valid_at)
        found["valid_overlaps", 3] = of_time(validity, temporal.valid_overlaps)
    engine.external.update(found)
    return engine
