"""Model profiles, embedding providers and the worker that turns queued documents into vectors."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship, stage_table
from .lifecycle import claim_jobs, finish_jobs


@dataclass(frozen=True)
class ModelProfile:
    """An immutable (id, version) of how texts become vectors."""

    id: str = "bge_m3_dense_v1"
    version: int = 1
    dimension: int = 1024
    metric: str = "cosine"
    max_chars: int = 8192
    batch_size: int = 32
    template: str = "{text}"
    normalized: bool = True

    def __post_init__(self):
        if self.dimension < 1 or self.batch_size < 1 or self.max_chars < 1 or "{text}" not in self.template:
            raise ValueError("a model needs a dimension, a batch size, a length and a template with {text}")


class ModelProfiles:
    """Put and get; a put version never changes."""

    def __init__(self):
        self.held: dict[tuple[str, int], ModelProfile] = {}

    def put(self, p: ModelProfile) -> None:
        if self.held.setdefault((p.id, p.version), p) != p:
            raise ValueError(f"model {p.id} version {p.version} is there already")

    def get(self, ident: str, version: int) -> ModelProfile:
        return self.held[ident, version]


@dataclass(frozen=True)
class HashingProvider:
    """Deterministic vectors of hashed words and letter triples: needs no network, and near texts are near."""

    dimension: int = 1024

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"\w+", t.lower()):
                for part in (w, *(f"#{w[i : i + 3]}" for i in range(len(w) - 2))):
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


def _post(url: str, body: dict, key: str | None, timeout: float):
    headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
        return json.loads(answer.read())


@dataclass(frozen=True)
class BatchProvider:
    """A service that takes many texts a request (POST <url>/v1/embeddings) and numbers its answers."""

    url: str
    model: str
    key: str | None = field(default=None, repr=False)
    timeout: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        data = _post(f"{self.url.rstrip('/')}/v1/embeddings", {"model": self.model, "input": texts}, self.key, self.timeout)["data"]
        if sorted(d["index"] for d in data) != list(range(len(texts))):
            raise ValueError(f"asked for {len(texts)} vectors, got {len(data)}")
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


@dataclass(frozen=True)
class SingleProvider:
    """A service that takes one text a request (POST <url>) and answers with its vector, or a list of one."""

    url: str
    key: str | None = field(default=None, repr=False)
    timeout: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            got = _post(self.url, {"inputs": t}, self.key, self.timeout)
            out.append(got[0] if got and isinstance(got[0], list) else got)
        return out


def problem_of(v: list[float], profile: ModelProfile) -> str | None:
    if len(v) != profile.dimension:
        return "dimension"
    if not all(math.isfinite(x) for x in v):
        return "finite"
    return None if any(v) else "zero"


def embedded(docs: DataFrame, provider, profile: ModelProfile, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """id, embedding, problem: the vectors of texts, made in batches by the executors; a text that fails, fails alone.

    A text longer than the model takes is refused with the problem ``length``,
    not cut: chunk it first.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(frames):
        for frame in frames:
            for i in range(0, len(frame), profile.batch_size):
                part = frame.iloc[i : i + profile.batch_size]
                texts = [profile.template.replace("{text}", t or "") for t in part["t"]]
                fits = [len(t) <= profile.max_chars for t in texts]
                vectors: list = [None] * len(texts)
                problems: list = [None if ok else "length" for ok in fits]
                asked = [k for k, ok in enumerate(fits) if ok]
                try:
                    got = provider.embed([texts[k] for k in asked]) if asked else []
                    if len(got) != len(asked):
                        raise ValueError(f"asked for {len(asked)} vectors, got {len(got)}")
                    for k, v in zip(asked, got):
                        problems[k] = problem_of(v, profile)
                        size = math.sqrt(sum(x * x for x in v)) if profile.normalized else 1.0
                        vectors[k] = [float(x) / size for x in v] if problems[k] is None else None
                except Exception as error:  # a provider may fail for any reason
                    for k in asked:
                        problems[k] = f"provider: {error}"[:500]
                yield pd.DataFrame({id_col: part["id"].tolist(), "embedding": vectors, "problem": problems})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(work, f"{id_col} {kind}, embedding array<float>, problem string")


def run_worker(target, provider, profile: ModelProfile, now: int, limit: int = 256, lease: int = 30, max_attempts: int = 8) -> dict[str, int]:
    """Claims up to ``limit`` due jobs of a vector target, embeds those that are still wanted and publishes their vectors.

    A job of an older text is stale and gets no vector; a failure is retried
    2^n seconds later and is dead after ``max_attempts``. The lease is committed
    before any provider is called, so that another worker takes other jobs.
    """
    spark = target.jobs.spark
    table = target.jobs
    columns = table.read().columns
    jobs = table.read()
    claimed = claim_jobs(jobs, now, limit, lease)
    mine = stage_table(spark, claimed.filter((F.col("state") == "leased") & (F.col("leased_until") == now + lease)).select(*columns), "leases")
    if mine.isEmpty():
        return {}
    table.commit(mine)
    from ..streaming.targets import _documents
    from .text_index import document_id

    wanted = _documents(target.nodes(), target.profiles, "vector")
    ok = mine.limit(0)
    if wanted is not None:
        wanted = wanted.select(document_id(F.col("entity"), F.col("field"), F.col("chunk_id")).alias("document_id"), "fingerprint")
        ok = mine.join(wanted, ["document_id", "fingerprint"], "left_semi").select(*columns)
    stale = mine.join(ok, "document_id", "left_anti").withColumn("state", F.lit("stale"))
    made = stage_table(spark, embedded(ok, provider, profile), "embedded")
    good = ok.join(made.filter("problem is null"), "document_id").select("document_id", "entity", "field", "chunk_id", "source_version", "embedding")
    target.vectors.commit(good)
    done = finish_jobs(ok.withColumn("state", F.lit("leased")), made.select("document_id", F.col("problem").isNull().alias("ok")), now, max_attempts)
    done = done.join(made.select("document_id", F.col("problem").alias("why")), "document_id", "left")
    finished = ok.drop("state", "attempts", "leased_until", "not_before", "problem").join(done.select("document_id", "state", "attempts", "leased_until", "not_before", F.col("why").alias("problem")), "document_id").select(*columns)
    out = stage_table(spark, finished.unionByName(stale.select(*columns)), "jobs")
    table.commit(out)
    return {r["state"]: r["n"] for r in out.groupBy("state").agg(F.count("*").alias("n")).collect()}
