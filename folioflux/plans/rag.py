"""One entry to the whole: ingest, retrieve, answer and evaluate for batches of questions over a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from folioflux.errors import ConfigError, FolioError
from folioflux.functions import text as T
from folioflux.observability import Hook, Timer, emit
from folioflux.operators import context, filters, retrieval, transforms
from folioflux.operators.chunking import recursive_chunks
from folioflux.plans import generation
from folioflux.sources import loaders
from folioflux.sources.store import MAX_DELETE, Store

#: (queries, ranking, chunks) to scores (query_id, chunk_id, score).
Scorer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def embedded(rows: DataFrame, key: str, embed: Callable[[Column], Column], dim: int) -> DataFrame:
    """(key, vector) of rows (key, text); a vector of another size than the model's fails the query."""
    vector = embed(F.col("text")).cast("array<double>")
    rows = rows.select(key, vector.alias("vector"))
    fine = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"an embedder of {dim} numbers gave another size")).cast("array<double>"))
    return rows.withColumn("vector", fine)


def embedded_in_batches(embed: Callable[[list[str]], list[list[float]]], size: int = 64) -> Callable[[Column], Column]:
    """A Column function of an embedder that takes lists of texts, at most ``size`` at a time."""
    if size < 1:
        raise ConfigError("a batch has one text or more", size=size)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), size):
            part = texts.iloc[i : i + size].fillna("").tolist()
            got = embed(part)
            if len(got) != len(part):
                raise ValueError(f"an embedder gave {len(got)} vectors for {len(part)} texts")
            out += [[float(x) for x in v] for v in got]
        return pd.Series(out)

    return run


@dataclass
class Rag:
    """A store with its ways of retrieving and a generator.

    mode: dense, bm25, or hybrid, which fuses both. transform gives further phrasings; diversity
    is MMR's balance; window widens hits to their neighbours; rerank gives new scores, and where
    it fails the ranking stays as it was. hook is told what each call took.
    """

    store: Store
    mode: str = "hybrid"
    k: int = 8
    candidates: int = 32
    dim: int = 64
    transform: transforms.Transform | None = None
    diversity: float | None = None
    window: int = 0
    rerank: Scorer | None = None
    budget: int | Column = 4000
    make: Callable[[], generation.Generator] = generation.ExtractiveGenerator
    min_results: int = 1
    min_gap: float = 0.0
    min_score: float | None = None
    chunker: Callable[[DataFrame], DataFrame] = recursive_chunks
    hook: Hook | None = None
    timer: Timer = field(default_factory=Timer)

    def __post_init__(self):
        if self.mode not in ("dense", "bm25", "hybrid"):
            raise ConfigError("unknown mode", mode=self.mode)
        retrieval.check_k(self.k)
        retrieval.check_k(self.candidates)
        if self.window < 0:
            raise ConfigError("window must be 0 or more", window=self.window)

    # ---- what the store does ----

    def ingest(self, documents: DataFrame) -> dict:
        with self.timer.part("ingest"):
            found = self.store.ingest(documents, self.chunker)
        emit(self.hook, "ingest", ms=self.timer.parts["ingest"], **found)
        return found

    def ingest_path(self, root: str, glob: str = "**/*", ignore: tuple = ()) -> dict:
        return self._from_folder(root, glob, ignore, self.ingest)

    def sync_path(self, root: str, glob: str = "**/*", ignore: tuple = (), apply: bool = False, max_delete: float = MAX_DELETE) -> dict:
        return self._from_folder(root, glob, ignore, lambda docs: self.store.sync(docs, apply, max_delete))

    def _from_folder(self, root: str, glob: str, ignore: tuple, use: Callable[[DataFrame], dict]) -> dict:
        """What use() makes of a folder tree's documents, and how many files there were by status. Files are read once, and not kept for a later call."""
        rows = loaders.load_directory(self.store.spark, root, glob, ignore).persist()
        try:
            counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
            meta = F.parse_json(F.to_json(F.struct(F.col("mime").alias("doc.mime"), F.col("title").alias("doc.title"))))
            return {"files": counts} | use(rows.where("status = 'loaded'").select("doc_id", "source_uri", "text", meta.alias("metadata")))
        finally:
            rows.unpersist()

    def delete_document(self, doc_id: str) -> int:
        return self.store.delete(self.store.spark.createDataFrame([(doc_id,)], "doc_id string"))

    def compact(self) -> None:
        self.store.compact()

    # ---- retrieval ----

    def retriever(self, tables: dict[str, DataFrame], ids: DataFrame | None = None) -> retrieval.Retriever:
        dense = lambda q, k: retrieval.dense(embedded(q, "query_id", self.store.embed, self.dim), tables["embeddings"], k, ids)
        lexical = lambda q, k: retrieval.bm25_indexed(q, tables["postings"], k, ids)
        if self.mode == "hybrid":
            return lambda q, k: retrieval.hybrid(q, [dense, lexical], k, self.candidates)
        return dense if self.mode == "dense" else lexical

    def retrieve(self, queries: DataFrame, found: dict | None = None, k: int | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score, source, doc_id, ordinal, text, start_char, end_char, token_count) of queries (query_id, text), of chunks that a metadata filter lets through."""
        k = retrieval.check_k(k or self.k)
        tables = self.store.tables()
        ids = filters.filter_chunk_ids(tables["chunks"], tables["documents"], found) if found else None
        one = self.retriever(tables, ids)
        wide = max(k, self.candidates) if self.rerank or self.diversity is not None else k
        hits = retrieval.multi_query(queries, self.transform(queries), one, wide, max(self.candidates, wide)) if self.transform else one(queries, wide)
        if self.diversity is not None:
            hits = retrieval.mmr(hits, tables["embeddings"], wide if self.rerank else k, self.diversity)
        if self.rerank:
            hits = rerank_or_keep(hits, lambda h: self.rerank(queries, h, tables["chunks"]), k, self.hook)
        columns = ["query_id", "rank", "chunk_id", "score", "source", "doc_id", "ordinal", "text", "start_char", "end_char", "token_count"]
        if self.window:
            wide_hits = retrieval.parent_expand(hits, tables["chunks"], tables["documents"], self.window)
            return wide_hits.withColumn("ordinal", F.lit(None).cast("int")).withColumnRenamed("parent_id", "chunk_id").select(*columns)
        return retrieval.hydrate(hits, tables["chunks"]).select(*columns)

    # ---- answers ----

    def query(self, queries: DataFrame, found: dict | None = None, seed: Column | None = None) -> dict[str, DataFrame]:
        """Answers, citations with their sources, blocks and hits for queries (query_id, text).

        Where too little was found there are no blocks, so the answer is the abstention. The
        retrieval is written once into memory or disk, as every result reads it.
        """
        hits = self.retrieve(queries, found).persist()
        enough = context.insufficient(queries, hits, self.min_results, self.min_gap, self.min_score).where("not insufficient").select("query_id")
        blocks = context.context_blocks(hits.join(enough, "query_id", "left_semi").select("query_id", "rank", "chunk_id", "text"), self.budget).persist()
        made = context.prompts(queries, context.context_texts(blocks), seed)
        answers = generation.answer(made, self.make).persist()
        places = hits.select("query_id", "chunk_id", "doc_id", "start_char", "end_char")
        cited = context.cited_sources(answers, blocks, places, self.store.tables()["documents"])
        return {"answers": answers, "citations": cited, "blocks": blocks, "hits": hits}


def rerank_or_keep(hits: DataFrame, scores: Callable[[DataFrame], DataFrame], n: int, hook: Hook | None = None) -> DataFrame:
    """The n best by new scores; if the reranker fails, the first n as they were, and the hook is told.

    Scores are computed here and now, as a failure later could not be caught.
    """
    try:
        found = scores(hits).persist()
        found.count()
    except Exception as e:  # noqa: BLE001  a reranker is a service: whatever it fails with
        if isinstance(e, ConfigError):
            raise
        emit(hook, "rerank_failed", failed=1.0)
        return retrieval.rerank(hits, None, n)
    return retrieval.rerank(hits, found, n)


def build(spark: SparkSession, root: str, documents: DataFrame | None = None, **how) -> Rag:
    """A Rag over a store below root, with documents ingested."""
    rag = Rag(Store(spark, root, **{k: how.pop(k) for k in ("model", "embed") if k in how}), **how)
    if documents is not None:
        rag.ingest(documents)
    return rag


def sweep(make: Callable[..., Rag], settings: list[dict], measure: Callable[[Rag], DataFrame]) -> DataFrame:
    """(setting, metric, value) of measure() over a Rag for each of the settings; settings are few and run one after the other."""
    out = None
    for setting in settings:
        try:
            rows = measure(make(**setting))
        except FolioError as e:
            raise ConfigError("a setting cannot be measured", setting=str(setting), cause=str(e)) from e
        name = ", ".join(f"{k}={v}" for k, v in sorted(setting.items()))
        rows = rows.select(F.lit(name).alias("setting"), "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ConfigError("a sweep needs a setting")
    return out


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object with all its fields, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(name))


def lexical(queries: DataFrame, ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """A Scorer without a model."""
    return retrieval.lexical_scores(ranking, queries, chunks)


def hash_embed(dim: int = 64) -> Callable[[Column], Column]:
    return lambda c: T.hash_embedding(c, dim)
