"""A versioned store of documents, chunks, embeddings and their inverted index in Parquet.

A change writes what is new as a part, and tombstones for what it replaces or removes; no
other row is rewritten. Numbered manifests list the parts, and the highest one counts: it
comes into being by a rename, so readers see all of a change or none, and a writer who
finds its number taken fails. compact() merges parts and tombstones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioflux.errors import ConfigError, EmbeddingError, ModelMismatch, StoreError
from folioflux.functions import text as T
from folioflux.operators.chunking import recursive_chunks
from folioflux.operators.retrieval import dense, postings

DUPLICATE = 0.97
MAX_DELETE = 0.5
#: Numbers (rows times dimensions) of a block of a group in near_duplicates(), and of a tile of scores.
BLOCK_NUMBERS, TILE_NUMBERS = 2_000_000, 4_000_000
MAX_TASKS = 10_000
GROUP_KEY, DUPLICATE_KEY = "doc.dedup_group", "doc.duplicate_of"

SCHEMAS = {
    "documents": "doc_id string, source_uri string, text string, content_hash string, metadata variant",
    "chunks": "chunk_id string, doc_id string, ordinal int, text string, start_char int, end_char int, token_count int, metadata variant",
    "embeddings": "chunk_id string, vector array<float>",
    "postings": "chunk_id string, length int, term string, tf int",
}
#: Every stored row also has the document it belongs to and the change that wrote it.
OWNER, CHANGE = "__doc", "__change"
DEAD = "name string, key string, change long"


class VectorStore(Protocol):
    """What retrieval asks of a store of vectors; all ids and vectors are DataFrames (chunk_id[, vector])."""

    def upsert_embeddings(self, rows: DataFrame, dim: int) -> None: ...

    def delete_embeddings(self, ids: DataFrame) -> None: ...

    def vectors(self, ids: DataFrame | None = None) -> DataFrame: ...

    def search(self, queries: DataFrame, k: int, ids: DataFrame | None = None) -> DataFrame: ...

    def count(self) -> int: ...


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new's keys exchanged for new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the one of the largest order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order)


def deleted(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without these documents, their chunks and the chunks' embeddings."""
    gone = chunks.join(doc_ids.select("doc_id"), "doc_id", "left_semi").select("chunk_id")
    return (
        documents.join(doc_ids.select("doc_id"), "doc_id", "left_anti"),
        chunks.join(doc_ids.select("doc_id"), "doc_id", "left_anti"),
        embeddings.join(gone, "chunk_id", "left_anti"),
    )


def changes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_uri, doc_id, status) of a full outer join by source_uri: added, updated, unchanged or deleted, by content_hash."""
    a = incoming.select("source_uri", F.col("doc_id").alias("new_id"), F.col("content_hash").alias("new_hash"))
    b = stored.select("source_uri", F.col("doc_id").alias("old_id"), F.col("content_hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("updated")
    return a.join(b, "source_uri", "full_outer").select("source_uri", F.coalesce("old_id", "new_id").alias("doc_id"), status.alias("status"))


def guarded(diff: DataFrame, stored: DataFrame, max_delete: float = MAX_DELETE) -> DataFrame:
    """Counts by status and whether more than max_delete of the stored documents would go."""
    if not 0 <= max_delete <= 1:
        raise ConfigError("max_delete must lie in [0, 1]", max_delete=max_delete)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = diff.agg(*[n(s) for s in ("added", "updated", "unchanged", "deleted")])
    return counts.crossJoin(stored.agg(F.count("*").alias("stored"))).withColumn("over_delete_guard", F.col("deleted") > F.lit(max_delete) * F.col("stored"))


def cache_misses(wanted: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(text_hash, text) of distinct texts (text) that the cache (model_id, text_hash, vector) lacks."""
    rows = wanted.select("text", T.fingerprint(F.col("text")).alias("text_hash")).groupBy("text_hash").agg(F.min("text").alias("text"))
    return rows.join(cache.where(F.col("model_id") == model).select("text_hash"), "text_hash", "left_anti")


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Vectors for texts (id, text) as (id, vector), and the rows (model_id, text_hash, vector) that the cache lacked. Each distinct text is embedded once."""
    fresh = cache_misses(texts, cache, model).select(F.lit(model).alias("model_id"), "text_hash", embed(F.col("text")).alias("vector"))
    known = cache.where(F.col("model_id") == model).select("model_id", "text_hash", "vector").unionByName(fresh)
    keyed = texts.select("id", T.fingerprint(F.col("text")).alias("text_hash"))
    return keyed.join(known, "text_hash").select("id", "vector"), fresh


def _ranks(values: list) -> np.ndarray:
    """Dense ranks of ids in Spark's order, nulls first (0)."""
    key = lambda v: (0,) if v is None else (1, *map(key, v.values())) if isinstance(v, dict) else (1, v)
    keys = [key(v) for v in values]
    place = {k: i for i, k in enumerate(sorted({(0,), *keys}))}
    return np.array([place[k] for k in keys], np.int64)


def _first_copies(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the rows, in order, whose id is smaller than those of all their copies before them: no other copy can win."""
    _, of = np.unique(vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    if len(starts) == len(of):
        return np.arange(len(of))
    kept = [order[starts]]
    for i, j in zip(starts, np.append(starts[1:], len(of)), strict=True):
        if j - i > 1:
            own = ids[order[i:j]]
            kept.append(order[i + 1 : j][own[1:] < np.minimum.accumulate(own)[:-1]])
    return np.sort(np.concatenate(kept))


def _winners(left: np.ndarray, left_docs: np.ndarray, right: np.ndarray, right_docs: np.ndarray, right_ids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of left the best row of right of a smaller document: (left's places, right's places, scores).

    A product of matrices rules out what cannot win; what is left is summed component by
    component, as T.dot() does, so equal vectors have equal scores. A score that is no
    number counts as the largest number, and wins last.
    """
    order = np.lexsort((right_ids, right_docs))
    if right.shape[1]:
        order = order[_first_copies(np.ascontiguousarray(right[order]), right_ids[order])]
    right, docs, ids = right[order].astype(np.float64), right_docs[order], right_ids[order]
    turn = np.argsort(left_docs, kind="stable")
    before = np.searchsorted(docs, left_docs[turn])
    turn, before = turn[before > 0], before[before > 0]
    with np.errstate(all="ignore"):
        slack = 4 * (right.shape[1] + 1) * np.finfo(float).eps
        norms = (right * right).sum(axis=1)
        reach = np.sqrt(norms[np.isfinite(norms)].max(initial=0.0))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, TILE_NUMBERS // max(1, len(right)))
        for at in range(0, len(turn), step):
            rows, until = turn[at : at + step], before[at : at + step]
            own = left[rows].astype(np.float64)
            scores = own @ right[: until[-1]].T
            ragged = np.arange(until[0], until[-1])
            scores[:, until[0] :][ragged[None, :] >= until[:, None]] = -np.inf
            error = slack * np.sqrt((own * own).sum(axis=1)) * reach
            top = scores.max(axis=1)
            least = np.where(np.isfinite(top), np.maximum(top, threshold), threshold) - np.where(np.isfinite(error), error, 0.0)
            if np.isfinite(top).all():
                some = np.flatnonzero(top >= least)
                r, c = np.nonzero(scores[some] >= least[some, None])
                r = some[r]
            else:  # every pair of such rows is summed
                r, c = np.nonzero((scores >= least[:, None]) | ~np.isfinite(scores) | ~np.isfinite(top)[:, None])
                inside = c < until[r]
                r, c = r[inside], c[inside]
            exact = np.zeros(len(r))
            for k in range(own.shape[1]):
                exact += own[r, k] * right[c, k]
            good = (exact >= threshold) | np.isnan(exact)
            r, c, exact = r[good], c[good], exact[good]
            best = np.lexsort((ids[c], -exact, r))
            best = best[np.flatnonzero(np.diff(r[best], prepend=-1))]
            out.append((rows[r[best]], order[c[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_duplicates(vectors: DataFrame, threshold: float = DUPLICATE, asked: Column | None = None) -> DataFrame:
    """(chunk_id, winner_id, score): for each of vectors (chunk_id, doc_id, grp, vector) the most similar chunk of an earlier document of its group.

    Rows compare only within their group, which the data opts into as a blocking key, and with
    vectors of their dimension; a winner's doc_id is smaller, ties go to the smaller chunk_id.
    Vectors that are null or hold a null have no winner and are none. With ``asked`` only rows
    that it is true of look for a winner. Exact: a group of more than BLOCK_NUMBERS numbers is
    dealt out to blocks and each pair of blocks is a task's product of matrices; small groups share tasks.
    """
    rows = vectors.where("doc_id is not null and grp is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = rows.select("chunk_id", "doc_id", "grp", "vector", F.size("vector").alias("dim"), F.coalesce(F.lit(True) if asked is None else asked, F.lit(False)).alias("asked"))
    sizes = rows.groupBy("grp", "dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"))
    blocks = F.ceil(F.col("n") * F.greatest("dim", F.lit(1)) / F.lit(BLOCK_NUMBERS)).cast("int")
    sizes = sizes.where("asked > 0 and n > 1").select("grp", "dim", "n", blocks.alias("blocks"))
    large = sizes.where("blocks > 1")  # a row for each BLOCK_NUMBERS of the table at most
    totals = sizes.agg(F.sum(F.col("n") * F.greatest("dim", F.lit(1))).alias("numbers"), F.coalesce(F.sum(F.when(F.col("blocks") > 1, F.col("blocks") * (F.col("blocks") + 1) / 2)), F.lit(0)).alias("cells")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tasks = max(4 * cores, 2 * ((totals["numbers"] or 0) // BLOCK_NUMBERS))
    if totals["cells"]:
        large = large.select(F.col("grp").alias("l_grp"), F.col("dim").alias("l_dim"), "blocks")
        rows = rows.join(F.broadcast(large), (F.col("grp") == F.col("l_grp")) & (F.col("dim") == F.col("l_dim")), "left").drop("l_grp", "l_dim")
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("int"))
    rows = rows.withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("chunk_id", "doc_id"), F.col("blocks"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    rows = rows.withColumn("other", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    share = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("grp", "dim"), F.lit(tasks))).otherwise(F.xxhash64("grp", "dim", "x", "y"))
    rows = rows.select(share.alias("share"), F.struct("grp", "dim", "x", "y").alias("cell"), "block", "asked", "chunk_id", "doc_id", "vector")
    rows = rows.repartition(int(min(MAX_TASKS, tasks + totals["cells"])), "share")
    kind = vectors.schema["chunk_id"].dataType
    schema, id_type = f"chunk_id {kind.simpleString()}, winner_id {kind.simpleString()}, score double", to_arrow_type(kind)

    def compare(share: pa.Table) -> pa.Table:
        members: dict = {}
        for place, cell in enumerate(share.column("cell").to_pylist()):
            members.setdefault(repr(cell), []).append(place)
        block, asked = (share.column(c).to_numpy() for c in ("block", "asked"))
        ids, docs = (_ranks(share.column(c).to_pylist()) for c in ("chunk_id", "doc_id"))
        vector = share.column("vector").combine_chunks()
        offsets = vector.offsets.to_numpy()
        flat = vector.values.to_numpy(zero_copy_only=False)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for own in members.values():
            if len(own) == 1:
                continue
            own = np.array(own)
            dim = offsets[own[0] + 1] - offsets[own[0]]
            matrix = flat[offsets[own][:, None] + np.arange(dim)]
            sides = [block[own] == b for b in np.unique(block[own])]
            for i, left in enumerate(sides):
                a, b = own[left & asked[own]], own[sides[-1 - i]]
                row, winner, score = _winners(matrix[left & asked[own]], docs[a], matrix[sides[-1 - i]], docs[b], ids[b], threshold)
                found.append((a[row], b[winner], score))
        row, winner, score = (np.concatenate(x) for x in zip(*found, strict=True))
        chunk = share.column("chunk_id")
        return pa.table({"chunk_id": chunk.take(pa.array(row)).cast(id_type), "winner_id": chunk.take(pa.array(winner)).cast(id_type), "score": pa.array(score)})

    pairs = rows.groupBy("share").applyInArrow(compare, schema)
    best = F.min(F.struct((-F.col("score")).alias("s"), "winner_id"))
    return pairs.groupBy("chunk_id").agg(best.alias("x")).select("chunk_id", "x.winner_id", (-F.col("x.s")).alias("score"))


class Store:
    """Current tables below a folder. embed is a Column function of the chunk text, model names it."""

    def __init__(self, spark: SparkSession, root: str, model: str = "hash-64", embed: Callable[[Column], Column] | None = None):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.embed = embed or (lambda c: T.hash_embedding(c, 64))
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _write(self, path: str, data: bytes) -> None:
        """All of a file or nothing of it; one that is there already is an error."""
        draft, at = self._path(f"{path}.{uuid.uuid4().hex}"), self._path(path)
        stream = self._fs.create(draft, False)
        stream.write(bytearray(data))
        stream.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            raise StoreError("the store changed meanwhile", path=path)

    def manifest(self) -> dict | None:
        """The current version: {"model", "revision", "parts"}; None for a new store."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return None
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
        return json.loads(self._read(f"{self.root}/manifests/{names[-1]}").decode()) if names else None

    def _rows(self, name: str) -> DataFrame:
        """The live rows of a table with owner and change."""
        found, schema = self.manifest(), f"{SCHEMAS[name]}, {OWNER} string, {CHANGE} long"
        parts = [p for p in (found or {"parts": []})["parts"] if name in p["tables"]]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p['folder']}/{name}" for p in parts])
        graves = [f"{self.root}/{p['folder']}/dead" for p in found["parts"] if "dead" in p["tables"]]
        if not graves:
            return rows
        dead = self.spark.read.schema(DEAD).parquet(*graves)
        last = lambda kind: dead.where(F.col("name") == kind).groupBy("key").agg(F.max("change").alias("until"))
        rows = rows.join(last("document"), (F.col(OWNER) == F.col("key")) & (F.col(CHANGE) < F.col("until")), "left_anti")
        if name == "embeddings":
            rows = rows.join(last("embedding"), (F.col("chunk_id") == F.col("key")) & (F.col(CHANGE) < F.col("until")), "left_anti")
        return rows

    def tables(self) -> dict[str, DataFrame]:
        return {k: self._rows(k).drop(OWNER, CHANGE) for k in SCHEMAS}

    def _publish(self, expected: dict | None, tables: dict[str, DataFrame], dead: DataFrame | None = None, whole: bool = False) -> dict:
        """Write a part of rows with owner, and tombstones (name, key), and list them. whole: nothing before it counts any more."""
        before = expected or {"model": self.model, "revision": 0, "parts": []}
        if before["model"] != self.model:
            raise ModelMismatch("the index was built with another model", built=before["model"], asked=self.model)
        change, folder = before["revision"] + 1, f"part-{uuid.uuid4().hex}"
        for k, rows in tables.items():
            columns = self.spark.createDataFrame([], SCHEMAS[k]).columns
            rows = rows.select(*columns, OWNER, F.lit(change).cast("long").alias(CHANGE))
            if k == "postings":  # so that a term's postings lie in few row groups
                rows = rows.repartitionByRange("term").sortWithinPartitions("term", "chunk_id")
            rows.write.parquet(f"{self.root}/{folder}/{k}")
        if dead is not None:
            dead.select("name", "key", F.lit(change).cast("long").alias("change")).write.parquet(f"{self.root}/{folder}/dead")
        part = {"folder": folder, "tables": [*tables, *(["dead"] if dead is not None else [])]}
        found = {"model": self.model, "revision": change, "parts": [part] if whole else [*before["parts"], part]}
        self._write(f"{self.root}/manifests/{change:012d}.json", json.dumps(found).encode())
        return found

    def ingest(self, documents: DataFrame, chunker=recursive_chunks, duplicate: float = DUPLICATE) -> dict:
        """Add or replace documents (doc_id, source_uri, text, metadata variant); those with unchanged text are left alone."""
        begun = self.manifest()
        rows = documents.select("doc_id", "source_uri", T.normalize_text(F.col("text")).alias("text"), T.content_hash(F.col("text")).alias("content_hash"), "metadata")
        known = self._rows("documents").select("doc_id", F.col("content_hash").alias("known"))
        fresh = rows.join(known, "doc_id", "left").where("known is null or known <> content_hash").drop("known").persist()
        try:
            n = fresh.count()
            if n:
                chunks = chunker(fresh.select("doc_id", "text")).withColumn("metadata", F.parse_json(F.lit("{}"))).persist()
                owned = chunks.withColumn(OWNER, F.col("doc_id"))
                vectors = owned.select("chunk_id", self.embed(F.col("text")).cast("array<float>").alias("vector"), OWNER)
                words = postings(chunks).join(owned.select("chunk_id", OWNER).distinct(), "chunk_id")
                dead = fresh.select(F.lit("document").alias("name"), F.col("doc_id").alias("key"))
                tagged = self._tagged(fresh, owned, vectors, duplicate)
                self._publish(begun, {"documents": fresh.withColumn(OWNER, F.col("doc_id")), "chunks": tagged, "embeddings": vectors, "postings": words}, dead)
                chunks.unpersist()
            return {"documents": n, "chunks": self._rows("chunks").count()}
        finally:
            fresh.unpersist()

    def _tagged(self, fresh: DataFrame, chunks: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
        """New chunks with the winner's id in their metadata where an earlier document of their group has nearly the same chunk."""
        group = F.try_variant_get("metadata", f'$["{GROUP_KEY}"]', "string").alias("grp")
        new = fresh.select("doc_id", group).where("grp is not null")
        kept = self._rows("documents").join(fresh.select("doc_id"), "doc_id", "left_anti").select("doc_id", group).join(new.select("grp").distinct(), "grp", "left_semi")
        old = self._rows("chunks").select("chunk_id", "doc_id", F.lit(0).alias("fresh")).join(kept, "doc_id").join(self._rows("embeddings").select("chunk_id", "vector"), "chunk_id")
        every = chunks.select("chunk_id", "doc_id", F.lit(1).alias("fresh")).join(new, "doc_id").join(vectors.select("chunk_id", "vector"), "chunk_id")
        every = old.unionByName(every).withColumn("doc_id", F.struct("fresh", "doc_id"))  # what is stored came before
        found = near_duplicates(every, threshold, F.col("doc_id.fresh") == 1).select("chunk_id", "winner_id")
        tag = F.to_json(F.create_map(F.lit(DUPLICATE_KEY), F.col("winner_id")))
        meta = F.when(F.col("winner_id").isNotNull(), F.parse_json(tag)).otherwise(F.col("metadata"))
        return chunks.join(found, "chunk_id", "left").withColumn("metadata", meta)

    def delete(self, doc_ids: DataFrame) -> int:
        """Remove documents; how many chunks went."""
        gone = self._rows("chunks").join(doc_ids.select("doc_id"), "doc_id", "left_semi").count()
        self._publish(self.manifest(), {}, doc_ids.select(F.lit("document").alias("name"), F.col("doc_id").alias("key")).distinct())
        return gone

    def sync(self, incoming: DataFrame, apply: bool = False, max_delete: float = MAX_DELETE) -> dict:
        """Differences to incoming documents, and with apply the store made equal; too many deletions are refused and write nothing."""
        stored = self._rows("documents")
        rows = incoming.withColumn("content_hash", T.content_hash(F.col("text")))
        diff = changes(rows, stored)
        report = guarded(diff, stored, max_delete).first().asDict()
        if apply:
            if report["over_delete_guard"]:
                raise StoreError("too many documents would be deleted", deleted=report["deleted"], stored=report["stored"])
            if report["deleted"]:
                self.delete(diff.where("status = 'deleted'").select("doc_id"))
            if report["added"] or report["updated"]:
                self.ingest(incoming)
        return report | {"applied": apply}

    def upsert_embeddings(self, rows: DataFrame, dim: int) -> None:
        """Replace vectors by chunk_id; wrong sizes and repeated ids fail before anything is published."""
        found = rows.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != dim).alias("bad")).first()
        if found["bad"] or found["n"] != found["ids"]:
            raise EmbeddingError("vectors differ in dimension or repeat an id", dim=dim, bad=found["bad"], rows=found["n"], ids=found["ids"])
        owner = self._rows("chunks").select("chunk_id", OWNER)
        vectors = rows.select("chunk_id", F.col("vector").cast("array<float>").alias("vector")).join(owner, "chunk_id", "left")
        self._publish(self.manifest(), {"embeddings": vectors}, rows.select(F.lit("embedding").alias("name"), F.col("chunk_id").alias("key")))

    def delete_embeddings(self, ids: DataFrame) -> None:
        """Tombstones for vectors; compact() takes them away."""
        self._publish(self.manifest(), {}, ids.select(F.lit("embedding").alias("name"), F.col("chunk_id").alias("key")).distinct())

    def compact(self, files: int | None = None) -> None:
        """Merge parts and tombstones into one part; what the tables hold stays."""
        begun = self.manifest()
        rows = {k: self._rows(k).drop(CHANGE) for k in SCHEMAS}
        self._publish(begun, {k: t.coalesce(files) if files and k != "postings" else t for k, t in rows.items()}, whole=True)

    def document(self, doc_id: str) -> DataFrame:
        return self.tables()["documents"].where(F.col("doc_id") == doc_id)

    def document_chunks(self, doc_id: str) -> DataFrame:
        return self.tables()["chunks"].where(F.col("doc_id") == doc_id).orderBy("ordinal")

    def documents_in_order(self) -> DataFrame:
        """All documents by doc_id; so are chunks_in_order() by document and ordinal, and embeddings by chunk."""
        return self.tables()["documents"].orderBy("doc_id")

    def chunks_in_order(self) -> DataFrame:
        return self.tables()["chunks"].orderBy("doc_id", "ordinal")

    def embeddings_in_order(self) -> DataFrame:
        return self.tables()["embeddings"].orderBy("chunk_id")

    def vectors(self, ids: DataFrame | None = None) -> DataFrame:
        rows = self.tables()["embeddings"]
        return rows if ids is None else rows.join(ids.select("chunk_id"), "chunk_id", "left_semi")

    def search(self, queries: DataFrame, k: int, ids: DataFrame | None = None) -> DataFrame:
        return dense(queries, self.vectors(), k, ids)

    def count(self) -> int:
        """Vectors that are not dead."""
        return self._rows("embeddings").count()

    def save_snapshot(self, path: str) -> dict:
        """The vectors as a table of their own with a manifest of model, dimension, revision, rows and a checksum that no order of rows changes."""
        found = self.manifest()
        if found is None:
            raise StoreError("there is nothing to save", store=self.root)
        version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
        self.vectors().write.parquet(version)
        made = {"model": self.model, "revision": found["revision"], "folder": version} | _checked(self.spark.read.schema(SCHEMAS["embeddings"]).parquet(version))
        self._write(f"{path.rstrip('/')}/{len(self._snapshots(path)):012d}.json", json.dumps(made).encode())
        return made

    def _snapshots(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(path)) if f.getPath().getName().endswith(".json"))

    def load_snapshot(self, path: str) -> DataFrame:
        """The newest snapshot's vectors; one of another model, an older revision or with other contents than it was saved with is an error."""
        names = self._snapshots(path)
        if not names:
            raise StoreError("there is no snapshot", path=path)
        made = json.loads(self._read(f"{path.rstrip('/')}/{names[-1]}").decode())
        if made["model"] != self.model:
            raise ModelMismatch("the snapshot was made with another model", built=made["model"], asked=self.model)
        if made["revision"] != (self.manifest() or {"revision": 0})["revision"]:
            raise StoreError("the snapshot is of another revision", saved=made["revision"])
        rows = self.spark.read.schema(SCHEMAS["embeddings"]).parquet(made["folder"])
        if _checked(rows) != {k: made[k] for k in ("rows", "dim", "checksum")}:
            raise StoreError("the snapshot is damaged", path=path)
        return rows


def _checked(rows: DataFrame) -> dict:
    got = rows.agg(F.count("*").alias("rows"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("dim"), F.sum(F.xxhash64("chunk_id", "vector").cast("decimal(38,0)")).alias("sum")).first()
    if got["least"] != got["dim"]:
        raise EmbeddingError("vectors differ in dimension", least=got["least"], most=got["dim"])
    return {"rows": got["rows"], "dim": got["dim"], "checksum": str(got["sum"])}
