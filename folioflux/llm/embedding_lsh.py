"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on random Gaussian directions and quantised in steps of
``width``; ``hashes`` such numbers make a bucket, in each of several tables. Vectors that
share a bucket are compared by cosine in double precision. Vectors that are equal form one
class first. A pair counts in the first table in which it shares a bucket, so links are
counted without listing them; buckets beyond ``tile`` classes are split into blocks, every
two of which meet in a tile of their own. Only numbers are shuffled until the buckets of two
classes or more are known; vectors travel once, in the precision they came in.

The number of hashes follows the number of classes, that of tables the wanted recall at
the threshold itself; closer pairs are found more surely.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, and neither do vectors of different lengths; rows with a null vec_id
take no part and have a null component; each row is a vector, also where rows repeat; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import components, dropped, written

THRESHOLD = 0.9
RECALL = 0.98
WIDTH = 2.0
#: Classes that a bucket holds by chance, about.
LOAD = 16
#: Classes of a bucket that are compared in one tile.
TILE = 2048
SEED = 11


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection agrees for vectors at this distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """(hashes, tables) for n classes."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    hashes = max(4, math.ceil(math.log(max(2.0, n / LOAD)) / -math.log(far)))
    return hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))


def buckets(vectors: np.ndarray, hashes: int, tables: int, width: float = WIDTH) -> np.ndarray:
    """A 64-bit bucket for each vector (row) and table.

    Vectors and directions are rounded to integers small enough for exact sums in
    doubles, so a vector gets the same buckets wherever it is hashed.
    """
    dim = vectors.shape[1]
    rng = np.random.default_rng([SEED, dim, hashes, tables])
    directions = np.rint(rng.standard_normal((dim, hashes * tables)) * 2**10)
    offsets = rng.uniform(0, width, hashes * tables)
    fixed = np.rint(vectors / np.abs(vectors).max(1, keepdims=True) * 2**18)
    unit = np.rint(fixed / np.sqrt((fixed * fixed).sum(1, keepdims=True)) * 2**15)
    steps = np.floor((unit @ directions / 2.0**25 + offsets) / width).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, hashes)
    out = np.full((len(vectors), tables), dim, np.uint64)
    for k in range(hashes):
        out = (out ^ steps[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _precision(rows: DataFrame) -> type:
    """What a component of the vectors is held as: single precision where they come in it."""
    return np.float32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64


def _matrix(data: list[bytes], precision: type) -> np.ndarray:
    return np.frombuffer(b"".join(data), precision).reshape(len(data), -1).astype(np.float64)


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    sizes = np.array([len(x) for x in column.to_pylist()], int)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def packed(rows: DataFrame) -> DataFrame:
    """(vec_id, cls, vec): the vector's components as bytes and a hash of them; both null where it links with nothing."""
    kind, precision = rows.schema["vec_id"].dataType.simpleString(), _precision(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, vec = [], []
            for row_id, value in zip(batch.column(0), batch.column(1), strict=True):
                v = value.values if value.is_valid else None
                data = None
                if row_id.is_valid and v is not None and len(v) and not v.null_count:
                    a = v.to_numpy(zero_copy_only=False).astype(precision) + precision(0)
                    if np.isfinite(a).all() and a.any():
                        data = a.tobytes()
                vec.append(data)
                cls.append(None if data is None else int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(vec, pa.binary())], ["vec_id", "cls", "vec"])

    return rows.select("vec_id", "embedding").mapInArrow(pack, f"vec_id {kind}, cls long, vec binary")


def placed(classes: DataFrame, hashes: int, tables: int, precision: type, width: float = WIDTH) -> DataFrame:
    """Rows (t, bucket, cls), one for each class and table."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                for rows in _by_length(batch.column(1)):
                    part = batch.take(pa.array(rows))
                    found = buckets(_matrix(part.column(1).to_pylist(), precision), hashes, tables, width)
                    again = pa.array(np.tile(np.arange(len(rows)), tables))
                    cols = [pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(rows))), pa.array(found.T.reshape(-1)), part.column(0).take(again)]
                    yield pa.RecordBatch.from_arrays(cols, ["t", "bucket", "cls"])

    return classes.select("cls", "vec").mapInArrow(place, "t int, bucket long, cls long")


def compared(tiles: DataFrame, hashes: int, tables: int, precision: type, threshold: float = THRESHOLD, width: float = WIDTH) -> DataFrame:
    """Rows (cls, add, other): what a tile adds to a class's links, and a spanning forest of the tile's links.

    tiles: (t, bucket, i, j, side, cls, size, vec), sorted so that tiles stand together.
    """

    def judge(t: int, i: int, j: int, rows: list) -> tuple[list, list, list]:
        side = np.array([r[0] for r in rows])
        cls, size = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        v = _matrix([r[3] for r in rows], precision)
        scaled = v / np.abs(v).max(1, keepdims=True)
        norm = np.sqrt((scaled * scaled).sum(1))
        add = np.zeros(len(rows), np.int64)
        parent = list(range(len(rows)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        own, linked = None, []
        for begin in range(0, len(rows), 256):
            cos = (scaled[begin : begin + 256] @ scaled.T) / (norm[begin : begin + 256, None] * norm)
            a, b = np.nonzero(cos >= threshold)
            a += begin
            good = a < b if i == j else (side[a] == i) & (side[b] == j)
            a, b = a[good], b[good]
            if not len(a):
                continue
            if t:
                own = buckets(v, hashes, tables, width)[:, :t] if own is None else own
                fresh = np.ones(len(a), bool)
                for k in range(0, len(a), 1 << 16):
                    fresh[k : k + (1 << 16)] = ~(own[a[k : k + (1 << 16)]] == own[b[k : k + (1 << 16)]]).any(1)
                a, b = a[fresh], b[fresh]  # the others were joined in an earlier table
            np.add.at(add, a, size[b])
            np.add.at(add, b, size[a])
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[ry] = rx
                    linked.append((x, y))
        out = [(int(cls[x]), int(add[x]), None) for x in np.flatnonzero(add)]
        out += [(int(cls[x]), 0, int(cls[y])) for x, y in linked]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def send(out: list) -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cls", "add", "other"])

        for batch in batches:
            out = []
            for t, bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, bucket, i, j) != current:
                    if len(rows) > 1:
                        out += judge(current[0], current[2], current[3], rows)
                    current, rows = (t, bucket, i, j), []
                rows.append(row)
            yield send(out)
        if len(rows) > 1:
            yield send(judge(current[0], current[2], current[3], rows))

    keys = ["t", "bucket", "i", "j"]
    return tiles.select(*keys, "side", "cls", "size", "vec").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "cls long, add long, other long")


def classes(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, tile: int = TILE) -> DataFrame:
    """One row for each row of rows (vec_id, embedding): vec_id, n_links, component_id, kept."""
    vectors = packed(rows)
    grouped = vectors.where("cls is not null").groupBy("cls").agg(F.count("*").alias("size"), F.min("vec_id").alias("rep"), F.first("vec").alias("vec"))
    nodes, _ = written(grouped, "vectors")
    hashes, tables = shape(nodes.count(), threshold, recall, width)
    precision = _precision(rows)

    ids, ids_path = written(placed(nodes, hashes, tables, precision, width), "buckets")
    shared = ids.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select("t", "bucket", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    spread = ids.join(shared, ["t", "bucket"]).withColumn("side", F.pmod("cls", "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = spread.select("t", "bucket", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "cls").join(nodes.select("cls", "size", "vec"), "cls")
    found, _ = written(compared(tiles, hashes, tables, precision, threshold, width), "links")
    dropped(rows.sparkSession, ids_path)

    counts = found.groupBy("cls").agg(F.sum("add").alias("add"))
    comps = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    known = nodes.select("cls", "size", "rep").join(counts, "cls", "left").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    known = known.withColumn("component", F.coalesce("component", "cls"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select("cls", (F.col("size") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), "component_id")
    out = vectors.select("vec_id", "cls").join(known, "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
