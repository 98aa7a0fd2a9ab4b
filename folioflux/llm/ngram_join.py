"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

Texts with the same set are one class. Every class goes to the tiles of its prefix: the
share of its rarest shingles of which a linked class must hold one. A tile is a shingle and
a band of set sizes; a class stands in its own band's tile, and in the next band's if sizes
there may link with it. Within a tile, sorted by size, only sizes within the threshold
meet; hashed bitmaps bound each pair's overlap from above (bits that differ are in one set
only), and pairs that pass are decided by exact intersection of the sorted sets. Rarity comes
from a table of shingle counts over all documents, of fixed size.

Pairs whose bitmaps allow a link join classes into clusters; a large tile gives a
spanning forest of such pairs, not all of them. Only texts in clusters are read again for
their exact sets, which meet within their cluster, block by block; each block gives a
spanning forest of its links. Large tiles are split into blocks of classes as well, every
two of which meet. So no group is expanded into all its pairs, and no task holds more than
two blocks.

Sets are held as 64-bit hashes; two texts are taken for one class, or two shingles for one,
wrongly with probability about n * n / 2**65.

Defined results: null and empty texts, and those without words, have size 0 and link with
nothing; rows with a null doc_id link with nothing and have a null component; a row is
judged by its own text, also where rows repeat a doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import components, dropped, written
from folioflux.llm.shingles import DENOMINATOR, NUMERATOR, fingerprint, mixed, shingle_set

#: Counters of the shingle table, and how many stand in one of its pieces.
COUNTERS, PIECE = 1 << 16, 1 << 12
#: Classes of a task's texts that are remembered, so that copies aren't sent again; only a saving.
SEEN = 1 << 20
#: Classes of a tile whose pairs are listed at once.
SMALL = 8
#: Classes of a block of a large tile, and the size from which on a tile is split before its rows meet.
TILE = 512
#: Keys of large tiles that are broadcast at most; more are joined by shuffles.
BROADCAST_KEYS = 500_000
#: Hashes of a block of a cluster.
BLOCK = 1 << 22
#: Bits of the filter that spares most texts their second reading; only a saving.
FILTER = 1 << 22


#: What tells the tiles of a shingle in different bands apart.
_BANDS = mixed(np.arange(1, 34, dtype=np.uint64))


def linked_sizes(overlap, a, b):
    """Whether two sets of sizes a and b link, given their overlap."""
    return DENOMINATOR * overlap >= NUMERATOR * (a + b - overlap)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def signatures(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Rows (doc_id, n, fp, bits) as a written table, and the counts of all documents' shingles by their top bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else None

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            n, fp, bits, waiting, held = [], [], [], [], 0
            for text in batch.column(1):
                h = shingle_set(text.as_py())
                n.append(len(h))
                fp.append(fingerprint(h) if len(h) else None)
                bits.append(bitmap(h) if len(h) else None)
                waiting.append(h)
                held += len(h)
                if held > 1 << 20:
                    counts += np.bincount(_slots(np.concatenate(waiting)), minlength=COUNTERS)
                    waiting, held = [], 0
            if waiting:
                counts += np.bincount(_slots(np.concatenate(waiting)), minlength=COUNTERS)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], ["doc_id", "n", "fp", "bits", "slot", "counts"]
            )
            last = batch.column(0).type
            del waiting
        if counts.any():
            m = COUNTERS // PIECE
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, id_type or last), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range(m), pa.int32()), pa.array([x.tobytes() for x in counts.reshape(m, PIECE)], pa.binary())],
                ["doc_id", "n", "fp", "bits", "slot", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[slot] = total.get(slot, 0) + np.frombuffer(data.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slot", "counts"])

    rows, _ = written(docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n long, fp long, bits binary, slot int, counts binary"), "shingles")
    pieces = rows.where("slot is not null").select("slot", "counts").repartition(COUNTERS // PIECE, "slot").mapInArrow(add, "slot int, counts binary").collect()
    counts = np.zeros((COUNTERS // PIECE, PIECE), np.int64)
    for piece in pieces:  # a table of fixed size
        counts[piece["slot"]] = np.frombuffer(piece["counts"], np.int64)
    return rows.where("slot is null").select("doc_id", "n", "fp", "bits"), counts.reshape(-1)


def bands(n: int) -> range:
    """The size bands whose tiles a set of n goes to: its own, and the next where a larger set that links with it may stand."""
    own = (n.bit_length() - 1) // 2
    return range(own, ((n * DENOMINATOR // NUMERATOR).bit_length() - 1) // 2 + 1)


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Rows (key, n, fp): the tiles of every class, one of which any linked class shares.

    A link needs an overlap of at least 75 % of either set, so of the n shingles in
    order of rarity the first n - ceil(0.75 n) + 1 are enough.
    """
    small = counts.astype(np.float64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            key, size, owner, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                cols = [np.concatenate(key).view(np.int64), np.concatenate(size), np.concatenate(owner)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "n", "fp"])

            for text in batch.column(0):
                h = shingle_set(text.as_py())
                n = len(h)
                if not n or (fp := fingerprint(h)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                take = n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1
                order = np.lexsort((h, small[_slots(h)]))[:take] if take < n else slice(None)
                for b in bands(n):
                    key.append(mixed(h[order] + _BANDS[b]))
                    size.append(np.full(take, n, np.int64))
                    owner.append(np.full(take, fp, np.int64))
                    held += take
                if held > 100_000:
                    yield out()
                    key, size, owner, held = [], [], [], 0
            if key:
                yield out()

    return docs.select("text").mapInArrow(pick, "key long, n long, fp long")


def shared(rows: DataFrame) -> DataFrame:
    """What tiles of two classes or more give: rows (pair, key, n, fp).

    A small tile gives its pairs of suitable sizes, as (true, other, n, fp), a larger one its
    classes. Streams over rows sorted by key and size, and holds the rows of a small tile at most.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, large, out = None, [], False, []

        def close() -> None:
            for k, (n, fp) in enumerate(held):
                out.extend((True, other, n, fp) for m, other in held[:k] if DENOMINATOR * m >= NUMERATOR * n)

        def send() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["pair", "key", "n", "fp"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, size, owner = (batch.column(k).to_numpy() for k in range(3))
            same = key[1:] == key[:-1]
            worth = np.append(same, True) | np.append(True, same)  # both ends may go on in other batches
            for at, n, fp in zip(key[worth].tolist(), size[worth].tolist(), owner[worth].tolist(), strict=True):
                if at != current:
                    if not large:
                        close()
                    current, held, large = at, [], False
                if held and held[-1] == (n, fp):
                    continue
                if large:
                    held = [(n, fp)]
                    out.append((False, current, n, fp))
                    continue
                held.append((n, fp))
                if len(held) > SMALL:
                    large = True
                    out.extend((False, current, *x) for x in held)
                    held = held[-1:]
            yield send()
        if not large:
            close()
        yield send()

    return rows.repartition("key").sortWithinPartitions("key", "n", "fp").mapInArrow(meet, "pair boolean, key long, n long, fp long")


def bits_of(n: int) -> int:
    return min(1 << 16, max(64, 1 << int(2 * n - 1).bit_length()))


def bitmap(h: np.ndarray) -> bytes:
    """A bit for each hash, in a map of about two to four bits a shingle; halves can be folded onto each other."""
    flags = np.zeros(bits_of(len(h)), bool)
    flags[(h & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def overlap_bound(a: int, a_bits: int, a_n: int, b: int, b_bits: int, b_n: int) -> int:
    """Upper bound of the overlap of two sets of a_n and b_n members from their bitmaps as integers."""
    while a_bits > b_bits:
        a_bits //= 2
        a = (a & ((1 << a_bits) - 1)) | (a >> a_bits)
    while b_bits > a_bits:
        b_bits //= 2
        b = (b & ((1 << b_bits) - 1)) | (b >> b_bits)
    only_a, only_b = (a & ~b).bit_count(), (b & ~a).bit_count()
    return min(a_n - only_a, b_n - only_b)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps allow a link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, x, n, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                most = overlap_bound(int.from_bytes(x, "little"), 8 * len(x), m, int.from_bytes(y, "little"), 8 * len(y), n)
                keep.append(linked_sizes(most, m, n))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    known = nodes.select("fp", "n", "bits")
    rows = pairs.join(known.withColumnsRenamed({"fp": "a", "n": "m", "bits": "x"}), "a").join(known.withColumnsRenamed({"fp": "b", "bits": "y"}), "b")
    return rows.select("a", "b", "m", "x", "n", "y").mapInArrow(bound, "a long, b long")


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (fp, hashes) of the wanted (doc_id, fp), as a written table. Most other texts are passed over by a filter of fixed size."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    pieces = 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found.setdefault(x // (FILTER // pieces), np.zeros(FILTER // pieces, bool))[x % (FILTER // pieces)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], ["piece", "flags"])

    slots = wanted.select(slot.alias("slot")).distinct().withColumn("piece", F.floor(F.col("slot") / (FILTER // pieces)).cast("int"))
    flags = np.zeros((pieces, FILTER // pieces), bool)
    for row in slots.repartition(pieces, "piece").select("slot").mapInArrow(mark, "piece int, flags binary").collect():  # half a megabyte in all
        flags[row["piece"]] |= np.unpackbits(np.frombuffer(row["flags"], np.uint8)).astype(bool)
    shared_flags = docs.sparkSession.sparkContext.broadcast(np.packbits(flags.reshape(-1)).tobytes())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(shared_flags.value, np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(known[batch.column(1).to_numpy()]))
            found = [shingle_set(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(h) if len(h) else None for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["doc_id", "fp", "hashes"]
            )

    rows = docs.where("doc_id is not null").select("doc_id", slot.alias("slot"), "text").mapInArrow(build, f"doc_id {kind}, fp long, hashes binary")
    rows = rows.join(wanted.select("doc_id", "fp").distinct(), ["doc_id", "fp"], "left_semi").select("fp", "hashes")
    return written(rows, "sets")[0].dropDuplicates(["fp"])


def forest(tiles: DataFrame, nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) that join the classes of each tile (key, n, fp), with bits from nodes (fp, bits), wherever sizes and bitmaps allow a link, as a spanning forest.

    Tiles beyond ``tile`` classes are split into blocks, every two of which meet. A block pair
    streams in order of size, and only classes within the size band of the one at hand are held.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, groups = None, []
        for batch in batches:
            left, right = [], []
            for *key, n, fp, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    current, groups = key, []
                here, width = int.from_bytes(bits, "little"), 8 * len(bits)
                merged, others = [], []
                for group in groups:
                    if DENOMINATOR * group[0][0] < NUMERATOR * n:
                        group = [g for g in group if DENOMINATOR * g[0] >= NUMERATOR * n]
                    found = next((g for g in reversed(group) if linked_sizes(overlap_bound(g[2], g[3], g[0], here, width, n), g[0], n)), None)
                    if found:
                        left.append(found[1])
                        right.append(fp)
                        merged += group
                    elif group:
                        others.append(group)
                merged.sort(key=lambda g: g[0])
                groups = [*others, [*merged, (n, fp, here, width)]]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    large = tiles.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks")).where("blocks > 1")
    large, _ = written(large, "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    rows = paired(tiles.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))).join(nodes.select("fp", "bits"), "fp")
    keys = ["key", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "fp").select(*keys, "n", "fp", "bits").mapInArrow(join, "a long, b long").distinct()


def paired(rows: DataFrame) -> DataFrame:
    """rows (fp, blocks, ...) with i <= j, once for each pair of blocks that a row's own block stands in."""
    rows = rows.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o"))


def linked(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) within each cluster (cluster, fp, hashes) by exact intersection, as a spanning forest of every two blocks.

    A set is compared with the sets of each group so far, the nearest sizes first, until one links.
    """

    def judge(rows: list) -> Iterator[tuple[int, int]]:
        groups: list[list] = []
        for n, fp, h in sorted(((len(h) // 8, fp, np.frombuffer(h, np.uint64)) for fp, h in rows), key=lambda r: r[:2]):
            joined, others = [], []
            for group in groups:
                for m, other, h2 in reversed(group):
                    if DENOMINATOR * m < NUMERATOR * n:
                        others.append(group)
                        break
                    if linked_sizes(len(np.intersect1d(h, h2, assume_unique=True)), n, m):
                        joined.append(group)
                        yield other, fp
                        break
                else:
                    others.append(group)
            merged = sorted((g for group in joined for g in group), key=lambda g: g[0]) if len(joined) > 1 else [g for group in joined for g in group]
            groups = [*others, [*merged, (n, fp, h)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def send(out: list) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

        for batch in batches:
            out = []
            for cluster, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, i, j) != current:
                    out += judge(rows)
                    current, rows = (cluster, i, j), []
                rows.append(row)
            yield send(out)
        yield send(list(judge(rows)))

    blocks = members.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("hashes")) / (8 * block)).cast("int").alias("blocks"))
    keys = ["cluster", "i", "j"]
    rows = paired(members.join(blocks, "cluster")).select(*keys, "fp", "hashes")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    signed, counts = signatures(docs)
    nodes = signed.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bits").alias("bits"))
    nodes, _ = written(nodes, "classes")
    rows, rows_path = written(prefixes(docs.where("doc_id is not null"), counts), "prefixes")
    # A tile that is large by itself goes past the task that sorts out the small ones.
    hot, hot_path = written(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > TILE).select("key"), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    met, _ = written(shared(rows.join(hot, "key", "left_anti")).unionByName(rows.join(hot, "key", "left_semi").distinct().select(F.lit(False).alias("pair"), "key", "n", "fp")), "tiles")
    dropped(docs.sparkSession, rows_path, hot_path)
    tiles = met.where("not pair").select("key", "fp", "n")
    pairs = met.where("pair").select(F.col("key").alias("a"), F.col("fp").alias("b")).distinct()
    clusters, _ = written(components(possible(pairs, nodes).union(forest(tiles, nodes))).withColumnsRenamed({"node": "fp", "component": "cluster"}), "clusters")
    exact = sets(docs, clusters.join(nodes, "fp").select(F.col("rep").alias("doc_id"), "fp"))
    whole = components(linked(clusters.join(exact, "fp"))).withColumnRenamed("node", "fp")
    by_class = nodes.join(whole, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = by_class.join(least, "component").select("fp", "component_id")
    out = signed.drop("bits").join(by_class, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns as they were: those with the group's smallest doc_id in one of their rows; rows with a null doc_id stay."""
    gone = classes(docs).groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("hi < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
