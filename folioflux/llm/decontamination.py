"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every training passage is a query. An item's score is BM25 over the passage's distinct
terms, as a share of what the item itself would get, so the threshold means the
same for every item. Ranges of items whose block maxima cannot reach the threshold are
passed over for whole passages first; the rest is searched document at a time with pivots and
block maxima. Items over the threshold are verified: at least ``containment`` of the
item's five-word shingles, and at least ``part`` of those of its question and of
its answer, must stand in the passage. The question ends with the last question mark,
or else with the first half of the words; the answer is the rest.

Passages are twice as long as the longest item of a length class and start every
length of such an item, so an item of the class lies whole in one of them. The index is
broadcast in shards of bounded size, SHARDS of them for each pass over the documents;
statistics cover all items.

Defined results: null and empty texts and items hold nothing and match nothing; items of
fewer than five words are one shingle; repeated items match each by themselves; of equal
scores of an item in a document the first passage counts; rows with a null doc_id may match
and keep the null; empty tables give an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.5
CONTAINMENT, PART = 0.75, 0.5
SHINGLE = 5
#: Postings of a shard of the index at most, about: the bound of what is broadcast.
MAX_POSTINGS = 400_000
#: Shards that one pass over the documents searches; each task holds one at a time.
SHARDS = 8
#: Ranges of items for whole passages, and postings of a block.
RANGES, BLOCK = 32, 16
#: Tokens that are scored together.
TOKENS = 200_000

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in _TABLE)


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of any other characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def shingles(words: list) -> set:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} or ({tuple(words)} if words else set())


def split(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    head, mark, tail = text.rpartition("?")
    if mark and tokens(tail) and tokens(head):
        return tokens(head), tokens(tail)
    words = tokens(text)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


class Band:
    """The index of the items of one length class."""

    def __init__(self, length: int, postings: dict[int, list[tuple[int, float]]], n_items: int, n_terms: int):
        self.length, self.n_items = length, n_items
        self.width = max(1, -(-n_items // RANGES))
        self.bound = np.zeros((n_terms, RANGES), np.float32)
        self.postings, self.most = {}, {}
        for term, found in postings.items():
            found.sort()
            items, weights = [i for i, _ in found], [w for _, w in found]
            for i, w in found:
                self.bound[term, i // self.width] = max(self.bound[term, i // self.width], w)
            ends = list(range(BLOCK, len(items), BLOCK)) + [len(items)]
            blocks = [(items[e - 1], max(weights[s:e])) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            self.postings[term] = (items, weights, blocks)
            self.most[term] = max(weights)
        self.has = self.bound.any(1)

    def search(self, terms: list[int], low: int, high: int, threshold: float) -> list[tuple[int, float]]:
        """Items in [low, high) that score the threshold or more, by block-max WAND."""
        cursors = []  # item, position, term
        for t in terms:
            items = self.postings[t][0]
            at = int(np.searchsorted(items, low)) if low else 0
            if at < len(items) and items[at] < high:
                cursors.append([items[at], at, t])
        found = []

        def advance(c: list, to: int) -> bool:
            """Move to the first posting at or after an item; whether there is one."""
            items = self.postings[c[2]][0]
            at = c[1]
            while at < len(items) and items[at] < to:
                at += 1
            c[1] = at
            c[0] = items[at] if at < len(items) else high
            return c[0] < high

        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, leap = 0.0, high
            for c in cursors[: pivot + 1]:
                last, most = self.postings[c[2]][2][c[1] // BLOCK] if c[0] == item else self._block(c[2], c[1], item)
                bound += most
                leap = min(leap, last + 1)
            if bound < threshold:
                # nothing before the nearest end of a block, or the next cursor, can reach it
                if pivot + 1 < len(cursors):
                    leap = min(leap, cursors[pivot + 1][0])
                to = max(leap, item + 1)
                cursors = [c for k, c in enumerate(cursors) if k > pivot or advance(c, to)]
            elif cursors[0][0] == item:
                score = sum(self.postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                cursors = [c for k, c in enumerate(cursors) if k > pivot or advance(c, item + 1)]
            else:
                cursors = [c for c in cursors if c[0] >= item or advance(c, item)]
        return found

    def _block(self, term: int, at: int, item: int) -> tuple[int, float]:
        """The block that holds an item or the next one after it; one that ends at the range's end otherwise."""
        blocks = self.postings[term][2]
        for k in range(at // BLOCK, len(blocks)):
            if blocks[k][0] >= item:
                return blocks[k]
        return (1 << 62, 0.0)


class Index:
    """A shard: items with their words, terms, and a Band for each length class."""

    def __init__(self, items: list[tuple[object, str]], df: dict[str, int], n: int, average: float):
        self.terms: dict[bytes, int] = {}
        self.items: dict[tuple[int, int], tuple] = {}
        grouped = defaultdict(list)
        for item_id, text in items:
            words = tokens(text)
            grouped[max(16, 1 << (len(words) - 1).bit_length())].append((item_id, text, words))
        made = []
        for length, rows in sorted(grouped.items()):
            postings: dict[int, list] = defaultdict(list)
            for k, (item_id, text, words) in enumerate(rows):
                counts: dict[bytes, int] = {}
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
                weight = {}
                for w, tf in counts.items():
                    d = df[w.decode("utf-8", "surrogatepass")]
                    weight[w] = math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
                own = sum(weight.values())
                for w, x in weight.items():
                    postings[self.terms.setdefault(w, len(self.terms))].append((k, x / own))
                question, answer = split(text)
                self.items[length, k] = (item_id, shingles(words), shingles(question), shingles(answer))
            made.append((length, postings, len(rows)))
        self.bands = [Band(length, postings, count, len(self.terms)) for length, postings, count in made]


def shards(benchmark: DataFrame, max_postings: int = MAX_POSTINGS) -> Iterator[Index]:
    """The index in shards of about max_postings each; document frequencies and lengths are those of all items."""
    spread = benchmark.select("item_id", "text").where("text is not null")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                if words:
                    distinct = sorted(set(words))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w.decode("utf-8", "surrogatepass") for w in distinct], pa.string()), pa.array([len(words)] + [0] * (len(distinct) - 1), pa.int64()), pa.array([1] + [0] * (len(distinct) - 1), pa.int64())],
                        ["term", "words", "items"],
                    )

    rows = spread.select("text").mapInArrow(terms, "term string, words long, items long")
    counts = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("words").alias("words"), F.sum("items").alias("items"))
    total = counts.agg(F.sum("df").alias("postings"), F.sum("words").alias("words"), F.sum("items").alias("items")).first()
    if not total["items"]:
        return
    n_shards = -(-total["postings"] // max_postings)
    kept = spread.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)))
    for shard in range(n_shards):
        items = [(r["item_id"], r["text"]) for r in kept.where(F.col("shard") == shard).orderBy("item_id", "text").collect() if tokens(r["text"])]
        wanted = {w for _, text in items for w in tokens(text)}
        if n_shards == 1:
            df = {r["term"]: r["df"] for r in counts.select("term", "df").collect()}
        else:
            words = benchmark.sparkSession.createDataFrame([(w.decode("utf-8", "surrogatepass"),) for w in sorted(wanted)], "term string")
            df = {r["term"]: r["df"] for r in counts.join(words, "term").select("term", "df").collect()}
        if items:
            yield Index(items, df, total["items"], total["words"] / total["items"])


def search(docs: DataFrame, indexes: list[Index], item_type: DataType, threshold: float = THRESHOLD, containment: float = CONTAINMENT, part: float = PART) -> DataFrame:
    """Verified matches of some shards in one pass: (doc_id, item_id, score, start_word, overlap, question_overlap, answer_overlap)."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(cloudpickle.dumps(index)) for index in indexes]

    def scan(held: Index, ids: list, texts: list[list[bytes]]) -> list[tuple]:
        get = held.terms.get
        numbers = [np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)) for words in texts]
        best: dict[tuple[int, int, int], tuple] = {}
        sizes = np.array([len(x) for x in numbers])
        owner = np.repeat(np.arange(len(ids)), sizes)
        every = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        place = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else every
        for band in held.bands:
            use = np.flatnonzero(every >= 0)
            use = use[band.has[every[use]]]
            if not len(use):
                continue
            first = np.concatenate(([0], np.cumsum(sizes // band.length + 1)))
            p = first[owner[use]] + place[use] // band.length
            back = place[use] >= band.length
            key = np.unique(np.concatenate((p, p[back] - 1)) * len(held.terms) + np.concatenate((every[use], every[use][back])))
            passage, term = key // len(held.terms), key % len(held.terms)
            starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            bound = np.add.reduceat(band.bound[term], starts)
            ends = np.append(starts[1:], len(key))
            for r in np.flatnonzero((bound >= threshold - 1e-4).any(1)):
                terms = term[starts[r] : ends[r]].tolist()
                ranges = np.flatnonzero(bound[r] >= threshold - 1e-4)
                at = int(passage[starts[r]])
                d = int(np.searchsorted(first, at, "right") - 1)
                begin = (at - int(first[d])) * band.length
                here = None
                for g in ranges.tolist():
                    for item, score in band.search(terms, g * band.width, min(band.n_items, (g + 1) * band.width), threshold):
                        if here is None:
                            here = shingles(texts[d][begin : begin + 2 * band.length])
                            short = set(texts[d][begin : begin + 2 * band.length])
                        item_id, whole, question, answer = held.items[band.length, item]
                        share = [_share(x, here, texts[d][begin : begin + 2 * band.length], short) for x in (whole, question, answer)]
                        if share[0] >= containment and share[1] >= part and share[2] >= part:
                            k = (d, band.length, item)
                            if k not in best or score > best[k][2]:
                                best[k] = (ids[d], item_id, score, begin, *share)
        return list(best.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        one = pickle.loads(shared[0].value) if len(shared) == 1 else None  # else a shard is unpacked for each group of texts, and only one is held
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(tokens(text.as_py()))
                held += len(texts[-1])
                if held > (TOKENS if one else 4 * TOKENS):
                    for index in shared:
                        yield send(scan(one or pickle.loads(index.value), ids, texts))
                    ids, texts, held = [], [], 0
        if ids:
            for index in shared:
                yield send(scan(one or pickle.loads(index.value), ids, texts))

    names = ["doc_id", "item_id", "score", "start_word", "overlap", "question_overlap", "answer_overlap"]
    types = [to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(item_type), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs, item_type))


def _schema(docs: DataFrame, item_type: DataType) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, score double, start_word long, overlap double, question_overlap double, answer_overlap double"


def _share(part: set, here: set, words: list, short: set) -> float:
    """Share of an item's shingles in a passage; a shorter one must stand as a run of words."""
    if not part:
        return 1.0
    one = next(iter(part))
    if len(one) == SHINGLE:
        return len(part & here) / len(part)
    k = len(one)
    return float(short.issuperset(one) and any(tuple(words[i : i + k]) == one for i in range(len(words) - k + 1)))


def matches(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """Verified matches of all items in all of docs, one row for each row of docs and item."""
    item_type = benchmark.schema["item_id"].dataType
    every = shards(benchmark, limits.pop("max_postings", MAX_POSTINGS))
    found = docs.sparkSession.createDataFrame([], _schema(docs, item_type))
    while group := list(islice(every, SHARDS)):
        found = found.unionByName(search(docs, group, item_type, **limits))
    return found


def cleaned(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of docs whose doc_id no verified match has, all columns as they were."""
    bad = matches(docs, benchmark, **limits).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
