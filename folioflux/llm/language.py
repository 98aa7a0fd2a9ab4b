"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample text; a document is
encoded with every dictionary, and the language whose dictionary gives the fewest
bytes wins. A document whose two best languages lie within a relative margin is
rejected.

Where the fewest bytes are below RESOLVED, one byte is more than the margin, and whole
bytes decide nothing: there the size is the ideal code length in fractions of bits under
a byte model of orders 1 to ORDER counted on the same dictionaries, and a document is
rejected only when its two best languages lie within BETWEEN and coding it in two, the
place of the change and EVIDENCE further bits included, is shorter than coding it in one.
A tie without information is accepted.

Languages of NEAR of the largest dictionary or more are compared at their common
size. Any other keeps its whole dictionary and is compared with the best one so far at
its own size, so no scarce language shortens the others. Below MINIMUM bytes equal sizes
tell noise only: such a language has to beat the best one's whole dictionary, and rejects nothing.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and
rejected; without any learned language every text is. Ties go to the first language
in code point order. Rows repeat as they are, and other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts for each language, bytes of a dictionary: the bounded fitting sample.
SAMPLES, DICTIONARY = 64, 98304
#: Pieces that stand for a text in a dictionary, at even distances from its beginning to its end, and the characters of each.
PIECES, PIECE = 8, 256
#: Bytes that are encoded at once, so that the dictionary counts throughout a long text.
SEGMENT = 4096
LEVEL = 5
#: Relative difference between the two smallest encodings below which a document is rejected.
MARGIN = 0.002
#: Margin at which the score reaches 1 - 1/e.
SCALE = 0.03
#: Fewest bytes from which on a single byte is no more than the margin.
RESOLVED = 500
#: Order of the byte model of shorter texts, bits of a hashed context and weight of the order below.
ORDER, BITS, WEIGHT = 4, 18, 2.0
#: Bits that a second language must save, beyond what telling the languages and the place costs.
EVIDENCE = 16.0
#: Relative difference between the two shortest code lengths of a short text from which on it is in one language.
BETWEEN = 0.1
#: Share of the largest dictionary from which on languages are cut to one size; bytes below which a language is scarce.
NEAR, MINIMUM = 0.9, 16384

_LETTER = re.compile(r"[^\W\d_]")


def pieces(text: str = "text", count: int = PIECES, size: int = PIECE) -> Column:
    """A text as it is, or, if it is longer than all pieces together, its pieces from beginning to end, each on its own line."""
    c, n = F.col(text), F.length(text)
    step = (n - size) / F.lit(count - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(c, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(n <= count * size, c).otherwise(F.array_join(spread, "\n"))


def fit(labelled: DataFrame, samples: int = SAMPLES, dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """Raw-content dictionaries by language from rows (doc_id, text, lang).

    At most ``samples`` texts a language are taken, those of smallest md5(doc_id); each
    reaches the driver as pieces of its whole length.
    """
    rank = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = (
        labelled.where("lang is not null and text is not null")
        .select("doc_id", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), "text", "lang")
        .withColumn("r", F.row_number().over(rank))
        .where(F.col("r") <= samples)
        .select("lang", "r", pieces().alias("text"))
        .collect()
    )
    found: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda x: (x["lang"], x["r"])):
        found.setdefault(row["lang"], []).append(row["text"].lower().encode())
    return {k: b"\n".join(x)[:dictionary] for k, x in found.items()}


def _grams(data: bytes) -> list[np.ndarray]:
    """For orders 1 to ORDER, the bucket of the bytes that end at each position of data, ORDER - 1 blanks before it."""
    b = np.frombuffer(b" " * (ORDER - 1) + data, np.uint8).astype(np.uint64)
    found, n = [], len(data)
    for k in range(1, ORDER + 1):
        value = np.zeros(n, np.uint64)
        for i in range(ORDER - k, ORDER):
            value = (value << np.uint64(8)) | b[i : i + n]
        found.append((value if k < 3 else (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64))
    return found


def _counted(dictionary: bytes) -> list[np.ndarray]:
    return [np.bincount(g, minlength=1 << (8 * k if k < 3 else BITS)).astype(np.float32) for k, g in enumerate(_grams(dictionary), 1)]


class Judge:
    """The encoders of a model, for one task."""

    def __init__(self, model: dict[str, bytes], margin: float):
        self.model, self.margin = model, margin
        largest = max(map(len, model.values()), default=0)
        self.near = sorted(k for k in model if len(model[k]) >= NEAR * largest)
        self.common = min((len(model[k]) for k in self.near), default=0)
        self.scarce = sorted((k for k in model if k not in self.near), key=lambda k: (-len(model[k]), k))
        self.encoders: dict[tuple, zstandard.ZstdCompressor] = {}
        self.tables: dict[tuple, list[np.ndarray]] = {}

    def size(self, name: str, length: int, data: bytes) -> int:
        m = self.encoders.get((name, length))
        if m is None:
            held = zstandard.ZstdCompressionDict(self.model[name][:length], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            m = self.encoders[name, length] = zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False)
        return sum(len(m.compress(data[i : i + SEGMENT])) for i in range(0, len(data), SEGMENT))

    def bits(self, names: tuple, length: int, grams: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Code length of each byte (rows) in each language (columns)."""
        table = self.tables.get((names, length))
        if table is None:
            table = self.tables[names, length] = [np.stack(x, 1) for x in zip(*(_counted(self.model[k][:length]) for k in names), strict=True)]
        p = (table[0][grams[0]] + 0.5) / (table[0].sum(0) + 128.0)
        for k in range(1, ORDER):
            seen = table[k - 1][before[k - 1]]
            p = (np.minimum(table[k][grams[k]], seen) + WEIGHT * p) / (seen + WEIGHT)
        return -np.log2(p)

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """lang_pred, score, margin, accepted."""
        if not self.model or text is None or not _LETTER.search(text):
            return "und", 0.0, 0.0, False
        data = text.lower().encode()
        sizes = {k: self.size(k, self.common, data) for k in self.near}
        if min(sizes.values()) < RESOLVED:
            name, gap, accepted = self.short(data)
        else:
            name, gap = self.ranked(sizes, lambda k, n: self.size(k, n, data))
            accepted = gap >= self.margin
        return name, 1.0 - 2.718281828459045 ** (-gap / SCALE), gap, accepted

    def ranked(self, sizes: dict[str, float], size) -> tuple[str, float]:
        """The best language and its relative gap to the next one."""
        order = sorted(sizes, key=lambda k: (sizes[k], k))
        best = order[0]
        gap = (sizes[order[1]] - sizes[best]) / sizes[best] if len(order) > 1 else 1.0
        whole = sizes[best]
        for k in self.scarce:
            length = len(self.model[k])
            known, mine = length >= MINIMUM, size(k, length)
            other = size(best, length) if known else whole
            if mine < other:
                best, gap, whole = k, (other - mine) / mine, mine
            elif known:
                gap = min(gap, (mine - other) / other)
        return best, gap

    def short(self, data: bytes) -> tuple[str, float, bool]:
        grams = _grams(data)
        before = _grams(b" " + data[:-1])
        near = tuple(self.near)
        cost = self.bits(near, self.common, grams, before)
        total = cost.sum(0)
        best, gap = self.ranked(dict(zip(near, total.tolist(), strict=True)), lambda k, n: float(self.bits((k,), n, grams, before).sum()))
        accepted = True
        if len(near) > 1 and gap < BETWEEN:
            at = np.flatnonzero(np.frombuffer(data, np.uint8) <= 32)
            if len(at):
                upto = np.cumsum(cost, 0)[at]
                split = (upto.min(1) + (total - upto).min(1)).min() + np.log2(len(at) * len(near) * (len(near) - 1)) + EVIDENCE
                accepted = bool(split >= total.min())
        return best, gap, accepted


def predict(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Rows (doc_id, lang_pred, score, margin, accepted), one for each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model, margin)
        for batch in batches:
            out = [judge(value.as_py()) for value in batch.column(1)]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, lang_pred string, score double, margin double, accepted boolean")


def filtered(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose language is accepted, all columns as they were."""
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model, margin)
        at = columns.index("text")
        for batch in batches:
            mask = [judge(value.as_py())[3] for value in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
