"""Chat formatting: roles of a transcript's turns recovered by a hidden Markov model, then canonical rendering.

Hidden states are roles; a turn emits its speaker marker and features of its lines. The
model is counted on a bounded labelled sample; roles come from Viterbi's algorithm.
Conversations are decoded in chunks of consecutive turns: each chunk is summed up by a
max-plus matrix, a conversation's matrices give the states at the chunks' ends, and every
chunk is then decoded between them, so no conversation has to fit into one task.

Defined results: null and empty texts are turns without marker or lines; rows without
conversation or turn are decoded by themselves; rows with the same turn stand in
order of their text's 64-bit hash; equal paths go to the first role in code point order; without
labelled rows every role is null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Labelled turns that a model is counted on at most: those of smallest md5(conv_id).
MAX_TURNS = 30_000
#: Values of turn that a chunk spans.
CHUNK = 512

#: Words that mark a speaker, by role.
MARKERS = {
    "assistant": "assistant|ai|bot|gpt|model|answer|response|a",
    "system": "system|instructions?|context",
    "user": "user|human|prompter|customer|question|prompt|q",
}
_MARK = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(?:" + "|".join(f"(?P<{k}>{v})" for k, v in MARKERS.items()) + r")(?:\|?>|\]|\*\*)?\s*(?:[:>]|\*\*|(?<=[>\]])|\n)\s*", re.I)
_LIST = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)]|```|#{1,6}\s)")
#: Values of each feature.
SIZES = (len(MARKERS) + 1, 20, 12, 2, 3, 12)


def marker(text: str) -> tuple[int, int]:
    """Number of the marker's role, 0 without one, and where the text after it begins."""
    found = _MARK.match(text)
    if not found:
        return 0, 0
    return 1 + list(MARKERS).index(found.lastgroup), found.end()


def observed(text: str | None) -> tuple[int, ...]:
    """Marker, length, number of lines, question at the end, list or code lines, mean line length."""
    mark, begin = marker(text or "")
    body = (text or "")[begin:].strip()
    lines = body.split("\n") if body else []
    marked = sum(bool(_LIST.match(x)) for x in lines)
    bucket = lambda x, most: min(most - 1, int(2 * math.log2(1 + x)))
    return (
        mark,
        min(19, int(1.6 * math.log2(1 + len(body)))),
        bucket(len(lines), 12),
        int(body.endswith("?")),
        0 if not marked else 1 if 2 * marked < len(lines) else 2,
        min(11, int(math.log2(1 + len(body) / max(1, len(lines))))),
    )


def _features(rows: DataFrame, extra: list[str]) -> DataFrame:
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [observed(t.as_py()) for t in batch.column(len(extra))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], pa.array(seen, pa.list_(pa.int32()))], [*extra, "seen"])

    return rows.select(*extra, "text").mapInArrow(look, ", ".join([*kinds, "seen array<int>"]))


def fit(rows: DataFrame, max_turns: int = MAX_TURNS) -> dict:
    """Log probabilities from rows (conv_id, turn, role, text), of which the bounded sample is taken."""
    labelled = rows.where("role is not null and conv_id is not null and turn is not null").withColumn("h", F.md5(F.col("conv_id").cast("string")))
    order = ["h", "conv_id", "turn", "role", "text"]
    taken = labelled.select(*order).orderBy(*order).limit(max_turns)  # features are looked at for these only
    sample = _features(taken, ["h", "conv_id", "turn", "role"]).orderBy(*order[:4], "seen").collect()
    roles = sorted({r["role"] for r in sample})
    k = len(roles)
    start, move = np.full(k, 0.5), np.full((k, k), 0.5)
    emit = [np.full((k, s), 0.2) for s in SIZES]
    for i, role in enumerate(roles):  # a marker speaks for its own role, even if the sample has none
        for j, name in enumerate(MARKERS):
            emit[0][i, j + 1] = 20.0 if role == name else 0.2
    before = None
    for r in sample:
        s = roles.index(r["role"])
        if before and before[0] == r["conv_id"]:
            move[before[1], s] += 1
        else:
            start[s] += 1
        for e, v in zip(emit, r["seen"], strict=True):
            e[s, v] += 1
        before = (r["conv_id"], s)
    log = lambda a: np.log(a / a.sum(-1, keepdims=True))
    return {"roles": roles, "start": log(start), "move": log(move), "emit": [log(e) for e in emit]} if k else {"roles": []}


def _emission(model: dict, seen: tuple) -> np.ndarray:
    return sum(e[:, v] for e, v in zip(model["emit"], seen, strict=True))


def best_path(model: dict, emissions: np.ndarray, entry: int | None, exit_: int | None) -> list[int]:
    """Most probable states, given the state before the first (none: the first opens a conversation) and the last state."""
    score = emissions[0] + (model["start"] if entry is None else model["move"][entry])
    back = []
    for e in emissions[1:]:
        step = score[:, None] + model["move"]
        back.append(step.argmax(0))
        score = step.max(0) + e
    state = int(score.argmax()) if exit_ is None else exit_
    path = [state]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def decoded(rows: DataFrame, model: dict, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of rows (conv_id, turn, text): conv_id, turn, role, rendered."""
    conv_kind, turn_kind = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = f"conv_id {conv_kind}, turn {turn_kind}, role string, rendered string"
    roles = model["roles"]
    if not roles:
        return rows.select("conv_id", "turn", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("rendered"))
    rows = rows.select("conv_id", "turn", "text")
    alone = rows.where("conv_id is null or turn is null")
    rows = rows.where("conv_id is not null and turn is not null").withColumn("chunk", F.floor(F.col("turn") / chunk).cast("long"))
    k = len(roles)

    def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list]]:
        """Runs of rows with equal first columns, one by one."""
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != key:
                    if held:
                        yield key, held
                    key, held = row[:width], []
                held.append(row[width:])
        if held:
            yield key, held

    def batched(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in rows:
            out.append(row)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    conv_type, turn_type = (to_arrow_type(rows.schema[c].dataType) for c in ("conv_id", "turn"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrices() -> Iterator[tuple]:
            for (conv, at), turns in groups(batches, 2):
                m = None
                first = _emission(model, turns[0][-1])
                for row in turns:
                    e = _emission(model, row[-1])
                    m = model["move"] + e if m is None else (m[:, :, None] + model["move"][None]).max(1) + e
                opened = model["start"] + first
                for row in turns[1:]:
                    opened = (opened[:, None] + model["move"]).max(0) + _emission(model, row[-1])
                yield conv, at, m.reshape(-1).tolist(), opened.tolist()

        yield from batched(matrices(), [conv_type, pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())], ["conv_id", "chunk", "m", "opened"])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ends() -> Iterator[tuple]:
            for (conv,), chunks in groups(batches, 1):
                score, back = np.array(chunks[0][2]), []
                for _, m, _ in chunks[1:]:
                    step = score[:, None] + np.array(m).reshape(k, k)
                    back.append(step.argmax(0))
                    score = step.max(0)
                state = [int(score.argmax())]
                for b in reversed(back):
                    state.append(int(b[state[-1]]))
                state = state[::-1]
                for i, (at, _, _) in enumerate(chunks):
                    yield conv, at, state[i - 1] if i else None, state[i]

        yield from batched(ends(), [conv_type, pa.int64(), pa.int32(), pa.int32()], ["conv_id", "chunk", "entry", "exit"])

    def rendering(role: str, text: str | None) -> str:
        body = (text or "")[marker(text or "")[1] :].strip()
        return f"<|{role}|>\n{body}\n<|end|>"

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for (conv, _, entry, exit_), held in groups(batches, 4):
                path = best_path(model, np.array([_emission(model, observed(r[1])) for r in held]), entry, exit_)
                for s, (turn, text) in zip(path, held, strict=True):
                    yield conv, turn, roles[s], rendering(roles[s], text)

        yield from batched(turns(), [conv_type, turn_type, pa.string(), pa.string()], ["conv_id", "turn", "role", "rendered"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    role = roles[best_path(model, _emission(model, observed(text))[None], None, None)[0]]
                    yield conv, turn, role, rendering(role, text)

        yield from batched(turns(), [conv_type, turn_type, pa.string(), pa.string()], ["conv_id", "turn", "role", "rendered"])

    seen = _features(rows.withColumn("h", F.xxhash64("text")), ["conv_id", "chunk", "turn", "h"])
    seen = seen.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "h")
    matrices = seen.mapInArrow(summed, f"conv_id {conv_kind}, chunk long, m array<double>, opened array<double>")
    ends = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(ended, f"conv_id {conv_kind}, chunk long, entry int, exit int")
    turns = rows.withColumn("h", F.xxhash64("text")).join(ends, ["conv_id", "chunk"]).repartition("conv_id", "chunk")
    turns = turns.sortWithinPartitions("conv_id", "chunk", "turn", "h").select("conv_id", "chunk", "entry", "exit", "turn", "text")
    return turns.mapInArrow(labelled, schema).unionByName(alone.mapInArrow(single, schema))


def lines(texts: DataFrame) -> DataFrame:
    """A transcript in one text as turns: rows (conv_id, turn, text) from rows (doc_id, text), a turn opening at each marked line."""
    opens = r"(?im)^(?=\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(?:" + "|".join(MARKERS.values()) + r")(?:\|?>|\]|\*\*)?\s*(?:[:>]|\*\*))"
    return texts.select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("text", opens)).alias("turn", "text")).where("trim(text) <> ''")
