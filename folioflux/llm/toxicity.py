"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a curated and of a learned lexicon (whole words and of their
stems), the densest window, second persons near lexicon words, capitals, punctuation and
obfuscation (digits or symbols inside words, spaced-out letters, and lexicon words found
once these are undone).

Defined results: null and empty texts have zero features and get the score of such a
text; without labels of both classes every score is the smoothed share of label 1.
Rows repeat as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those of smallest md5(doc_id).
MAX_ROWS = 12000
#: Learned lexicon entries at most.
MAX_WORDS = 4000
THRESHOLD = 0.7
#: Letters of a stem.
STEMS = (4, 5)
#: Folds of the sample whose margins, each predicted from the others and their lexicon, the calibration is fitted on.
FOLDS = 6
WINDOW = 50
NEAR = 5

#: The curated lexicon.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers pathetic clown clowns scum trash worthless disgusting dumb fool jerk hate ugly garbage filth vermin".split())
#: Second persons.
SECOND = frozenset("you your yours yourself yourselves du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
#: Letters that digits and symbols stand for.
LEET = str.maketrans("013457@$!+8", "oieastasitb")

_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}\"'«»„“”…|<>*%#-–—¿¡"
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_MIXED = re.compile(r"^(?=.*[^\W\d_])(?=.*[\d@$!*+])[\w@$!*+]+$")
NAMES = ("log_words", "curated", "learned", "learned_weight", "stems", "stem_weight", "hits", "densest", "second", "near", "capitals", "shouted", "exclaimed", "punctuation", "repeated", "obfuscated", "revealed")


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without edge punctuation."""
    found = (t.strip(_EDGE) for t in (text or "").lower().split())
    return [t for t in found if t]


def keys(words: list[str]) -> set[str]:
    """Words, and their stems after ^."""
    distinct = set(words)
    return distinct | {"^" + w[:k] for w in distinct for k in STEMS if len(w) > k}


def plain(text: str | None) -> tuple[list[str], list[str], list[float]]:
    """What of a text's features no lexicon enters: its words, disguised words undone, and the features."""
    text = text or ""
    words = tokens(text)
    raw = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    mixed = [w for w in words if not w.isalpha() and _MIXED.match(w)]
    spaced = _SPACED.findall(text)
    undone = [w.translate(LEET).replace("*", "") for w in mixed] + [re.sub(r"[ .\-_*]", "", s).lower() for s in spaced]
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    shown = [
        math.log1p(len(words)), sum(w in INSULTS for w in words) / n, sum(w in SECOND for w in words) / n,
        capitals / size, sum(w.isupper() and len(w) > 2 for w in raw) / n, text.count("!") / n,
        sum(map(text.count, ".,;:!?%*#|")) / size, (text.count("!!") + text.count("??") + text.count("***")) / n,
        (len(mixed) + len(spaced)) / n,
    ]
    return words, undone, shown


class Lexicon:
    """Learned weights of words and stems; what a word gets is remembered, up to REMEMBERED words."""

    REMEMBERED = 1 << 18

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def __call__(self, word: str) -> tuple[float, float]:
        """Weight of a word, and the largest of its stems."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            stem = max((self.weights.get("^" + word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)
            got = self.known[word] = (self.weights.get(word, 0.0), stem)
        return got


def weighed(words: list[str], undone: list[str], shown: list[float], lexicon: Lexicon) -> list[float]:
    """All features, in the order of NAMES."""
    n = max(1, len(words))
    got, stem = np.array([lexicon(w) for w in words]).reshape(-1, 2).T
    insult = np.fromiter((w in INSULTS for w in words), bool, len(words))
    at = np.flatnonzero((got > 0) | (stem > 0) | insult)
    second = np.flatnonzero(np.fromiter((w in SECOND for w in words), bool, len(words)))
    densest = near = 0
    if len(at):
        densest = int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max())
        near = int((np.searchsorted(at, second + NEAR, "right") - np.searchsorted(at, second - NEAR)).sum())
    revealed = sum(w in INSULTS or w in lexicon.weights for w in undone)
    log_words, curated, second_share, *rest = shown
    return [
        log_words, curated, np.count_nonzero(got > 0) / n, float(got.sum()) / n, np.count_nonzero(stem > 0) / n, float(stem.sum()) / n,
        math.log1p(len(at)), min(densest, WINDOW) / min(n, WINDOW), second_share, near / n, *rest, revealed / n,
    ]


def features(text: str | None, lexicon: dict[str, float] | Lexicon) -> list[float]:
    return weighed(*plain(text), lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> dict:
    """Second-order boosted trees for log loss over quantile bins. A tree: arrays feature, cut, left, value."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    p = (y.sum() + 1.0) / (len(y) + 2.0)
    base = math.log(p / (1 - p))
    f, trees = np.full(len(y), base), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = q - y, q * (1 - q)
        tree, queue = [], [(np.arange(len(y)), 0)]
        while queue:
            rows, level = queue.pop(0)
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 4:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                value = -rate * gs / (hs + ridge)
                f[rows] += value
                tree.append((-1, 0.0, 0, value))
                continue
            goes = code[rows, best[1]] <= best[2]
            left = len(tree) + len(queue) + 1
            tree.append((best[1], float(cuts[best[1]][best[2]]), left, 0.0))
            queue += [(rows[goes], level + 1), (rows[~goes], level + 1)]
        trees.append([np.array(c) for c in zip(*tree, strict=True)])
    return {"base": base, "trees": trees}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    for feature, cut, left, value in model["trees"]:
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = left[node] + (x[rows, feature[node]] > cut[node])
        f += value[at]
    return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), smoothed towards the share of label 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        if blocks and s == blocks[-1][3]:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2[0], blocks[-1][1] + v2[1], blocks[-1][2], v2[3]]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    xs, ps = [], []
    for total, n, low, high in blocks:
        p = (total + share) / (n + 1.0)
        xs += [low, high] if high > low else [low]
        ps += [p, p] if high > low else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


def learn(texts: DataFrame, min_count: int = 3, max_words: int = MAX_WORDS, folds: int = FOLDS) -> list[dict[str, float]]:
    """Lexicons from rows (text, toxic, fold): for each fold that of the other folds' rows, and last that of all.

    A lexicon has the weights of words and stems that stand mostly under label 1.
    """
    names = [f"{y}{k}" for k in range(folds) for y in ("c", "t")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in names]

        def out() -> pa.RecordBatch:
            every = list(set().union(*found))
            cols = [pa.array(every, pa.string())] + [pa.array([c[w] for w in every], pa.int64()) for c in found]
            return pa.RecordBatch.from_arrays(cols, ["key", *names])

        for batch in batches:
            for text, y, k in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found[2 * k + y].update(keys(tokens(text.as_py())))
            if sum(map(len, found)) > 400_000:
                yield out()
                for c in found:
                    c.clear()
        yield out()

    sizes = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    kinds = ", ".join(f"{n} long" for n in names)
    counts = texts.select("text", "toxic", "fold").mapInArrow(count, f"key string, {kinds}").groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).persist()
    lexicons = []
    try:
        for left_out in [*range(folds), None]:
            use = [k for k in range(folds) if k != left_out]
            good, bad = (sum(sizes.get((k, y), 0) for k in use) for y in (0, 1))
            if not good or not bad:
                lexicons.append({})
                continue
            c, t = (sum((F.col(f"{y}{k}") for k in use), F.lit(0)) for y in ("c", "t"))
            weight = F.log((t + 0.5) / F.lit(bad + 1.0)) - F.log((c + 0.5) / F.lit(good + 1.0))
            rows = counts.select("key", t.alias("t"), weight.alias("w")).where(F.col("t") >= min_count).where("w > 2")
            lexicons.append({r["key"]: float(r["w"]) for r in rows.orderBy(F.desc(F.col("w") * F.sqrt("t")), "key").limit(max_words).collect()})
    finally:
        counts.unpersist()
    return lexicons


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), of which the bounded sample is taken.

    Every row's features come from the lexicon of the other folds, so trees meet words as they
    will in new texts, and the calibration is fitted on margins from the other folds' trees.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = marks.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    # The sample has max_rows narrow rows at most, so it may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").repartition(32, "doc_id").persist()
    try:
        lexicons = learn(texts)

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [Lexicon(x) for x in lexicons]
            for batch in batches:
                rows = [features(t.as_py(), held[k]) for t, k in zip(batch.column(1), batch.column(3).to_pylist(), strict=True)]
                cols = [pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(NAMES))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *cols], ["doc_id", "toxic", "fold", *NAMES])

        id_kind = texts.schema["doc_id"].dataType.simpleString()
        kinds = ", ".join(f"{n} double" for n in NAMES)
        rows = texts.mapInArrow(dense, f"doc_id {id_kind}, toxic int, fold int, {kinds}").orderBy("doc_id", *NAMES).toPandas()
    finally:
        texts.unpersist()
    y = rows["toxic"].to_numpy(float)
    model = {"lexicon": lexicons[-1], "share": (y.sum() + 0.5) / (len(y) + 1.0), "trees": None}
    if 0 < y.sum() < len(y):
        x, part, margins = rows[list(NAMES)].to_numpy(float), rows["fold"].to_numpy(), np.zeros(len(y))
        for k in range(FOLDS):
            if (part == k).any():
                margins[part == k] = margin(boost(x[part != k], y[part != k]), x[part == k])
        model["trees"] = boost(x, y)
        model["knots"] = isotonic(margins, y)
    return model


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted), one for each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model["lexicon"])
        for batch in batches:
            if model["trees"] is None or not batch.num_rows:
                p = np.full(batch.num_rows, model["share"])
            else:
                x = np.array([features(t.as_py(), lexicon) for t in batch.column(1)])
                p = np.interp(margin(model["trees"], x), *model["knots"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype("int32"))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, score double, predicted int")
