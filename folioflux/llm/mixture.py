"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]; its integral is the
source's target, and the integral up to t is the words it is to have given by t
(cumulative demand). A document (or its second or third pass) covers an interval of
its source's words; inverting the demand at the interval's start gives its training
position, by which documents are range-sorted.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share all
words; none is above ``most`` times its source's words, and what that cuts off is
shared again by weight until none is above. Documents stand in md5(doc_id) order within
their source, so reruns agree; the last one taken is taken in part.

Defined results: a null text has size 0 and is taken with 0 words; sources without words
have target 0; a null source is a source of its own; rows that repeat stand beside each
other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.common import written

WEIGHTS = (5, 2, 1)
#: Passes over a source at most.
MOST = 3
#: Slope of the first sources' schedules at most: weight falls from 1 + SLOPE to 1 - SLOPE; every second source rises instead.
SLOPE = 0.5
#: Buckets of a source's running sum; a bucket holds about this many documents.
BUCKET = 2000
#: Buckets of a source at most, and how many are summed at once.
BUCKETS, RUN = 1 << 24, 1 << 12
#: Sources that are broadcast at most; more are joined by shuffles.
BROADCAST_SOURCES = 50_000


def words(text: str = "text") -> Column:
    """Number of runs other than space and \\x09-\\x0D; 0 for null."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    ends = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(parts) - ends).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """Target of each source from rows (source, source_size): one row a source.

    Water filling in closed form: with sources in order of most * size / weight, those
    before the level are full, and the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(order))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    ranked = ranked.withColumn("step", F.row_number().over(fill))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("step", "level"))).over(every)["level"]
    return ranked.withColumn("level", level).select(
        "source", "source_size", "rank", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target")
    )


def demand_inverse(share: Column, slope: Column) -> Column:
    """Time t at which a schedule 1 + slope - 2 * slope * t has given this share of its integral."""
    a = slope
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * share))
    return F.when(a == 0, share).otherwise(((1 + a) - root) / (2 * a))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, slope: float = SLOPE) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, passes (array of start position and words).

    Running sums are split: rows are summed by (source, bucket of their md5), buckets
    are summed in order, and only then rows within a bucket, so no source meets in one task.
    """
    return _planned(docs.select("doc_id", "source", words().alias("size")), weights, most, slope)


def _planned(rows: DataFrame, weights: tuple, most: int, slope: float, carried: tuple = (), ties: tuple = ()) -> DataFrame:
    """plan() of rows (doc_id, source, size); columns ``carried`` stay on their rows, and columns ``ties`` order rows of one doc_id and size."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # A key without nulls, so that windows and joins share one partitioning and what rows carry is shuffled once.
    rows = rows.withColumn("h", h).withColumn("k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    n = F.col("n_buckets")
    sums = rows.groupBy("k", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sums = sums.withColumn("n_buckets", F.least(F.lit(BUCKETS), F.ceil(F.col("n") / BUCKET))).drop("n")
    goal = targets(sums.select("source", "source_size"), weights, most).withColumn("k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    goal = goal.join(sums.select("k", "n_buckets"), "k").withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    goal, _ = written(goal, "sources")
    few = F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * n / F.lit(4294967296.0)).cast("long")
    keyed = rows.join(few.select("k", "n_buckets"), "k").withColumn("b", bucket).drop("n_buckets")
    parts = keyed.groupBy("k", "b").agg(F.sum("size").alias("part"))
    # Buckets are summed in runs of RUN, and the runs of a source among themselves: no window holds more than RUN or BUCKETS / RUN rows.
    parts = parts.withColumn("run", F.floor(F.col("b") / RUN))
    before = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy("k", "run").agg(F.sum("part").alias("part")).withColumn("ahead", F.coalesce(F.sum("part").over(before("run", "k")), F.lit(0))).select("k", "run", "ahead")
    parts = parts.withColumn("base", F.coalesce(F.sum("part").over(before("b", "k", "run")), F.lit(0)))
    parts = parts.join(runs, ["k", "run"]).withColumn("base", F.col("base") + F.col("ahead"))
    parts = parts.join(few.drop("n_buckets"), "k").select("k", "b", "base", "source_size", "target", "goal", "rank")
    parts, _ = written(parts, "buckets")
    inside = Window.partitionBy("k", "b").orderBy("h", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    found = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts.hint("shuffle_merge"), ["k", "b"])
    found = found.withColumn("at", F.col("base") + F.col("inner"))
    a = F.when(F.col("rank") % 2 == 1, F.lit(float(slope))).otherwise(F.lit(-float(slope)))

    def one(p: int) -> Column:
        start = F.col("at") + F.lit(p) * F.col("source_size")
        got = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - start))
        share = F.when(F.col("goal") > 0, F.least(F.lit(1.0), start / F.col("goal"))).otherwise(F.lit(1.0))
        return F.struct(demand_inverse(share, a).alias("position"), got.cast("long").alias("words"))

    passes = F.filter(F.array(*[one(p) for p in range(int(most))]), lambda x: x["words"] > 0)
    found = found.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", *carried)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, slope: float = SLOPE) -> DataFrame:
    """The training order: columns of docs, then position and words; a row for each pass over a document, range-sorted by position.

    Columns ``position`` and ``words`` that docs has already are replaced.
    """
    rows = docs.drop("position", "words")
    names = rows.columns
    rows = rows.select("doc_id", "source", words().alias("size"), F.md5("text").alias("__text"), F.struct(*names).alias("__row"))
    order = _planned(rows, weights, most, slope, ("__row",), ("__text",)).select("__row", F.explode("passes").alias("__pass"))
    found = order.select("__row.*", F.col("__pass.position").alias("position"), F.col("__pass.words").alias("words"))
    return found.orderBy("position", "doc_id")
