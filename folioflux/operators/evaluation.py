"""Retrieval and answer metrics over gold spans, and threshold gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.errors import EvaluationError
from folioflux.functions import text as T
from folioflux.operators.context import ABSTENTION

KS = (1, 3, 5, 10)


def quote_pattern(quote: Column) -> Column:
    """A quote as a pattern whose blanks match any run of blanks."""
    escaped = F.regexp_replace(quote, r"([\\\[\](){}.*+?^$|\-&~#])", r"\\$1")
    return F.array_join(T.split_blanks(escaped), r"\s+")


def resolve_spans(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, gold_idx, doc_id, start_char, end_char) of items (query_id, gold_idx, source_uri, quote).

    Each quote must stand exactly once in its document; otherwise the query fails, naming the item.
    """
    rows = items.join(documents.select("source_uri", "doc_id", "text"), "source_uri", "left").withColumn("p", quote_pattern(F.col("quote")))
    n = F.regexp_count("text", F.col("p"))
    fail = F.raise_error(F.concat(F.lit("gold of item "), F.col("query_id").cast("string"), F.lit(" does not stand exactly once in "), F.col("source_uri")))
    begin = F.regexp_instr("text", F.col("p"))
    begin = F.when((F.col("text").isNull()) | (n != 1), fail.cast("int")).otherwise(begin - 1)
    rows = rows.withColumn("start_char", begin)
    length = F.length(F.regexp_substr("text", F.col("p")))
    return rows.select("query_id", "gold_idx", "doc_id", "start_char", (F.col("start_char") + length).alias("end_char"))


def coverage(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rank, gold_idx) of hits (query_id, rank, doc_id, start_char, end_char) that overlap a gold span."""
    g = gold.select("query_id", "gold_idx", F.col("doc_id").alias("g_doc"), F.col("start_char").alias("g_start"), F.col("end_char").alias("g_end"))
    rows = hits.join(g, "query_id").where("doc_id = g_doc and start_char < g_end and g_start < end_char")
    return rows.select("query_id", "rank", "gold_idx").distinct()


def item_metrics(hits: DataFrame, gold: DataFrame, ks: tuple = KS) -> DataFrame:
    """Recall, precision, hit rate and nDCG at each k and the reciprocal rank, for every item with gold.

    A rank gains once for nDCG, when it covers a span that none before it did.
    """
    covered = coverage(hits, gold)
    first = covered.groupBy("query_id", "gold_idx").agg(F.min("rank").alias("rank"))
    size = gold.groupBy("query_id").agg(F.count_distinct("gold_idx").alias("n_gold"))
    ranks = first.groupBy("query_id").agg(F.collect_list("rank").alias("firsts"), F.min("rank").alias("best"))
    relevant = covered.groupBy("query_id").agg(F.collect_set("rank").alias("relevant"))
    rows = size.join(ranks, "query_id", "left").join(relevant, "query_id", "left")
    empty = F.array().cast("array<int>")
    rows = rows.withColumn("firsts", F.coalesce(F.col("firsts").cast("array<int>"), empty)).withColumn("relevant", F.coalesce(F.col("relevant").cast("array<int>"), empty))
    gain = lambda r: 1 / F.log2(r.cast("double") + 1)
    out = [F.col("query_id"), F.col("n_gold"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        within = lambda c, k=k: F.size(F.filter(c, _at_most(k)))
        dcg = F.aggregate(F.filter(F.array_distinct("firsts"), _at_most(k)), F.lit(0.0), lambda s, r: s + gain(r))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + gain(r))
        out += [
            (within(F.col("firsts")) / F.col("n_gold")).alias(f"recall_{k}"),
            (within(F.col("relevant")) / F.lit(k)).alias(f"precision_{k}"),
            (within(F.col("relevant")) > 0).cast("int").alias(f"hit_{k}"),
            (dcg / ideal).alias(f"ndcg_{k}"),
        ]
    return rows.select(*out)


def _at_most(k: int):
    return lambda r: r <= k


def evaluate_retrieval(items: DataFrame, hits: DataFrame, gold: DataFrame, flags: DataFrame, ks: tuple = KS) -> DataFrame:
    """(metric, value): means over answerable items, and abstention rates of either population; a metric without population is left out."""
    each = item_metrics(hits, gold, ks)
    names = [c for c in each.columns if c not in ("query_id", "n_gold")]
    means = each.agg(*[F.avg(c).alias(c) for c in names])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select("m.*")
    rows = items.select("query_id").join(gold.select("query_id").distinct().withColumn("gold", F.lit(1)), "query_id", "left").join(flags, "query_id", "left")
    flag = F.coalesce(F.col("insufficient"), F.lit(True)).cast("double")
    rates = rows.agg(F.avg(F.when(F.col("gold").isNotNull(), flag)).alias("false_abstain_rate"), F.avg(F.when(F.col("gold").isNull(), flag)).alias("abstain_rate"))
    more = rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in rates.columns])).alias("m")).select("m.*")
    return long.unionByName(more).where("value is not null")


def abstained(answer: Column) -> Column:
    return F.array_join(T.split_blanks(answer), " ") == " ".join(ABSTENTION.split())


def token_f1(pairs: DataFrame) -> DataFrame:
    """(pair_id, f1) of pairs (pair_id, prediction, reference): F1 of their bags of normalised words; 1 if both are empty."""
    rows = pairs.select("pair_id", T.normalize_answer(F.col("prediction")).alias("p"), T.normalize_answer(F.col("reference")).alias("r"))
    both = F.array_intersect("p", "r")
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(both, F.lit(0), lambda s, w: s + F.least(times(F.col("p"), w), times(F.col("r"), w)))
    f1 = F.when((F.size("p") == 0) & (F.size("r") == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2.0 * common, F.size("p") + F.size("r")), F.lit(0.0)))
    return rows.select("pair_id", f1.alias("f1"))


def citation_precision(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, precision): share of an answer's citations that overlap its gold; answers without citations have none."""
    hits = cited.select("query_id", F.col("label").alias("rank"), "doc_id", "start_char", "end_char")
    good = coverage(hits, gold).select("query_id", "rank").distinct().withColumn("good", F.lit(1))
    return hits.join(good, ["query_id", "rank"], "left").groupBy("query_id").agg((F.count("good") / F.count("*")).alias("precision"))


#: Failures in a row after which a run of answers counts as stopped.
MAX_FAILURES = 10


def stopped_at(answers: DataFrame, limit: int = MAX_FAILURES) -> DataFrame:
    """One row (position, cause): where a run of answers (position, error_kind) stops; without a row it went through.

    Spent allowances and refused credentials stop it at once, other failures when ``limit``
    of them stand in a row. Runs of failures are found by the positions of failures less their
    rank, among failures only, which are few.
    """
    failed = answers.where("error_kind is not null").select(F.col("position").cast("long").alias("position"), "error_kind")
    fatal = failed.where(F.col("error_kind").isin("QuotaExhausted", "AuthError")).agg(F.min("position").alias("position")).withColumn("cause", F.lit("refused"))
    runs = failed.withColumn("run", F.col("position") - F.row_number().over(Window.orderBy("position")))
    runs = runs.groupBy("run").agg(F.count("*").alias("n"), F.min("position").alias("first")).where(F.col("n") >= limit)
    many = runs.agg((F.min("first") + limit - 1).alias("position")).withColumn("cause", F.lit("failures"))
    first = fatal.unionByName(many).where("position is not null").agg(F.min(F.struct("position", "cause")).alias("x"))
    return first.where("x is not null").select("x.position", "x.cause")


def evaluate_answers(items: DataFrame, answers: DataFrame, reports: DataFrame, cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(metric, value): means over answered items of a run, and how many there are.

    items (query_id, reference), answers (query_id, answer, error_kind), reports (query_id,
    validity_rate), cited (query_id, label, doc_id, start_char, end_char), gold (query_id, gold_idx,
    doc_id, start_char, end_char). Items with gold are answerable: validity, precision of their
    citations, token F1 to the reference and false abstentions; the others give the rate of right
    abstentions. Failed answers count as errors and nowhere else; a metric without items is left out.
    """
    rows = items.select("query_id", "reference").join(answers.select("query_id", "answer", "error_kind"), "query_id", "left")
    rows = rows.join(gold.select("query_id").distinct().withColumn("gold", F.lit(True)), "query_id", "left").join(reports.select("query_id", "validity_rate"), "query_id", "left")
    rows = rows.join(citation_precision(cited, gold), "query_id", "left")
    f1 = token_f1(rows.where("answer is not null and reference is not null").select(F.col("query_id").alias("pair_id"), F.col("answer").alias("prediction"), "reference"))
    rows = rows.join(f1.withColumnRenamed("pair_id", "query_id"), "query_id", "left")
    good, answerable = F.col("answer").isNotNull(), F.coalesce("gold", F.lit(False))
    said = F.coalesce(abstained(F.col("answer")), F.lit(False))
    mean = lambda who, value: F.avg(F.when(who, value.cast("double")))
    found = {
        "n_items": F.count("*").cast("double"),
        "n_errors": F.count_if(~good).cast("double"),
        "error_rate": F.avg((~good).cast("double")),
        "citation_validity": mean(good & answerable & ~said, F.col("validity_rate")),
        "citation_precision": mean(good & answerable & ~said, F.col("precision")),
        "cited_rate": mean(good & answerable & ~said, F.col("precision").isNotNull()),
        "token_f1": mean(good & answerable, F.col("f1")),
        "false_abstain_rate": mean(good & answerable, said),
        "abstain_rate": mean(good & ~answerable, said),
    }
    one = rows.agg(*[v.alias(k) for k, v in found.items()])
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in found])).alias("m")
    return one.select(long).select("m.*").where("value is not null")


def latencies(rows: DataFrame, value: str = "ms", *keys: str) -> DataFrame:
    """Median, 95th percentile and maximum of a column, exact, by keys."""
    pick = lambda q, name: F.percentile(value, q).alias(name)
    return rows.groupBy(*keys).agg(pick(0.5, "p50"), pick(0.95, "p95"), F.max(value).alias("most"), F.count(value).alias("n"))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, floor, passed) for every threshold (metric, baseline, tolerance); a missing metric fails the query."""
    rows = thresholds.join(metrics, "metric", "left")
    floor = F.round(F.col("baseline") - F.col("tolerance"), 9)
    value = F.when(F.col("value").isNull(), F.raise_error(F.concat(F.lit("no metric "), F.col("metric"))).cast("double")).otherwise(F.col("value"))
    return rows.select("metric", value.alias("value"), floor.alias("floor"), (value >= floor).alias("passed"))


def render_report(rows: list) -> str:
    """metric, value a line."""
    if not rows:
        raise EvaluationError("nothing to report")
    width = max(len(r["metric"]) for r in rows)
    return "\n".join(f"{r['metric']:<{width}}  {r['value']:.3f}" for r in rows)
