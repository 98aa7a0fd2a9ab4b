"""Secret scans: strong credentials by pattern, weak ones by linking their parts.

Access identifiers, secrets and endpoints are intervals of a text; a weak candidate is a mixed
token of 20 characters or more, however long, with what dots join to it. It is reported only
when complementary parts overlap its scope, the candidate widened by ``radius`` code points:
an identifier, or an endpoint if the candidate is also named (a word for a credential or an
assignment stands right before it, or it is an assignment). A URL alone makes no secret. Candidates that overlap
base spans or parts are left out. Scopes meet parts in an interval join on text and bin.
DataFrame operations only; work is linear in a text's length and spans.

Defined results: a null text counts as empty and has no span; the hash of no span is
that of an empty string; rows repeat as they are; an empty table gives an empty result.
Spans are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.llm.common import written

#: The base kinds in order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Parts that weak candidates are linked with.
IDENTIFIER = r"""(?i:client_?id|access_?key_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
ENDPOINT = r"""https?://[^\s"'<>]+|(?i:endpoint|hostname)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]+"""
#: Dot-joined runs with a segment of 20 characters or more that has letters and digits. Possessive: linear, and no recursion in Java.
_SEGMENT = r"(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])(?=[A-Za-z0-9+/_=-]{20})"
WEAK = rf"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-]\.)(?:(?!{_SEGMENT})[A-Za-z0-9+/_=-]++\.)*+{_SEGMENT}[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+"
#: What names a weak candidate when it stands right before it.
NAMED = r"""(?i)(?:[:=]|(?:^|[^a-z])(?:key|secret|token|bearer|basic|auth|authorization|credential|credentials|pass|password|passwd|pwd))["'\x20]*\z"""
#: A weak candidate that is an assignment itself.
ASSIGNED = r"^[A-Za-z_-]{2,}=[^=]"
KINDS = ("assign", "access", "hex", "weak")
#: Ranks of spans: base kinds as listed, weak candidates, named weak candidates, identifiers, endpoints.
RANK_WEAK, RANK_NAMED, RANK_IDENTIFIER, RANK_ENDPOINT = 3, 4, 5, 6
MIN_VALUE = 6
RADIUS = 300
#: Pieces of a text whose positions are summed together; a text of n spans takes n * n / STEP copies of numbers at most.
STEP = 128
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: Column, pattern: str, rank: int, kind: str, keep=None, ranked=None) -> Column:
    """Leftmost non-overlapping matches as structs, in order; those that keep() refuses are dropped afterwards.

    What stands between matches comes from a split by the same pattern, so starts are running
    lengths. They are summed step by step of STEP matches, then put together. ranked() may
    give a match another rank from itself and what stands before it.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    pair = lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("long"), (keep(m) if keep else F.lit(True)).alias("good"), (ranked(p, m) if ranked else F.lit(rank)).alias("rank"))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, pair)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        made = F.array(F.struct(begin.alias("start"), x["rank"].alias("rank"), (begin + x["long"]).alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)
        return F.struct((begin + x["long"]).alias("at"), F.when(x["good"], F.concat(acc["out"], made)).otherwise(acc["out"]).alias("out"))

    def many(acc: Column, i: Column) -> Column:
        part = F.aggregate(F.slice(steps, i * STEP + 1, F.lit(STEP)), F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), one)
        return F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out")))[0]

    blocks = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, empty, many, lambda acc: acc["out"])


def _gated(gate: Column, value: Column) -> Column:
    return F.when(gate, value).otherwise(F.array().cast(SPAN))


def base(text: str = "text") -> dict[str, Column]:
    """The base kinds' span arrays."""
    c = F.col(text)
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= MIN_VALUE
    return {
        "assign": _gated(c.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), spans(c, ASSIGN, 0, "assign", long_enough)),
        "access": _gated(c.contains("AKIA"), spans(c, ACCESS, 1, "access")),
        "hex": _gated(c.rlike(HEX), spans(c, HEX, 2, "hex")),
    }


def may_link(text: str = "text") -> Column:
    """Whether a text can hold weak candidates and parts at all: a cheap test that all which do pass."""
    c = F.col(text)
    parts = c.contains("AKIA") | c.contains("://") | c.rlike(r"(?i)client_?id|access_?key|account_?id|user_?name|endpoint|hostname")
    return F.coalesce(parts & c.rlike(r"[A-Za-z0-9+/_=-]{20}"), F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, strong, parts, weak) for each row of docs: span arrays, without the text.

    parts are access identifiers, other identifiers and endpoints.
    """
    c = F.col("text")
    rows = docs.select("doc_id", F.md5("text").alias("key"), "text", may_link().alias("may"), *[v.alias(k) for k, v in base().items()])
    rows = rows.withColumn("identifier", _gated(F.col("may") & c.rlike(r"(?i)client_?id|access_?key|account_?id|user_?name"), spans(c, IDENTIFIER, RANK_IDENTIFIER, "identifier")))
    rows = rows.withColumn("endpoint", _gated(F.col("may") & (c.contains("://") | c.rlike("(?i)endpoint|hostname")), spans(c, ENDPOINT, RANK_ENDPOINT, "endpoint")))
    rows = rows.withColumn("parts", F.concat("access", "identifier", "endpoint")).withColumn("strong", F.array_sort(F.concat("assign", "access", "hex")))
    named = lambda p, m: F.when(p.rlike(NAMED) | m.rlike(ASSIGNED), RANK_NAMED).otherwise(RANK_WEAK)
    rows = rows.withColumn("weak", _gated(F.col("may") & (F.size("parts") > 0), spans(c, WEAK, RANK_WEAK, "weak", ranked=named)))
    return rows.select("doc_id", "key", "strong", "parts", "weak")


def linked(digests: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (key, linked): the weak spans of a text whose scope complementary parts overlap."""
    rows = digests.where((F.size("weak") > 0) & (F.size("parts") > 0)).dropDuplicates(["key"])
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / radius), F.floor(b / radius)))
    weak = rows.select("key", F.explode("weak").alias("w"))
    held = rows.select("key", F.explode(F.concat("strong", "parts")).alias("s")).select("key", "s", bins(F.col("s.start"), F.col("s.end")).alias("bin"))
    free = weak.select("key", "w", bins(F.col("w.start"), F.col("w.end")).alias("bin")).join(held, ["key", "bin"])
    taken = free.where("s.start < w.end and w.start < s.end").select("key", "w").distinct()
    part = rows.select("key", F.explode("parts").alias("p")).select("key", "p", bins(F.col("p.start"), F.col("p.end")).alias("bin"))
    scopes = weak.select("key", "w", bins(F.greatest(F.lit(0), F.col("w.start") - radius), F.col("w.end") + radius).alias("bin"))
    near = (F.col("p.start") < F.col("w.end") + radius) & (F.col("w.start") - radius < F.col("p.end"))
    complete = (F.col("p.rank") != RANK_ENDPOINT) | (F.col("w.rank") == RANK_NAMED)
    found = scopes.join(part, ["key", "bin"]).where(near & complete).select("key", "w").distinct().join(taken, ["key", "w"], "left_anti")
    plain = F.struct(F.col("w.start").alias("start"), F.lit(RANK_WEAK).alias("rank"), F.col("w.end").alias("end"), F.lit("weak").alias("kind"))
    return found.groupBy("key").agg(F.array_sort(F.collect_list(plain)).cast(SPAN).alias("linked"))


def scan(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, key, strong, linked) for each row of docs; the digest is a written table, so texts are read once.

    Only rows with candidates and parts are joined with their links; the others go past the shuffle.
    """
    rows, _ = written(digest(docs.select("doc_id", "text")), "secrets")
    candidate = (F.size("weak") > 0) & (F.size("parts") > 0)
    found = linked(rows, radius).withColumnRenamed("key", "k2")
    joined = rows.where(candidate).join(found, F.col("key") == F.col("k2"), "left")
    joined = joined.select("doc_id", "key", "strong", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))
    return joined.unionByName(rows.where(~candidate).select("doc_id", "key", "strong", F.array().cast(SPAN).alias("linked")))


def rendered(span_array: str | Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(span_array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, every: Column, mark: str) -> Column:
    """A text with its sorted spans replaced; spans that meet become one mark.

    What stays is cut from the text's UTF-32 bytes, where a position needs no search. A
    span's reach is the farthest end so far, summed step by step as in spans().
    """
    last = F.struct(F.lit(-1).alias("far"), F.array().cast("array<struct<start:int,far:int,fresh:boolean>>").alias("out"))

    def one(acc: Column, s: Column) -> Column:
        far = F.greatest(acc["far"], s["end"])
        row = F.array(F.struct(s["start"].alias("start"), far.alias("far"), (s["start"] > acc["far"]).alias("fresh")))
        return F.struct(far.alias("far"), F.concat(acc["out"], row).alias("out"))

    def many(acc: Column, i: Column) -> Column:
        part = F.aggregate(F.slice(every, i * STEP + 1, F.lit(STEP)), F.struct(acc["far"].alias("far"), F.array().cast("array<struct<start:int,far:int,fresh:boolean>>").alias("out")), one)
        return F.transform(F.array(part), lambda p: F.struct(p["far"].alias("far"), F.concat(acc["out"], p["out"]).alias("out")))[0]

    reach = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / STEP).cast("int")), last, many, lambda acc: acc["out"])

    def cut(r: Column, wide: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.get(r, i)["fresh"])
        # Each mark is preceded by what stands between the end before it and its start.
        begins = F.concat(F.array(F.lit(0)), F.transform(F.filter(fresh, lambda i: i > 0), lambda i: F.get(r, i - 1)["far"]), F.array(F.element_at(r, -1)["far"]))
        ends = F.concat(F.transform(fresh, lambda i: F.get(r, i)["start"]), F.array((F.octet_length(wide) / 4).cast("int")))
        kept = F.zip_with(begins, ends, lambda b, e: F.decode(F.substring(wide, b * 4 + 1, (e - b) * 4), "UTF-32"))
        return F.array_join(kept, mark)

    # A one-element array binds values once.
    made = F.transform(F.array(F.struct(reach.alias("r"), F.encode(text, "UTF-32").alias("wide"))), lambda x: cut(x["r"], x["wide"]))[0]
    return F.when(F.size(every) > 0, made).otherwise(text)


def redacted(docs: DataFrame, radius: int = RADIUS, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text replaced by the mark, and n_chars set anew where there is such a column.

    Texts that cannot hold linked secrets are masked where they stand; the others meet their links by md5.
    """
    columns = docs.columns
    may = docs.where(may_link())
    rows, _ = written(digest(may.select("doc_id", "text")).where((F.size("weak") > 0) & (F.size("parts") > 0)), "secrets")
    found = linked(rows, radius).withColumnsRenamed({"key": "__key", "linked": "__linked"})
    none = F.array().cast(SPAN)
    out = may.join(found, F.md5("text") == F.col("__key"), "left").drop("__key")
    out = out.unionByName(docs.where(~may_link()).withColumn("__linked", none))
    out = out.withColumn("__spans", F.array_sort(F.concat(*base().values(), F.coalesce("__linked", none))))
    out = out.withColumn("text", masked(F.col("text"), F.col("__spans"), mark))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
