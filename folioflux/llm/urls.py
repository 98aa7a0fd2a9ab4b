"""URL filters: pattern rules, indexed by their rarest literal token.

A URL's tokens fetch candidate rules from the index, and only those run their regular
expressions; the longest host/path rule wins, and without one the block patterns decide.
DataFrame operations only.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and
verdict allow; rows repeat as they are; other columns play no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: host/path rules as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Patterns over the lower-cased URL that block what no rule fits, with the tokens that any URL they fit holds whole.
PATTERNS = (
    (r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    (r"://([^/?#]*[.-])?cheap-pills\.", ("cheap", "pills")),
    (r"://([^/?#]*[.-])?spam-farm\.", ("spam", "farm")),
    (r"://([^/?#]*[.-])?ads-track\.", ("ads", "track")),
    (r"://([^/?#]*[.-])?adserver[.-]", ("adserver",)),
    (r"://([^/?#]*[.-])?porn[.-]", ("porn",)),
    (r"[/._-]viagra[/._-]", ("viagra",)),
    (r"[/._-]malware[/._-]", ("malware",)),
)
#: Rules that are broadcast at most; a larger index is joined by shuffles.
BROADCAST_RULES = 100_000
_SPLIT = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or without ://."""
    c = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.locate("://", c) > 0, F.expr(f"substring(coalesce({url}, ''), locate('://', coalesce({url}, '')) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _literals(host: str, path: str) -> list[str]:
    """Tokens that stand whole in any URL a rule fits: a path's last piece may go on."""
    whole = path if path.endswith("/") else path.rpartition("/")[0]
    return [t for t in re.split(r"[^0-9a-z]+", f"{host} {whole.lower()}") if t]


def compiled(rules=RULES, patterns=PATTERNS) -> list[dict]:
    """The rule table: id, verdict, name (null for patterns), regex over host and path or over the URL, literals."""
    rows = []
    for verdict, name in rules:
        host, slash, path = name.partition("/")
        rows.append({"verdict": verdict, "name": name, "regex": rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", "literals": _literals(host, slash + path)})
    rows += [{"verdict": "block", "name": None, "regex": regex, "literals": list(literals)} for regex, literals in patterns]
    return [r | {"id": i} for i, r in enumerate(rows)]


def tokens(url: str = "url") -> Column:
    low = F.translate(F.coalesce(F.col(url), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(low, _SPLIT), lambda t: t != ""))


def index(pages: DataFrame, rules: list[dict]) -> DataFrame:
    """(token, id, verdict, name, regex): each rule under the literal that fewest pages hold; ties by token. "" for a rule without literals."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(r["id"], r["verdict"], r["name"], r["regex"], r["literals"] or [""]) for r in rules], "id int, verdict string, name string, regex string, literals array<string>")
    words = table.select(F.explode("literals").alias("token")).distinct()
    words = F.broadcast(words) if len(rules) <= BROADCAST_RULES else words
    counts = pages.select(F.explode(tokens()).alias("token")).join(words, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    best = table.withColumn("token", F.explode("literals")).join(counts, "token", "left").groupBy("id", "verdict", "name", "regex")
    return best.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))


def judge(pages: DataFrame, rules=RULES, patterns=PATTERNS) -> DataFrame:
    """Rows (page_id, url, host, path, rule, verdict, fetched), one for each row of pages."""
    made = compiled(rules, patterns)
    bare = sum(not r["literals"] for r in made)
    found = index(pages, made).withColumnRenamed("verdict", "says")
    found = F.broadcast(found) if len(made) <= BROADCAST_RULES else found
    host, path = host_path()
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rows = rows.select("*", F.posexplode_outer(F.concat(F.array(F.lit("")), tokens())).alias("at", "token"))
    joined = rows.join(found, "token", "left")
    low = F.translate(F.coalesce("url", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    subject = F.when(F.col("name").isNotNull(), F.concat("host", "path")).otherwise(low)
    fits = F.col("regex").isNotNull() & (F.col("host") != "") & F.regexp_like(subject, F.col("regex"))
    named = F.when(fits & F.col("name").isNotNull(), F.struct(F.length("name").alias("n"), "name", "says"))
    summed = joined.groupBy("page_id", "url", "host", "path").agg(
        F.max(named).alias("best"),
        F.max((fits & F.col("name").isNull()).cast("int")).alias("hit"),
        F.count("id").alias("fetched"),
        (F.sum((F.col("at") == 0).cast("int")) / max(1, bare)).cast("int").alias("copies"),
    )
    verdict = F.when(F.col("best").isNotNull(), F.col("best")["says"]).when(F.col("hit") == 1, "block").otherwise("allow")
    return summed.select(
        "page_id", "url", "host", "path", F.col("best")["name"].alias("rule"), verdict.alias("verdict"), "fetched", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__c")
    ).drop("__c")
