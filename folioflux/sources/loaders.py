"""Files as documents: text, Markdown, HTML and PDF from a folder tree; evaluation items and thresholds from JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioflux.errors import EvaluationError
from folioflux.functions import html as H
from folioflux.functions import text as T

MAX_FILE = 20 * 1024 * 1024
MAX_PAGES = 1000
PAGE_BREAK = "\n\f\n"
#: Media types by suffix.
KINDS = {".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf"}


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("reason", StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """UTF-8 with or without mark, else Latin-1; a NUL byte is no text."""
    out = []
    for data in content:
        if data is None:
            out.append((None, None))
        elif b"\0" in data:
            out.append((None, "NUL byte"))
        else:
            try:
                out.append((bytes(data).decode("utf-8-sig"), None))
            except UnicodeDecodeError:
                out.append((bytes(data).decode("latin-1"), None))
    return pd.DataFrame(out, columns=["text", "reason"])


def load_directory(spark: SparkSession, root: str, glob: str = "**/*", ignore: Iterable[str] = (), max_file: int = MAX_FILE, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Every matching file as (source_uri, status, reason, doc_id, text, content_hash, mime, title).

    status is loaded, skipped (unrecognised extension) or failed; files outside the glob
    or below ignored names are left out. Sizes are checked before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    bare = lambda p: F.regexp_replace(p, r"^file:/+", "/")
    prefix = "/" + base.removeprefix("file:").lstrip("/") if base.startswith("file:") else base
    rows = files.withColumn("source_uri", F.substring(bare(F.col("path")), F.lit(len(prefix) + 1), F.length("path")))
    rows = rows.where(T.glob_match(F.col("source_uri"), glob))
    for name in ignore:
        rows = rows.where(~T.glob_match(F.col("source_uri"), f"**/{name}/**") & ~T.glob_match(F.col("source_uri"), f"**/{name}"))
    suffix = F.lower(F.regexp_extract("source_uri", r"(\.[^./]*)$", 1))
    mime = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), suffix)
    rows = rows.withColumn("mime", mime).withColumn("large", F.col("length") > max_file)
    wanted = F.col("mime").isNotNull() & ~F.col("large")
    plain = decoded(F.when(wanted & (F.col("mime") != KINDS[".pdf"]), F.col("content")))
    rows = rows.withColumn("plain", plain)
    page = H.html_parts(F.when(F.col("mime") == "text/html", F.col("plain.text")))
    rows = rows.withColumn("page", page)

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("reason", StringType())]))
    def pages(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            if data is None:
                out.append((None, None))
            elif pdf is None:
                out.append((None, "no PDF parser is configured"))
            else:
                try:
                    found = pdf(bytes(data))
                    out.append((None, "too many pages") if len(found) > MAX_PAGES else (PAGE_BREAK.join(found), None))
                except Exception as e:  # noqa: BLE001  one file never ends the load
                    out.append((None, str(e)))
        return pd.DataFrame(out, columns=["text", "reason"])

    rows = rows.withColumn("pdf", pages(F.when(wanted & (F.col("mime") == KINDS[".pdf"]), F.col("content")))).drop("content")
    text = F.when(F.col("mime") == "text/html", F.col("page.text")).when(F.col("mime") == KINDS[".pdf"], F.col("pdf.text")).otherwise(F.col("plain.text"))
    reason = F.when(F.col("mime").isNull(), "unrecognized extension").when(F.col("large"), "file too large").otherwise(F.coalesce("plain.reason", "pdf.reason"))
    status = F.when(F.col("mime").isNull(), "skipped").when(F.col("large") | text.isNull(), "failed").otherwise("loaded")
    rows = rows.select("source_uri", status.alias("status"), reason.alias("reason"), text.alias("text"), "mime", F.col("page.title").alias("title"))
    return rows.select("source_uri", "status", "reason", T.stable_doc_id(F.col("source_uri")).alias("doc_id"), "text", T.content_hash(F.col("text")).alias("content_hash"), "mime", "title")


def load_corpus(spark: SparkSession, root: str, glob: str = "**/*") -> DataFrame:
    """A folder whose files must all load: normalised documents ordered by source_uri."""
    rows = load_directory(spark, root, glob).where("status <> 'skipped'")
    fail = F.raise_error(F.concat(F.lit("corpus file failed: "), F.col("source_uri")))
    text = F.when(F.col("status") == "failed", fail).otherwise(T.normalize_text(F.col("text")))
    return rows.withColumn("text", text).drop("status", "reason").orderBy("source_uri")


ITEM_KEYS = {"id", "question", "gold", "answer", "tags"}


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from JSON lines: (query_id, text, gold, answer, tags). Mistakes are named by line."""
    lines = [(i, x) for i, x in enumerate(spark.sparkContext.textFile(path).toLocalIterator(), 1) if x.strip()]
    rows, seen = [], set()
    for number, line in lines:
        where = f"{path}:{number}"
        try:
            item = json.loads(line)
        except ValueError as e:
            raise EvaluationError("not JSON", where=where) from e
        if not isinstance(item, dict) or set(item) - ITEM_KEYS:
            raise EvaluationError("unknown keys", where=where)
        if not all(isinstance(item.get(k), str) and item[k].strip() for k in ("id", "question")):
            raise EvaluationError("id and question must be text", where=where)
        if item["id"] in seen:
            raise EvaluationError("repeated id", where=where)
        seen.add(item["id"])
        gold = item.get("gold", [])
        if not isinstance(gold, list) or not all(isinstance(g, dict) and set(g) == {"source_uri", "quote"} and all(isinstance(v, str) and v for v in g.values()) for g in gold):
            raise EvaluationError("gold must list source_uri and quote", where=where)
        rows.append((item["id"], item["question"], [(g["source_uri"], g["quote"]) for g in gold], item.get("answer"), item.get("tags", [])))
    if not rows:
        raise EvaluationError("no items", where=path)
    return spark.createDataFrame(rows, "query_id string, text string, gold array<struct<source_uri:string,quote:string>>, answer string, tags array<string>")


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(metric, baseline, tolerance) from a JSON mapping."""
    found = json.loads("\n".join(spark.sparkContext.textFile(path).collect()))
    if not isinstance(found, dict) or not found:
        raise EvaluationError("thresholds must be a mapping", where=path)
    rows = []
    for metric, x in found.items():
        if not isinstance(x, dict) or set(x) != {"baseline", "tolerance"} or x["tolerance"] < 0:
            raise EvaluationError("a threshold has baseline and tolerance", where=path, metric=metric)
        rows.append((metric, float(x["baseline"]), float(x["tolerance"])))
    return spark.createDataFrame(rows, "metric string, baseline double, tolerance double")
