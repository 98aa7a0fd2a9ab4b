"""Command line: ingest, sync, inspect, query and eval over a store. Exit codes: 0 fine, 1 other errors, 2 usage, 3 settings, 4 provider, 5 store, 6 a metric below its floor."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioflux.config import Settings, load_dotenv
from folioflux.errors import ConfigError, FolioError, ProviderError, StoreError
from folioflux.functions import text as T
from folioflux.operators import context, evaluation, retrieval
from folioflux.operators.chunking import recursive_chunks
from folioflux.plans import rag
from folioflux.sources import loaders

CODES = ((ConfigError, 3), (ProviderError, 4), (StoreError, 5), (FolioError, 1))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflux", description=__doc__)
    p.add_argument("--store")
    p.add_argument("--json", action="store_true")
    p.add_argument("--env-file")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "sync"):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("--glob", default="**/*")
        s.add_argument("--ignore", action="append", default=[])
        if name == "sync":
            s.add_argument("--apply", action="store_true")
            s.add_argument("--max-delete", type=float, default=0.5)
    sub.add_parser("inspect")
    s = sub.add_parser("query")
    s.add_argument("question")
    s.add_argument("-k", type=int, default=8)
    s.add_argument("--mode", choices=("dense", "bm25", "hybrid"), default="hybrid")
    s.add_argument("--filter", help="a metadata filter as JSON")
    s = sub.add_parser("eval")
    s.add_argument("items")
    s.add_argument("--thresholds")
    s.add_argument("--mode", choices=("dense", "bm25", "hybrid"), default="hybrid")
    return p


def run(args, spark: SparkSession, settings: Settings) -> tuple[dict, int]:
    found = rag.build(spark, settings.store, model=settings.model, mode=getattr(args, "mode", "hybrid"), chunker=lambda d: recursive_chunks(d, settings.chunk_tokens, settings.chunk_overlap))
    store = found.store
    if args.command == "ingest":
        return found.ingest_path(args.root, args.glob, tuple(args.ignore)), 0
    if args.command == "sync":
        return found.sync_path(args.root, args.glob, tuple(args.ignore), args.apply, args.max_delete), 0
    if store.manifest() is None:
        raise StoreError("there is no index", store=settings.store)
    tables = store.tables()
    if args.command == "inspect":
        n = tables["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks"))
        rows = tables["documents"].select("doc_id", "source_uri").join(n, "doc_id", "left").na.fill(0).orderBy("source_uri").limit(1000).collect()
        return {"model": store.manifest()["model"], "documents": [r.asDict() for r in rows]}, 0
    if args.command == "query":
        found.k = retrieval.check_k(args.k)
        got = found.query(spark.createDataFrame([(0, args.question)], "query_id int, text string"), json.loads(args.filter) if args.filter else None)
        answered = got["answers"].first()
        if answered["error"]:
            raise ProviderError(answered["error"])
        cited = got["citations"].select("label", "source_uri", "start_char", "end_char").orderBy("label").collect()
        return {"answer": answered["answer"], "citations": [r.asDict() for r in cited]}, 0
    items = loaders.load_items(spark, args.items)
    gold = items.select("query_id", F.posexplode("gold").alias("gold_idx", "g")).select("query_id", "gold_idx", "g.source_uri", "g.quote")
    gold = evaluation.resolve_spans(gold, tables["documents"])
    q = items.select("query_id", "text")
    hits = found.retrieve(q, k=10).persist()
    metrics = evaluation.evaluate_retrieval(q, hits, gold, context.insufficient(q, hits)).persist()
    values = {r["metric"]: r["value"] for r in metrics.collect()}
    failed = []
    if args.thresholds:
        failed = [r["metric"] for r in evaluation.gate(metrics, loaders.load_thresholds(spark, args.thresholds)).where("not passed").collect()]
    return {"metrics": values, "below": failed}, 6 if failed else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.env_file:
            load_dotenv(args.env_file)
        settings = Settings.load(store=args.store)
        payload, code = run(args, spark or SparkSession.builder.appName("folioflux").getOrCreate(), settings)
    except FolioError as e:
        print(T.re.sub(T.CREDENTIAL, "[REDACTED]", str(e)), file=sys.stderr)
        return next(code for kind, code in CODES if isinstance(e, kind))
    print(json.dumps(payload, default=str) if args.json else "\n".join(f"{k}: {v}" for k, v in payload.items()))
    return code


if __name__ == "__main__":
    sys.exit(main())
