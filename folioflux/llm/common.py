"""What the corpus operators share: tables in the shared folder, folds and connected components."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



class _Made(threading.local):
    """Tables of written() that are still there, by thread, so that runs side by side leave each other's alone."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets one below its warehouse; on a cluster that is an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read back: lineage ends here.

    What nobody has dropped by then goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _located(spark, path)
    fs.deleteOnExit(at)
    _made.paths.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by written() that no plan reads any more."""
    for path in paths:
        fs, at = _located(spark, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
        if path in _made.paths:
            _made.paths.remove(path)


def mark() -> int:
    """How many tables of written() there are; for dropped_since()."""
    return len(_made.paths)


def dropped_since(spark: SparkSession, at: int, keep: str | None = None) -> None:
    """Delete the tables made since mark() gave at, but for one: what read them has been written."""
    dropped(spark, *[p for p in _made.paths[at:] if p != keep])


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(-1))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable, for every node of the undirected edges (a, b): rows (node, component).

    Alternating large-star and small-star steps. Each round is a written table, so
    no lineage grows and lost executors cost one round at most. Null ends and
    loops are left out; no edges give an empty table.
    """
    spark = edges.sparkSession
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links, path = written(links.distinct(), "star")
    state = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        fresh, fresh_path = written(small.where("u <> v").distinct(), "star")
        row = fresh.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        dropped(spark, path)
        links, path = fresh, fresh_path
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
