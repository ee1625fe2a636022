"""What several operators share: written intermediate tables, size-checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (id, label) that a broadcast may hold: about 16 MB in each executor.
BROADCAST_ROWS = 500_000


#: What has been written to the shared folder, and broadcast, and not been released.
_HELD: list = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where driver and executors are one process, and the session names none, as in
    tests, a temporary folder is set; on a cluster the setting is needed."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sparkclade-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, read by column."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _HELD.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value):
    """value, broadcast; what is sent must have a size that doesn't grow with the data."""
    _HELD.append(spark.sparkContext.broadcast(value))
    return _HELD[-1]


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables written, and broadcasts sent, within the block are deleted at its end: results must have been stored by then."""
    before = len(_HELD)
    try:
        yield
    finally:
        made, _HELD[before:] = _HELD[before:], []
        for x in made:
            if isinstance(x, str):
                remove(spark, x)
            else:
                x.destroy()


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_KEPT: dict = {}


def kept(key, make):
    """What an operator keeps in a Python worker from task to task: one thing at a time, so that another's cache is let go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    _KEPT.clear()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many marks as it needs to differ from df's columns and from those before it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A hint to broadcast df if it is known to have few rows; beyond, the join is left to shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps: each is a min() aggregation, combined
    before the shuffle, and an equi-join that Spark can split where a node is hot.  The
    edges never leave the executors, and each round is written to the shared folder."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        sides = now.union(now.select("v", "u"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(low, "u")
        step = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(step)
        state = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))")).first()
        if state == before or not state[0]:
            break
        before = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct()) if state[0] else spark.createDataFrame([], "node bigint, root bigint")


__all__ = ["BROADCAST_ROWS", "components", "fresh", "kept", "let_go", "released", "remove", "scratch", "sent", "small", "table", "written"]
