"""Helpers shared by the corpus operators: tables, checkpoints, components."""

from __future__ import annotations

import tempfile
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes the files of a query's shuffles when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, gets a
    temporary one if none is named.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return str(context.getCheckpointDir())


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into a Parquet table in the shared checkpoint folder, its lineage cut.

    Smaller than a checkpoint and read column by column; it stays until it is forgotten or the folder is cleared.
    Nothing reads the shuffles of the write again, so their files go with its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid4()}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def forget(*tables: DataFrame, but: tuple[DataFrame, ...] = ()) -> None:
    """Remove the tables of :func:`written` that ``tables`` read, but for those that ``but`` read: nothing that isn't written yet may need them."""
    folders = set().union(*map(_folders, tables)) - set().union(*map(_folders, but))
    for folder in folders:
        if folder.rpartition("/")[2].startswith("table-"):
            spark = tables[0].sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (u, v); root is the smallest node reachable.

    In each round every node takes the smallest of itself and its neighbours, a
    grouped minimum that is combined before its shuffle; nodes with the same
    smallest one are contracted, and the edges between what is left go on. Edges
    shrink from round to round, and no adjacency list is built. At the end the
    rounds' steps are followed from each node to its root.
    A node without edges is not returned; self loops and nulls are dropped.
    """
    left = written(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if left.limit(1).count() == 0:
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).select("node", F.least("node", "root").alias("root")))
        steps.append(step)
        ends = (step.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "uv")
        moved = reduce(lambda a, b: a.join(b, b.columns[0]), ends, left).where("u_root <> v_root")
        left = written(moved.select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct())
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = steps.pop()
    while steps:
        onward = found.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        found = steps.pop().join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))
    return found


def broadcast_within(df: DataFrame, rows: int, size: Column | None = None, most: int = 16_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows and, by the summed ``size`` of a row, ``most`` bytes; else as it is, to be shuffled."""
    row = df.select((F.lit(8 * (len(df.columns) + 2)) if size is None else size).alias("size")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    return F.broadcast(df) if row["n"] <= rows and (row["bytes"] or 0) <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
