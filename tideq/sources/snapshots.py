"""The task table as a snapshot into which changes are written back.

Rows are dealt to folders by queue and by a slot of their id, which no change of a
task moves. A write-back rewrites the folders that hold a changed task and no
other. A deleted task stays as a row marked deleted, so that no folder is left with
rows that are gone, and is passed over when reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _slotted(tasks: DataFrame, slots: int) -> DataFrame:
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in tasks.columns else F.lit(False)
    return tasks.withColumn("deleted", deleted).withColumn("slot", F.pmod(F.xxhash64("queue", "id"), F.lit(slots)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    """Each folder's rows are written by one task, so that a folder is few files."""
    rows.repartition("queue", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("queue", "slot").parquet(path)


def create(tasks: DataFrame, path: str, slots: int) -> None:
    """A new snapshot; a folder should hold some hundred megabytes at most, so ``slots`` grows with the table."""
    _write(_slotted(tasks, slots), path)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "false").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return read_all(spark, path).where("not deleted").drop("deleted", "slot")


def upsert(spark: SparkSession, path: str, changes: DataFrame, slots: int, staging: str) -> None:
    """Writes ``changes`` (all columns of a task, and deleted if any is) over the tasks of the same queue and id, or beside them if there are none.

    (queue, id) must be unique in ``changes``. ``slots`` as at the creation. The new folders are written to ``staging`` first and
    then over the old ones: a run that is lost between can be repeated.
    """
    new = _slotted(changes, slots)
    held = read_all(spark, path)
    touched = held.join(new.select("queue", "slot").distinct(), ["queue", "slot"], "left_semi")
    rest = touched.join(new.select("queue", "id"), ["queue", "id"], "left_anti")
    new.unionByName(rest.select(new.columns)).repartition("queue", "slot").write.mode("overwrite").parquet(staging)
    _write(spark.read.parquet(staging), path)
