"""Running a stream to its end over what there is, into a table."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Where many keys have state, and the only store that keeps timers and lists.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's ``spark.checkpoint.dir``, or a temporary one of a local master."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return str(named)


def event_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parquet*")


def start(stream: DataFrame, folder: str, available_now: bool = True) -> StreamingQuery:
    """``stream`` written as Parquet to ``folder``/rows; its progress is kept in ``folder``/progress, so that a lost run goes on where it was."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, STORE)
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/rows")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def finished(stream: DataFrame) -> DataFrame:
    """The rows that ``stream`` gives over all input that there is now."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid4()}"
    start(stream, folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
