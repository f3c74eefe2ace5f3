"""Tables of the task model, read from Parquet or derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clock of all registered queries: operators take it as an argument.
NOW = "2024-01-20 00:00:00"

#: Task rows of the event table, in text that Spark and other engines read alike.
TASKS_SQL = """
select cast(event_id as string) as id, event_id as pos,
  case user_id % 3 when 0 then 'critical' when 1 then 'default' else 'low' end as queue,
  concat('event:', event_type) as type, props as payload,
  case when event_id % 20 < 6 then 'pending' when event_id % 20 < 8 then 'active' when event_id % 20 < 10 then 'scheduled'
       when event_id % 20 < 12 then 'retry' when event_id % 20 < 14 then 'archived' when event_id % 20 < 17 then 'completed'
       else 'aggregating' end as state,
  case when event_id % 20 >= 17 or event_id % 40 = 8 then concat('g', cast(user_id % 8 as string)) else '' end as group_key,
  cast(3 as int) as retry, cast(user_id % 5 as int) as retried, ts as enqueued_at,
  ts + interval '5' day as lease_expires_at, ts + interval '6' day as process_at, cast(3600 as bigint) as retention
from {events} where ts <= timestamp '2024-01-20 00:00:00'
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TASKS_SQL, events=read(spark, sf_dir, "events"))


def save_snapshot(tasks: DataFrame, path: str) -> None:
    """A snapshot partitioned by what its readers filter on, so that they read those folders only."""
    tasks.write.mode("overwrite").partitionBy("queue", "state").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
