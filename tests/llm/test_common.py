import glob
import time

from pyspark.sql import functions as F

from tideq.llm import common


def test_written_tables_leave_no_shuffle_behind(spark):
    files = lambda: set(glob.glob("/tmp/blockmgr-*/*/shuffle_*"))
    before, setting = files(), spark.conf.get(common.CLEANUP, None)
    table = common.written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(common.CLEANUP, None) == setting
    assert table.count() == 1000 and table.agg(F.sum("count")).first()[0] == 100_000
