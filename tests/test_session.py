"""Tables that a run stores."""

import time

from pyspark.sql import functions as F

from provena import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = disk.getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(CLEANUP, None)
    df = spark.range(10_000, numPartitions=5).groupBy((F.col("id") % 100).alias("k")).count()
    out = session.stored(df)
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert out.count() == df.count() == df.count() == 100
