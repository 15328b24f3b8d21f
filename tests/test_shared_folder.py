"""The checkpoint step: shuffle files behind a checkpoint go, the rows stay."""

import time

from pyspark.sql import functions as F

from grantlake.sources.shared import FILES_GO, cut_lineage


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = disk.getAllFiles()
        names = (files.apply(k).getName() for k in range(files.size()))
        return {name for name in names if name.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(FILES_GO, "false")
    grouped = spark.range(1000).groupBy(F.pmod("id", F.lit(10)).alias("k")).count()
    kept = cut_lineage(grouped)
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(FILES_GO, "false") == setting
    assert sorted(map(tuple, kept.collect())) == [(k, 100) for k in range(10)]
    assert sorted(map(tuple, grouped.collect())) == [(k, 100) for k in range(10)]
