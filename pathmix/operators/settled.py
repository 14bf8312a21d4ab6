"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """That folder: spark.checkpoint.dir; where the session names none, a local master gets one of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pathmix-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Write the rows and read them back, so that loops keep short plans and survive losses; `old`, an earlier cut that
    nothing reads any more, is removed."""
    spark = df.sparkSession
    path = f"{shared(spark)}/pathmix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if old is not None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in {f.rpartition("/")[0] for f in old.inputFiles()}:
            if "/pathmix-" in name:
                gone = jvm.org.apache.hadoop.fs.Path(name)
                gone.getFileSystem(conf).delete(gone, True)
    return spark.read.schema(df.schema).parquet(path)
