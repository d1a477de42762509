"""Cutting lineage in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder below ``spark.checkpoint.dir``; where none is named, a local master gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="castellan-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        atexit.register(_remove, spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jvm is not None and sc._jsc is not None and not sc._jsc.sc().isStopped():
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder, which goes when the driver's Python ends."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stream_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream yields from what its source holds now, as a table; with ``complete`` its last state."""
    spark = stream.sparkSession
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
