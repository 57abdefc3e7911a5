"""Tables that are written once to the shared folder, so that plans stay short and lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or, where that is unset, a temporary folder on a local master and one of the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = f"file://{tempfile.mkdtemp(prefix='tabulon-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a written table, which goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulon/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
