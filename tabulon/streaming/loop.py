"""The question-answering loop as a stream: new prompts are answered and upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabulon.operators.store import misses, respond


def answer_stream(prompts: DataFrame, model: Callable[[str], str | None], store: str, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Answer a stream of prompts (prompt_key, prompt) into a Parquet store partitioned by batch.

    A prompt that an earlier batch answered isn't asked again. A batch that is run again after a failure
    overwrites its own partition, so each prompt is stored once.
    """
    where = f"{store.rstrip('/')}/batch="

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["prompt_key"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(path):
            old = [s.getPath().toString() for s in files.listStatus(path) if "batch=" in s.getPath().getName() and int(s.getPath().getName().split("=")[1]) < batch_id]
            if old:
                fresh = misses(fresh, spark.read.schema("prompt_key string, response string").parquet(*old))
        respond(fresh, model).where("response is not null").write.mode("overwrite").parquet(f"{where}{batch_id}")

    return prompts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
