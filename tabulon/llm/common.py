"""What the language-data operators share: reading tables, scratch tables, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where that is unset, one of our own.

    On a local master that is a temporary folder. On a cluster it is a folder of the warehouse, as no machine's own will do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = f"file://{tempfile.mkdtemp(prefix='tabulon-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, path: str):
    """A path of the shared folder and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a path when the driver's JVM ends."""
    where, files = _path(spark, path)
    files.deleteOnExit(where)


#: The tables written since each open ``scratch`` began.
_open: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Remove, at its end, the tables that ``written`` made within: nothing may read them any more."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    The rows survive a lost executor, are computed once, and the table's size on disk is known to
    the planner, so that it broadcasts the table only below spark.sql.autoBroadcastJoinThreshold.
    The files go at the end of the ``scratch`` they were made in, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulon/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    if _open:
        _open[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by ``written`` that nothing will read again."""
    path = getattr(df, "_scratch", None)
    if path:
        remove(df.sparkSession, path)


def pack(batches: list[pa.RecordBatch], level: int = 3) -> bytes:
    """Rows as one compressed piece."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for batch in batches:
            out.write_batch(batch)
    return zstandard.ZstdCompressor(level=level).compress(sink.getvalue())


def unpack(piece: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(piece))


#: A key that one row in so many has, or more of them, is common; so many are, at most.
COMMON = 1000


def spread_join(rows: DataFrame, label: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``label``, a written table of each key once; its ``weight`` columns sum to ``total``.

    Rows of common keys, by weight, meet their label where they are, as those labels are COMMON at most; the others are
    shuffled to theirs. So no key brings more than a small part of the rows into one task. Keys aren't null.
    """
    common = F.col(weight) >= F.lit(total / COMMON)
    few = F.broadcast(label.where(common))
    rest = rows.join(few.select(key), key, "left_anti").join(label.where(~common), key)
    return rows.join(few, key).unionByName(rest)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold that no model learns from: crc32 of the id as text divides by 5. A null id is held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def share_of(n: int, wanted: int) -> float:
    """The share of ``n`` rows that gives about ``wanted`` of them."""
    return min(1.0, wanted / n) if n else 1.0


def hash_below(share: float, *cols: str, seed: int = 17) -> Column:
    """A repeatable choice of about ``share`` of the rows, by a hash of ``cols``."""
    if share >= 1.0:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
