"""What the training-data operators share: table access and byte-balanced Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose `column` holds about max_bytes; a longer single row stays whole."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", max_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow over slices of at most about max_bytes of `column`."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                yield fn(part)

    return df.mapInArrow(run, schema)


_own: list = [None, None]


def worker_own(key: object, make: Callable[[], object]) -> object:
    """What make() gives for this key, kept in a Python worker until another key is asked for.

    Workers are used again by later stages, so that what each operator keeps would add up; one thing at a time is held.
    """
    if _own[0] != key:
        _own[:] = None, None
        pa.default_memory_pool().release_unused()
        _own[:] = key, make()
    return _own[1]


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns; others, whatever their names, stay behind."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def ready(df: DataFrame) -> DataFrame:
    """Makes sure that checkpoint() has a folder: the one that spark.checkpoint.dir names, or, without a cluster, one of this run."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder of spark.checkpoint.dir and read again: lineage is cut, columns stay compact.

    What led to it is not needed again.
    """
    ready(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan still to be run reads; also lets go of finished shuffles."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()
