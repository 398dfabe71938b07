"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what lies between words, as Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    it is unset, a temporary one in local mode (tests); an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own.setdefault("dir", None) or tempfile.mkdtemp(prefix="plait-")
        _own["dir"] = path
    return path.rstrip("/")


_own: dict[str, str | None] = {}


def materialize(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the
    lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plait-{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plait_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing to come reads."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__.pop("_plait_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """body(v) with v evaluated once a row. Catalyst may otherwise inline a
    computed array into a lambda, which evaluates it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != F.lit(""))


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of whole texts: what is worked out for a part is held several times over."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def release() -> None:
    """Give freed memory back to the system: Python workers that wait for their
    next task would keep it from the executor's others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def releasing(run):
    """run, a function of a task's batches or of a group, that gives its memory
    back when it has ended: run's own variables are gone by then."""

    def batches(source):
        yield from run(source)
        release()

    def group(table):
        out = run(table)
        release()
        return out

    return batches if inspect.isgeneratorfunction(run) else group


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
