"""Helpers shared by the training-data operators.

Rows are passed between stages as DataFrames.  What must be read more than
once is written as Parquet under ``work_dir``, which lies in the shared folder
named by ``spark.checkpoint.dir``, so that it outlives any one executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.session import importable

#: Rows in one Arrow batch sent to Python; with texts of up to about a
#: megabyte this bounds a worker's memory.
ARROW_ROWS = 256
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null document id inside joins; it sorts before every other id.
NULL_ID = -(2**63)

_own_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table with Spark's own reader (any filesystem)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; a smaller user value stays.
    Let workers import this package."""
    importable(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),):
        now = spark.conf.get(key, None)
        if now is None or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path in the folder of ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made, set as checkpoint folder,
    and removed at exit; only a local master may do so, since executors of a
    cluster do not share it.
    """
    global _own_root
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if _own_root is None:
            _own_root = tempfile.mkdtemp(prefix="ridgeline-")
            atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
        base = f"file://{_own_root}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ridgeline-{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Hadoop's filesystem layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


_results: list[str] = []


def result(df: DataFrame, *roots: str) -> DataFrame:
    """Write what an operator returns to a folder of its own and drop the work
    folders it came from; ``release`` drops results that are not read again."""
    spark = df.sparkSession
    _results.append(path := work_dir(spark, "result"))
    out = spool(df, path)
    for root in roots:
        drop(spark, root)
    return out


def keep(path: str) -> None:
    """Count a folder that a returned table reads among the results."""
    _results.append(path)


def made() -> int:
    """How many results are kept so far."""
    return len(_results)


def release(spark: SparkSession, since: int = 0) -> None:
    """Drop the folders of all results, or of those ``made`` since then."""
    while len(_results) > since:
        drop(spark, _results.pop())


#: Codec of work tables, which are read a few times soon after.
CODEC = "snappy"


def spool(df: DataFrame, path: str, codec: str = CODEC) -> DataFrame:
    """Write ``df`` to ``path`` and return the table read back with its schema."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_key(name: str) -> Column:
    """A document id that is never null, for joins and grouping."""
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, UPPER.lower())


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], without: Iterable[str] = ()) -> pa.RecordBatch:
    """``batch`` with columns replaced in place, taken out or added at the end."""
    gone = set(without)
    names = [n for n in batch.schema.names if n not in gone]
    names += [n for n in new if n not in names]
    arrays = [new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def extended(schema: T.StructType, *more: tuple[str, T.DataType], without: Iterable[str] = ()) -> T.StructType:
    """The schema that ``with_columns`` gives for the same changes."""
    gone, added = set(without), dict(more)
    out = [T.StructField(f.name, added.get(f.name, f.dataType), True) for f in schema.fields if f.name not in gone]
    return T.StructType(out + [T.StructField(n, k, True) for n, k in more if n not in schema.fieldNames()])


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than ``most_bytes`` of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)
