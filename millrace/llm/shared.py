"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast or collected table may have this many rows at most; operators take a join beyond it.
BROADCAST_ROWS = 500_000

_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local one will do if all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext._jsc.sc()
        kept = context.getCheckpointDir()
        if not kept.isDefined() and not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = kept.get() if kept.isDefined() else "file://" + tempfile.mkdtemp(prefix="millrace-")
        if not kept.isDefined():
            context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_drop_tables)
    _tables.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_tables() -> None:
    for spark, path in _tables:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def text_rows(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The two columns that text operators read, and those to carry; other columns, of any name, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in carry])


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Strings as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Cut a batch so that each part has about most_bytes of text; a longer single text makes a part alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > most_bytes:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if len(size) > at:
        yield batch.slice(at)


def shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
