"""Tables and files that the engine reads and writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def local_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified, text) of the files of a folder tree, read where the tasks run."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, role, text, bad) of JSON lines: role, else speaker, else `unknown`; a line that is no JSON is bad."""
    raw = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    get = lambda name: F.get_json_object("line", f"$.{name}")
    return raw.select("line", F.coalesce(get("role"), get("speaker"), F.lit("unknown")).alias("role"), F.coalesce(get("text"), get("content")).alias("text"), F.expr("try_parse_json(line) is null").alias("bad"))


def write_points(points: DataFrame, path: str, partition: str | None = None) -> None:
    """points instead of all that stands at path; see upsert_points for a write that keeps other points."""
    writer = points.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def upsert_points(points: DataFrame, path: str, to: str, key: str = "point_id") -> None:
    """Write at `to` the points at path with those of points put in their place or added: doing it twice changes nothing.

    Of points that repeat a key one stays, the greatest by its columns. Files do not change, so the result is a new version."""
    rest = [c for c in points.columns if c != key]
    new = points.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*")
    old = points.sparkSession.read.parquet(path).join(new.select(key), key, "left_anti")
    old.unionByName(new, allowMissingColumns=True).write.parquet(to)


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder; a local one in local mode where spark.checkpoint.dir is unset."""
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if not kept.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="millrace-"))
        kept = context._jsc.sc().getCheckpointDir()
    return kept.get()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back."""
    _shared(df.sparkSession)
    return df.checkpoint()
