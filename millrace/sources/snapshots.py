"""Point tables that are published whole or not at all: buckets of files, and one record for each version, which is the commit.

A version's record names for each bucket the version that wrote it last, so an upsert writes only the buckets that it touches and the
others stay as they are. Readers go by the newest record; what a publisher wrote without coming to its record is never read."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class PublishRefused(ValueError):
    """The points are not as many as was said, or another generation was published meanwhile."""


class PruneRefused(ValueError):
    """Pruning was asked for without the right to it, or of what is current."""


@dataclass
class Version:
    number: int
    generation: str
    count: int
    key: str
    schema: str
    buckets: dict[str, int] = field(default_factory=dict)  # bucket -> number of the version that holds it
    rows: dict[str, int] = field(default_factory=dict)


class _Folder:
    """A folder of the session's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = lambda *parts: self.jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *parts]))
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, text: str, *parts: str) -> None:
        """Write a file under another name, then give it its own, which must be free."""
        last, draft = self.path(*parts), self.path(*parts[:-1], "." + parts[-1])
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(last) or not self.fs.rename(draft, last):
            raise PublishRefused(f"version {parts[-1]} is there already")

    def delete(self, *parts: str) -> bool:
        return self.fs.delete(self.path(*parts), True)


def versions(spark: SparkSession, root: str) -> list[Version]:
    """The committed versions, the oldest first."""
    folder = _Folder(spark, root)
    return [Version(**json.loads(folder.read("versions", n))) for n in folder.names("versions") if not n.startswith(".")]


def _paths(root: str, version: Version, buckets: list[str]) -> list[str]:
    return [f"{root.rstrip('/')}/data/v={version.buckets[b]}/bucket={b}" for b in buckets if version.rows.get(b)]


def read_points(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """The points of a version, by default of the newest one."""
    known = version or (versions(spark, root) or [None])[-1]
    if known is None:
        raise FileNotFoundError(f"nothing was published at {root}")
    paths = _paths(root, known, list(known.buckets))
    return spark.read.schema(known.schema).parquet(*paths) if paths else spark.createDataFrame([], known.schema)


def publish(points: DataFrame, root: str, generation: str, expected: int, previous: str | None = None, key: str = "point_id", buckets: int = BUCKETS, between: Callable[[str], None] = lambda step: None) -> Version:
    """Put points (one stays of those that repeat a key, the greatest by its columns) in place of those of the same key or beside the others, as a
    new version of a generation.

    Refused, and nothing changes for readers: if the points are not `expected` many, or if the newest generation is not `previous`. A generation
    that is the newest already is not published again. Columns stay those of the first version. between is called with the name of each
    step that is done, before the next."""
    spark = points.sparkSession
    known = versions(spark, root)
    now = known[-1] if known else None
    if now and now.generation == generation:
        return now
    if (now.generation if now else None) != previous:
        raise PublishRefused(f"generation {now.generation if now else None} is published, not {previous}")
    schema = now.schema if now else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    columns = spark.createDataFrame([], schema).columns
    rest = [c for c in columns if c != key]
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("string").alias("bucket")
    new = points.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*", bucket)
    number = now.number + 1 if now else 1
    folder = _Folder(spark, root)
    folder.delete("data", f"v={number}")  # what a publisher left that did not come to its record
    touched = {r["bucket"]: r["count"] for r in new.groupBy("bucket").count().collect()}  # one row a bucket
    if sum(touched.values()) != expected:
        raise PublishRefused(f"{sum(touched.values())} points, not {expected}")
    between("counted")
    old_paths = _paths(root, now, [b for b in touched if b in now.buckets]) if now else []
    if old_paths:
        old = spark.read.schema(schema).parquet(*old_paths).withColumn("bucket", bucket)
        new = old.join(new.select(key), key, "left_anti").select(*columns, "bucket").unionByName(new.select(*columns, "bucket"))
    if touched:
        new.select(*columns, "bucket").write.partitionBy("bucket").parquet(f"{root.rstrip('/')}/data/v={number}")
    between("written")
    own = {}
    if touched:
        back = spark.read.schema(f"{schema}, `bucket` string").option("basePath", f"{root.rstrip('/')}/data/v={number}").parquet(f"{root.rstrip('/')}/data/v={number}")
        own = {r["bucket"]: r["count"] for r in back.groupBy("bucket").count().collect()}
    if any(own.get(b, 0) < n for b, n in touched.items()):
        raise PublishRefused("fewer points were written than were to be")
    rows = {**(now.rows if now else {}), **own}
    made = Version(number, generation, sum(rows.values()), key, schema, {**(now.buckets if now else {}), **dict.fromkeys(own, number)}, rows)
    between("checked")
    folder.write_new(json.dumps(asdict(made)), "versions", f"{number:010d}")
    return made


def prune(spark: SparkSession, root: str, keep: int, admin: bool = False, current: str | None = None, between: Callable[[str], None] = lambda step: None) -> list[tuple[str, int, str]]:
    """Delete what no version but the newest `keep` needs: files first, then the versions' records, which are the way back if files could not
    be deleted. Gives (target, version, status) of each step.

    Refused without admin, if keep is below 1, or if the newest generation is not `current`, where that is given. Doing it twice changes nothing."""
    if not admin:
        raise PruneRefused("pruning needs the rights of an administrator")
    if keep < 1:
        raise PruneRefused("the current version is never pruned")
    known = versions(spark, root)
    if current is not None and (not known or known[-1].generation != current):
        raise PruneRefused(f"generation {current} is not the published one any more")
    folder, kept, gone = _Folder(spark, root), known[-keep:], known[:-keep]
    needed = {n for v in kept for n in v.buckets.values()}
    steps, failed = [], set()
    for name in folder.names("data"):
        number = int(name.removeprefix("v="))
        if number in needed or number > kept[-1].number:
            continue
        done = folder.delete("data", name)
        failed |= set() if done else {number}
        steps.append(("data", number, "completed" if done else "failed"))
        between(f"data {number}")
    for v in gone:
        blocked = failed & set(v.buckets.values())
        if not blocked:
            folder.delete("versions", f"{v.number:010d}")
        steps.append(("version", v.number, "skipped" if blocked else "completed"))
        between(f"version {v.number}")
    return steps
