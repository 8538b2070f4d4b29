"""Secrets in nested payloads: a walk over VARIANT values level by level, what a pass drops or hides, and what forbids a write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.tables import written

HIDDEN = "[REDACTED]"
#: Parts of field names that forbid a write, that let a field be dropped, and that make an opaque value a token.
FORBIDDEN_NAMES = ["raw_auth", "auth_header", "authorization", "cookie", "api_key", "apikey", "secret", "raw_env", "env_value", "absolute_home", "home_path", "raw_html", "html_blob", "adapter_response", "response_blob"]
SECRET_NAMES = ["secret", "credential", "password", "api_key", "apikey", "access_token", "refresh_token", "id_token", "private_key", "client_secret"]
TOKEN_NAMES = ["token", "secret", "gitlab", "gitea", "oauth", "deploy_token"]
#: Fields that carry identity and are never touched, and folders that mark a path of this machine.
STRUCTURAL = ["redaction_status", "redaction_version", "visibility", "chunk_text", "chunk_key", "chunk_id", "chunk_hash", "content_hash"]
LOCAL_FOLDERS = ["/home/", "/users/", "/tmp/", "/mnt/", "/var/", "/etc/", "/root/"]
LEAST_TOKEN = 20


def _has(name: Column, parts: list[str]) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in parts])


def forbidden_name(name: Column) -> Column:
    return _has(name, FORBIDDEN_NAMES)


def secret_name(name: Column) -> Column:
    return _has(name, SECRET_NAMES) | F.lower(name).endswith("_token") | F.lower(name).isin("authorization", "proxy-authorization")


def local_path(value: Column) -> Column:
    """Whether a text is or holds an absolute path of this machine; addresses with a scheme of the net do not."""
    low, bare = F.lower(value), F.regexp_replace(value, r"(?U)^\s+", "")
    held = reduce(lambda a, b: a | b, [low.contains(p) for p in LOCAL_FOLDERS])
    return ~low.rlike("^(?:https?|local-code)://") & (held | bare.rlike(r"^(?:~|\\\\|[A-Za-z]:[\\/])"))


def opaque_token(value: Column) -> Column:
    """Whether a text is one run of 20 or more token characters with as many bits of entropy as a random one."""
    bare = F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")
    return bare.rlike(rf"^[A-Za-z0-9_.-]{{{LEAST_TOKEN},}}\z") & (T.entropy(bare) >= T.LEAST_ENTROPY)


def html_blob(value: Column) -> Column:
    low = F.lower(value)
    return low.rlike(r"(?U)^\s*(?:<!doctype html|<html)") | (low.contains("<html") & low.contains("</html>")) | (low.contains("<body") & low.contains("</body>"))


def response_blob(value: Column) -> Column:
    """Whether an object is an adapter's raw response: a status, headers and a body. Null of other values."""
    has = lambda *names: reduce(lambda a, b: a | b, [F.try_variant_get(value, f"$.{n}", "variant").isNotNull() for n in names])
    return has("status", "status_code") & has("headers") & has("body", "raw_body", "response_body")


_NODE = ["path", "parent", "name", "pos", "field", "kind", "text", "v"]


def walk(rows: DataFrame, id_col: str, payload: str, stop: Column | None = None, **judge: Column) -> list[DataFrame]:
    """The nodes of each row's VARIANT payload by depth: (id, path, parent, name, pos, field, kind, text, v), kind of object, array or leaf, text of a string. Items of arrays have
    the name of their field and a place in the path (`a.b[0]`). What lies below a node for which stop holds is not visited.
    judge: further columns of a node, of which stop may be made.

    Rows are dealt to all tasks first, as few bytes of a table may hold much work. Each level is written, with what is asked of a node
    more than once, before the next is read from it; there are as many as the deepest payload has."""
    spark = rows.sparkSession

    def judged(nodes: DataFrame) -> DataFrame:
        kind = F.when(F.col("shape").startswith("OBJECT"), "object").when(F.col("shape").startswith("ARRAY"), "array").otherwise("leaf")
        text = F.when(F.col("shape") == "STRING", F.try_variant_get("v", "$", "string"))
        out = nodes.withColumn("shape", F.schema_of_variant("v")).withColumn("kind", kind).withColumn("text", text)
        return written(out.select(id_col, *_NODE, *[c.alias(n) for n, c in judge.items()]))

    rows = rows.select(id_col, payload).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), id_col)
    top = rows.select(id_col, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"), F.lit(0).alias("pos"), F.lit(False).alias("field"), F.col(payload).alias("v")).where("v IS NOT NULL")
    levels = [judged(top)]
    while True:
        inner = levels[-1].where("kind <> 'leaf'")
        if stop is not None:
            inner = inner.where(~F.coalesce(stop, F.lit(False)))
        if not inner.limit(1).count():
            return levels
        held = inner.select(id_col, F.col("path").alias("parent"), F.col("name").alias("above"), F.col("v").alias("held"))
        found = held.lateralJoin(spark.tvf.variant_explode(F.col("held").outer())).withColumnRenamed("value", "v")
        item = F.concat("parent", F.lit("["), "pos", F.lit("]"))
        field = F.when(F.col("parent") == "", F.col("key")).otherwise(F.concat("parent", F.lit("."), "key"))
        name = F.coalesce("key", F.concat("above", F.lit("["), "pos", F.lit("]")))
        levels.append(judged(found.select(id_col, F.when(F.col("key").isNull(), item).otherwise(field).alias("path"), "parent", name.alias("name"), "pos", F.col("key").isNotNull().alias("field"), "v")))


def _text() -> Column:
    return F.col("text")


def _dropped() -> Column:
    """A field goes with all below it; one whose name forbids the write stays, for the write to fail."""
    return F.col("field") & ~F.col("name").isin(STRUCTURAL) & ~forbidden_name(F.col("name")) & secret_name(F.col("name"))


def _detector(allow_paths: bool) -> Column:
    paths = F.lit(False) if allow_paths else local_path(_text())
    found = F.when(T.contains_secret(_text()), "secret_value").when(paths, "local_path").when(_has(F.col("name"), TOKEN_NAMES) & opaque_token(_text()), "opaque_token_entropy")
    return F.when(_dropped(), "secret_field_name").when(_text().isNotNull() & ~F.col("path").isin(STRUCTURAL), found)


def _gone() -> Column:
    """Whether a node is dropped, by its detector."""
    return F.coalesce(F.col("detector") == "secret_field_name", F.lit(False))


def redaction_report(rows: DataFrame, id_col: str, payload: str, allow_paths: bool = False) -> DataFrame:
    """(id, path, action, detector) of each field of the payloads that redaction drops or hides."""
    action = F.when(_gone(), "dropped").otherwise("redacted").alias("action")
    found = [level.where("path <> ''").select(id_col, "path", action, "detector") for level in walk(rows, id_col, payload, _gone(), detector=_detector(allow_paths))]
    return reduce(DataFrame.unionByName, found).where("detector IS NOT NULL")


def redacted(rows: DataFrame, id_col: str, payload: str, allow_paths: bool = False) -> DataFrame:
    """(id, payload, status) with the payload as VARIANT without its dropped fields and with HIDDEN for its secrets; status clean or redacted.

    Values are put together from the deepest level up: each is summed up with its siblings under their parent."""
    levels, below = walk(rows, id_col, payload, _gone(), detector=_detector(allow_paths)), None
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", "")
    for level in reversed(levels):
        seen = level.where(~_gone() | (F.col("path") == ""))
        hid = F.col("detector").isNotNull()
        leaf = F.when(hid, quoted(F.lit(HIDDEN))).otherwise(F.to_json("v"))
        gone = level.where(_gone()).groupBy(id_col, "parent").agg(F.count("*").alias("dropped"))
        if below is not None:
            seen = seen.join(below, [id_col, "path"], "left")
            body = F.coalesce("body", F.lit(""))
            text = F.when(F.col("kind") == "object", F.concat(F.lit("{"), body, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), body, F.lit("]"))).otherwise(leaf)
            hid = hid | F.coalesce("touched", F.lit(False))
        else:
            text = leaf
        one = seen.select(id_col, "path", "parent", "pos", F.when(F.col("field"), F.concat(quoted(F.col("name")), F.lit(":"), text)).otherwise(text).alias("text"), hid.alias("hid"))
        if level is levels[0]:
            return one.select(id_col, F.parse_json("text").alias("payload"), F.when(F.col("hid"), "redacted").otherwise("clean").alias("status"))
        items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
        below = one.groupBy(id_col, "parent").agg(F.array_join(items, ",").alias("body"), F.bool_or("hid").alias("touched")).join(gone, [id_col, "parent"], "full")
        below = below.select(id_col, F.col("parent").alias("path"), "body", (F.coalesce("touched", F.lit(False)) | F.col("dropped").isNotNull()).alias("touched"))
    raise AssertionError("the first level returns")


def payload_faults(rows: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, path, fault) of what forbids writing a payload: `field` names that are forbidden, raw `response` objects, and `value` texts with
    marks of secrets, paths of this machine or raw HTML. The field chunk_text may hold paths and HTML. Nothing below a fault is looked at."""
    named = F.col("field") & forbidden_name(F.col("name"))
    blob = F.when(F.col("kind") == "object", response_blob(F.col("v")))
    marked = T.marked_secret(_text())
    value = F.when(F.col("path") == "chunk_text", marked).otherwise(marked | local_path(_text()) | html_blob(_text()))
    fault = F.when(named, "field").when(blob, "response").when(_text().isNotNull() & value, "value")
    found = [level.select(id_col, "path", "fault") for level in walk(rows, id_col, payload, F.col("fault").isin("field", "response"), fault=fault)]
    return reduce(DataFrame.unionByName, found).where("fault IS NOT NULL")
