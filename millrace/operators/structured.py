"""Records of CSV, XML and tool output, and the one chunk that is left of a text that cannot be read as what it should be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import records as C
from millrace.operators.documents import numbered

_MARK = "\x1e"


def csv_fields(line: Column) -> Column:
    """The fields of one line of CSV. Commas and quotes count by the running parity of quotes: what stands between an odd and an even one
    is quoted; two quotes side by side within are one."""
    parts = F.split(line, '"', -1)
    cut = F.split(F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(_MARK))).otherwise(p)), '"'), _MARK, -1)

    def bare(field: Column) -> Column:
        inner = F.split(field, '"', -1)
        return F.array_join(F.transform(inner, lambda p, i: F.when((i % 2 == 0) & (i >= 2) & (i < F.size(inner) - 1) & (p == ""), '"').otherwise(p)), "")

    return F.transform(cut, bare)


def csv_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, csv_row, content, byte_start, byte_end) of each line after the first that is not blank: `header: value` lines, as far as both go.

    A line is a record, even within quotes; rows count from 0, blank ones too. Texts are dealt by id to place their lines."""
    each, _ = numbered(docs, id_col, text_col)
    whole = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bare = F.regexp_replace("line", r"\r+\z", "")
    rows = each.select("*", bare.alias("bare"), F.first("line").over(whole).alias("head")).where((F.col("at") > 0) & (C.trimmed(F.col("bare")) != ""))
    headers, fields = csv_fields(F.regexp_replace("head", r"\r+\z", "")), csv_fields(F.col("bare"))
    pairs = F.slice(F.zip_with(headers, fields, lambda h, v: F.concat(C.trimmed(h), F.lit(": "), C.trimmed(v))), F.lit(1), F.least(F.size(headers), F.size(fields)))
    end = F.least(F.col("byte") + F.octet_length("line") + 1, F.col("total"))
    return rows.select(id_col, (F.col("at") - 1).cast("long").alias("csv_row"), F.array_join(pairs, "\n").alias("content"), F.col("byte").alias("byte_start"), end.cast("long").alias("byte_end"))


def element_name(tag: Column) -> Column:
    return F.regexp_extract(tag, r"^<*/*([^\s>/]*)", 1)


def xml_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, record, xpath, content, byte_start, byte_end) of each child of a text's root element, comments among them.

    A tag goes from `<` to the next `>`; a running depth over the tags of a text tells where its records begin and end. What follows the tag
    that closes the root is not read, a record that is not closed is none. Texts are dealt by id."""
    head = F.regexp_extract(text_col, r"^(?:<\?xml[^>]*>[^>]*>|[^>]*>)", 0)
    opened = docs.select(id_col, F.octet_length(head).alias("from"), F.col(text_col).substr(F.length(head) + 1, F.length(text_col)).alias("rest")).where(F.col("from") > 0)
    each = opened.select(id_col, "from", F.posexplode(F.regexp_extract_all("rest", F.lit(r"[^<]*<[^>]*>"), 0)).alias("at", "piece"))
    each = each.select("*", F.regexp_replace("piece", "^[^<]*", "").alias("tag"))
    closing, alone = F.col("tag").startswith("</"), F.col("tag").rlike(r"/>\z|^<[!?]")
    by = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("*", closing.alias("closing"), alone.alias("alone"), F.when(closing, -1).when(alone, 0).otherwise(1).alias("step"))
    each = each.select("*", F.sum("step").over(by).alias("depth"), (F.col("from") + F.sum(F.octet_length("piece")).over(by)).alias("end"))
    each = each.withColumn("least", F.min("depth").over(by)).where("least >= 0")
    starts = ((F.col("depth") == 1) & (F.col("step") == 1)) | ((F.col("depth") == 0) & F.col("alone") & ~F.col("closing"))
    placed = each.select("*", starts.alias("starts"), F.sum(starts.cast("int")).over(by).alias("record")).where("record > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("starts"), F.col("tag")).otherwise(F.col("piece")).alias("t")))), lambda x: x["t"]), "")
    found = placed.groupBy(id_col, "record").agg(
        F.concat(F.lit("/*/"), element_name(F.max(F.when(F.col("starts"), F.col("tag"))))).alias("xpath"),
        text.alias("content"),
        F.max(F.when(F.col("starts"), F.col("end") - F.octet_length("tag"))).cast("long").alias("byte_start"),
        F.max("end").cast("long").alias("byte_end"),
        F.min("depth").alias("least"),
    )
    return found.where("least = 0").select(id_col, (F.col("record") - 1).cast("long").alias("record"), "xpath", "content", "byte_start", "byte_end")


def with_fallback(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(id, record, locator, content, warning): the records (id, record, locator, content), and for each text that has none but is not blank the
    whole of it as one chunk, trimmed, with a warning."""
    rows = found.select(id_col, F.col("record").cast("long").alias("record"), "locator", "content", F.lit(None).cast("string").alias("warning"))
    left = docs.select(id_col, C.trimmed(F.col(text_col)).alias("content")).where("content <> ''").join(found.select(id_col).distinct(), id_col, "left_anti")
    return rows.unionByName(left.select(id_col, F.lit(0).cast("long").alias("record"), F.lit(None).cast("string").alias("locator"), "content", F.lit(f"chunk.structured_parse_failed: {kind}").alias("warning")))


def structured_records(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, record, locator, content, warning) of csv, xml, yaml, toml or json texts; see with_fallback for texts that hold no records."""
    if kind == "csv":
        found = csv_records(docs, id_col, text_col).select(id_col, F.col("csv_row").alias("record"), F.concat(F.lit("row "), "csv_row").alias("locator"), "content")
    elif kind == "xml":
        found = xml_records(docs, id_col, text_col).select(id_col, "record", F.col("xpath").alias("locator"), "content")
    elif kind in ("yaml", "toml"):
        read = C.yaml_records if kind == "yaml" else C.toml_records
        each = docs.select(id_col, F.posexplode(read(F.col(text_col))).alias("record", "r"))
        found = each.select(id_col, "record", F.col("r.path").alias("locator"), F.col("r.content").alias("content"))
    elif kind == "json":
        found = json_records(docs, id_col, text_col)
        docs = docs.where(F.try_parse_json(F.col(text_col)).isNull())  # an empty container can be read, and holds none
    else:
        raise ValueError(f"unknown kind of records: {kind}")
    return with_fallback(docs, found, id_col, text_col, kind)


def json_records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, record, locator, content) of each item of a JSON array or member of an object, its JSON pointer as locator; a text that is no JSON
    and an empty container have none, another value is one record at the root."""
    read = docs.select(id_col, F.try_parse_json(F.col(text_col)).alias("v")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    inner = read.where(kind.rlike("^(?:ARRAY|OBJECT)")).lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))
    key = F.replace(F.replace(F.coalesce("key", F.col("pos").cast("string")), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    members = inner.select(id_col, F.col("pos").alias("record"), F.concat(F.lit("/"), key).alias("locator"), F.to_json("value").alias("content"))
    alone = read.where(~kind.rlike("^(?:ARRAY|OBJECT)")).select(id_col, F.lit(0).alias("record"), F.lit("").alias("locator"), F.to_json("v").alias("content"))
    return members.unionByName(alone)


def _string(value: Column, *names: str) -> Column:
    """The first of the fields that is a string, if it is not blank."""
    texts = [F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant")) == "STRING", F.try_variant_get(value, f"$.{n}", "string")) for n in names]
    found = F.coalesce(*texts)
    return F.when(C.trimmed(found) != "", found)


def tool_output(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, content, tool_name, tool_action, side_effect_class, artifact_id) of each line that is not blank; of a line that is a JSON
    object the fields that name its tool, action, side effect and artifact. Nothing is shuffled."""
    each = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("at", "line")).withColumn("content", C.trimmed(F.col("line"))).where("content <> ''")
    v = F.when(F.col("content").startswith("{"), F.try_parse_json("content"))
    each = each.withColumn("v", v)
    direct = _string(F.col("v"), "tool_output_artifact_id", "output_artifact_id", "artifact_id")
    held = _string(F.try_variant_get("v", "$.output", "variant"), "artifact_id", "output_artifact_id")
    return each.select(
        id_col,
        (F.col("at") + 1).cast("long").alias("line"),
        "content",
        _string(F.col("v"), "tool", "tool_name").alias("tool_name"),
        _string(F.col("v"), "action", "name").alias("tool_action"),
        _string(F.col("v"), "side_effect_class").alias("side_effect_class"),
        F.coalesce(direct, held).alias("artifact_id"),
    )


#: The anchors of a source range, numbers and texts.
NUMBER_ANCHORS = ["line_start", "line_end", "byte_start", "byte_end", "char_start", "char_end", "time_start_ms", "time_end_ms", "csv_row"]
TEXT_ANCHORS = ["dom_selector", "json_pointer", "yaml_path", "xml_xpath", "session_turn_id", "turn_start", "turn_end"]
#: States of redaction and of visibility that a citation may carry.
REDACTIONS = ["clean", "redacted", "failed"]
VISIBILITIES = ["public", "internal", "sensitive", "redacted", "derived"]


def _typed(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _anchor(held: Column, name: str) -> Column:
    return F.try_variant_get(held, f"$.{name}", "long" if name in NUMBER_ANCHORS else "string")


def malformed_range(held: Column) -> Column:
    """Whether a range is there but no object, or holds an anchor of another type: whole numbers from 0, texts; null is none."""
    bad = ~_typed(held, "OBJECT")
    for name in NUMBER_ANCHORS + TEXT_ANCHORS:
        value = F.try_variant_get(held, f"$.{name}", "variant")
        known = _typed(value, "BIGINT") & (_anchor(held, name) >= 0) if name in NUMBER_ANCHORS else _typed(value, "STRING")
        bad |= value.isNotNull() & ~F.coalesce(known | _typed(value, "VOID"), F.lit(False))
    return F.coalesce(held.isNotNull() & bad, F.lit(False))


def citations(matches: DataFrame) -> DataFrame:
    """(point_id, fault, canonical_uri, source_generation, anchors) of matches (point_id, chunk_id, document_id, source_id, source_item_key, payload).

    fault names the first thing that a citation needs and the match lacks, and is null for a whole one; the other columns are null beside
    a fault. anchors holds for each of the 16 the source range's value, else that of the chunk's locator; blank texts are none."""
    p = F.col("payload")
    get = lambda path, kind: F.try_variant_get(p, f"$.{path}", kind)
    number = lambda n: F.coalesce(_typed(get(n, "variant"), "BIGINT") & get(n, "long").between(0, 2**32 - 1), F.lit(False))
    text = lambda n: F.when(_typed(get(n, "variant"), "STRING"), get(n, "string"))
    uuid = F.coalesce(text("job_id").rlike(r"^(?i:[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})\z"), F.lit(False))
    names = get("detector_names", "variant")
    source, locator = get("source_range", "variant"), get("chunk_locator.range", "variant")
    merged = [F.coalesce(_anchor(source, n), _anchor(locator, n)).alias(n) for n in NUMBER_ANCHORS]
    full = lambda c: F.when(F.trim(c) != "", c)
    merged += [F.coalesce(full(_anchor(source, n)), full(_anchor(locator, n))).alias(n) for n in TEXT_ANCHORS]
    nowhere = reduce(lambda a, b: a & b, [c.isNull() for c in merged])
    faults = [
        (F.col("chunk_id").isNull(), "missing_chunk_id"),
        (F.col("document_id").isNull(), "missing_document_id"),
        (F.col("source_id").isNull(), "missing_source_id"),
        (F.col("source_item_key").isNull(), "missing_source_item_key"),
        (~F.coalesce(_typed(get("source_generation", "variant"), "BIGINT") & (get("source_generation", "long") >= 0), F.lit(False)), "missing_source_generation"),
        (~uuid, "missing_job_id"),
        (~F.coalesce(text("redaction_status").isin(REDACTIONS), F.lit(False)), "missing_redaction_status"),
        (~F.coalesce(text("visibility").isin(VISIBILITIES), F.lit(False)), "missing_visibility"),
        (F.coalesce(F.trim(text("redaction_version")), F.lit("")) == "", "missing_redaction_version"),
        *[(~number(n), f"missing_{n}") for n in ("redacted_field_count", "dropped_field_count", "detector_count")],
        (~F.coalesce(F.schema_of_variant(names).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)), "missing_detector_names"),
        (text("chunk_locator.canonical_uri").isNull(), "missing_canonical_uri"),
        (malformed_range(source), "invalid_source_range"),
        (malformed_range(locator), "invalid_chunk_locator_range"),
        (nowhere, "missing_source_range"),
    ]
    fault = F.lit(None).cast("string")
    for wrong, name in reversed(faults):
        fault = F.when(wrong, name).otherwise(fault)
    found = matches.select("point_id", fault.alias("fault"), text("chunk_locator.canonical_uri").alias("canonical_uri"), get("source_generation", "long").alias("source_generation"), F.struct(*merged).alias("anchors"))
    whole = F.col("fault").isNull()
    return found.select("point_id", "fault", *[F.when(whole, F.col(c)).alias(c) for c in ("canonical_uri", "source_generation", "anchors")])
