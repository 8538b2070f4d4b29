"""Dumps of posts, videos and packages, and transcripts of sessions in three dialects: each file is a row (id, text), read where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import records as C


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _text(v: Column, path: str) -> Column:
    """A member that is a string, or null."""
    return F.when(_kind(_at(v, path)) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))


def _list(v: Column, path: str | None = None) -> Column:
    """array<variant> of a member that is an array, or null."""
    held = v if path is None else _at(v, path)
    return F.when(_kind(held).startswith("ARRAY"), F.try_variant_get(held, "$", "array<variant>"))


def _whole(v: Column, path: str) -> Column:
    return F.when(_kind(_at(v, path)) == "BIGINT", F.try_variant_get(v, f"$.{path}", "long"))


def _fits(v: Column, kinds: dict[str, str]) -> Column:
    """Whether v is an object whose members are missing, null or of these kinds (number takes whole and broken ones, count no negative one)."""
    out = F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))
    for name, kind in kinds.items():
        held = _kind(_at(v, name))
        right = held.rlike({"text": "^STRING$", "whole": "^BIGINT$", "count": "^BIGINT$", "number": "^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "flag": "^BOOLEAN$", "list": "^ARRAY"}[kind])
        if kind == "count":
            right &= F.coalesce(_whole(v, name) >= 0, F.lit(True))
        out &= F.coalesce(right | (held == "VOID"), F.lit(True)) if kind != "list" else F.coalesce(right, F.lit(True))
    return out


#: The members of a post and of its comments.
POST = {"title": "text", "selftext": "text", "permalink": "text", "author": "text", "score": "whole", "subreddit": "text", "domain": "text", "num_comments": "count", "upvote_ratio": "number", "is_video": "flag", "distinguished": "text", "gilded": "count", "link_flair_text": "text", "created_utc": "count", "comments": "list"}


def reddit_posts(dumps: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, at, url, title, author, subreddit, score, num_comments, created_utc, content, fault) of the posts of each dump, a JSON array.

    content is the title, the text and each comment with what it replies to. One malformed post or comment makes the dump one row with a fault.

    Dumps are dealt to all tasks, as few bytes of a table may hold much work, and judged once."""
    root = F.try_parse_json(F.col(text_col))
    dealt = dumps.select(id_col, text_col).repartition(int(dumps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posts = dealt.select(id_col, _list(root).alias("posts"))
    right_comment = lambda c: _fits(c, {"parent_text": "text"}) & _text(c, "body").isNotNull()
    right = lambda p: _fits(p, POST) & F.forall(F.coalesce(_list(p, "comments"), F.array().cast("array<variant>")), right_comment)
    judged = posts.withColumn("fault", F.when(F.col("posts").isNull() | ~F.forall("posts", right), "adapter.reddit.dump_invalid"))
    right_posts = F.when(F.col("fault").isNull(), F.col("posts"))
    each = judged.select(id_col, "fault", F.posexplode_outer(right_posts).alias("at", "p")).where("fault IS NOT NULL OR at IS NOT NULL")
    p = F.col("p")
    title = F.coalesce(_text(p, "title"), F.lit("Untitled"))
    said = F.when(F.coalesce(_text(p, "selftext"), F.lit("")) != "", F.concat(F.lit("\n\n"), _text(p, "selftext"))).otherwise("")

    def comment(c: Column) -> Column:
        parent = F.coalesce(_text(c, "parent_text"), F.lit(""))
        return F.concat(F.lit("\n\n---\nPost: "), title, F.lit("\n\n"), F.when(parent != "", F.concat(F.lit("Replying to: "), parent, F.lit("\n\n"))).otherwise(""), _text(c, "body"))

    comments = F.array_join(F.transform(F.coalesce(_list(p, "comments"), F.array().cast("array<variant>")), comment), "")
    author = F.coalesce(F.when(_text(p, "author") != "", _text(p, "author")), F.lit("[deleted]"))
    columns = ["url", "title", "author", "subreddit", "score", "num_comments", "created_utc", "content"]
    values = [F.concat(F.lit("https://www.reddit.com"), F.coalesce(_text(p, "permalink"), F.lit(""))), title, author, _text(p, "subreddit"), _whole(p, "score"), _whole(p, "num_comments"), _whole(p, "created_utc"), F.concat(F.lit("# "), title, said, comments)]
    return each.select(id_col, F.col("at").cast("long").alias("at"), *[F.when(F.col("fault").isNull(), v).alias(c) for v, c in zip(values, columns, strict=True)], "fault")


def youtube_videos(dumps: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, at, video_id, title, channel, upload_date, view_count, like_count, tags, transcript, fault) of the `videos` of each dump; members of another
    type count as missing. Without videos there are no rows; no JSON, and a video without an id, make the dump one row with a fault."""
    read = dumps.select(id_col, F.try_parse_json(F.col(text_col)).alias("root"))
    held = read.select(id_col, F.col("root").isNull().alias("broken"), F.coalesce(_list(F.col("root"), "videos"), F.array().cast("array<variant>")).alias("videos"))
    nameless = F.exists("videos", lambda v: C.trimmed(F.coalesce(_text(v, "video_id"), F.lit(""))) == "")
    judged = held.withColumn("fault", F.when(F.col("broken"), "adapter.youtube.dump.invalid").when(nameless, "adapter.youtube.dump.video_id.missing"))
    v = F.col("v")
    word = lambda name: F.coalesce(_text(v, name), F.lit("")).alias(name)
    count = lambda name: F.when(_whole(v, name) >= 0, _whole(v, name)).alias(name)
    tags = F.filter(F.transform(_list(v, "tags"), lambda t: F.when(_kind(t) == "STRING", F.try_variant_get(t, "$", "string"))), lambda t: t.isNotNull())
    good = judged.where("fault IS NULL").select(id_col, F.posexplode("videos").alias("at", "v"))
    found = good.select(id_col, F.col("at").cast("long").alias("at"), *[word(n) for n in ("video_id", "title", "channel", "upload_date")], count("view_count"), count("like_count"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), word("transcript"), F.lit(None).cast("string").alias("fault"))
    broken = judged.where("fault IS NOT NULL").select(id_col, *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in (id_col, "fault")], "fault")
    return found.unionByName(broken)


def registry_versions(dumps: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, registry, package, version, published_at, readme, latest, fault) of the versions of each package dump. The latest is the first that says
    so, else the last in the file. A dump without registry, package or a named version is one row with a fault."""
    read = dumps.select(id_col, F.try_parse_json(F.col(text_col)).alias("d"))
    d = F.col("d")
    optional = {n: "text" for n in ("description", "homepage", "license", "author")} | {"keywords": "list"}
    version_kinds = {n: "text" for n in ("readme", "description", "published_at")}
    words = F.forall(F.coalesce(_list(d, "keywords"), F.array().cast("array<variant>")), lambda k: _kind(k) == "STRING")
    right_version = lambda v: _fits(v, version_kinds) & _text(v, "version").isNotNull() & F.coalesce(_kind(_at(v, "is_latest")) == "BOOLEAN", F.lit(True))
    shaped = _fits(d, optional) & words & _text(d, "registry").isNotNull() & _text(d, "package").isNotNull() & F.coalesce(F.forall(_list(d, "versions"), right_version), F.lit(False))
    blank = lambda c: C.trimmed(c) == ""
    empty = blank(_text(d, "registry")) | blank(_text(d, "package")) | (F.size(_list(d, "versions")) == 0) | F.exists(_list(d, "versions"), lambda v: blank(_text(v, "version")))
    judged = read.withColumn("fault", F.when(~F.coalesce(shaped, F.lit(False)), "adapter.registry.dump_malformed").when(empty, "adapter.registry.dump_invalid"))
    says = lambda v: F.coalesce(F.try_variant_get(v, "$.is_latest", "boolean"), F.lit(False))
    first = F.array_position(F.transform(_list(d, "versions"), says), True)
    good = judged.where("fault IS NULL").select(id_col, _text(d, "registry").alias("registry"), _text(d, "package").alias("package"), F.when(first > 0, first - 1).otherwise(F.size(_list(d, "versions")) - 1).alias("l"), F.posexplode(_list(d, "versions")).alias("at", "v"))
    v = F.col("v")
    found = good.select(id_col, "registry", "package", *[_text(v, n).alias(n) for n in ("version", "published_at", "readme")], (F.col("at") == F.col("l")).alias("latest"), F.lit(None).cast("string").alias("fault"))
    broken = judged.where("fault IS NOT NULL").select(id_col, *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in (id_col, "fault")], "fault")
    return found.unionByName(broken)


def safe_turn(text: Column) -> Column:
    """The words of a turn, by single spaces; those that look like a secret are hidden, but for what surrounds them."""

    def hidden(token: Column) -> Column:
        bare = F.regexp_replace(token, r"^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+\z", "")
        low = F.lower(bare)
        named = low.rlike("^(?:sk-|ghp_|github_pat_|atk_)|api_key|apikey|access_token")
        mixed = (F.octet_length(bare) >= 24) & bare.rlike("[A-Za-z]") & bare.rlike("[0-9]")
        return F.when((bare != "") & (named | mixed), F.replace(token, bare, F.lit("[redacted-secret]"))).otherwise(token)

    return F.array_join(F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), hidden), " ")


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))


def _last(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


_NONE = "array<variant>"
SESSION = ["text", "turn_count", "model", "has_tool_use", "tools_used", "workspace_path", "git_branch", "last_message_at", "malformed_lines", "fault"]


def _session(id_col: str, rows: DataFrame, turns: Column, **said: Column) -> DataFrame:
    """turns: array<struct<role, text, calls, tools>>; a turn that says nothing is none."""
    each = rows.select(id_col, turns.alias("turns"), *[v.alias(k) for k, v in said.items()])
    spoken = F.filter("turns", lambda t: F.regexp_replace(t["text"], r"(?U)\s+", "") != "")
    text = F.array_join(F.transform(spoken, lambda t: F.concat(F.lit("\n\n### "), F.upper(t["role"]), F.lit(":\n"), safe_turn(t["text"]))), "")
    out = each.select("*", text.alias("text"), F.size(F.filter(spoken, lambda t: t["role"] == "user")).cast("long").alias("turn_count"), F.exists("turns", lambda t: t["calls"]).alias("has_tool_use"), F.array_sort(F.array_distinct(F.flatten(F.transform("turns", lambda t: t["tools"])))).alias("tools_used"))
    for name in SESSION:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0 if name == "malformed_lines" else None).cast("long" if name == "malformed_lines" else "string"))
    return out.select(id_col, *SESSION)


def _items_text(items: Column, *names: str) -> Column:
    """The texts of items, a line break after each; the first of the names that an item has counts."""
    each = F.transform(items, lambda i: F.concat(F.coalesce(*[_text(i, n) for n in names]), F.lit("\n")))
    return F.array_join(F.filter(each, lambda t: t.isNotNull()), "")


def _called(items: Column, kinds: list[str], *names: str) -> tuple[Column, Column]:
    calls = F.filter(items, lambda i: F.coalesce(_text(i, "type").isin(kinds), F.lit(False)))
    return F.size(calls) > 0, F.filter(F.transform(calls, lambda i: F.coalesce(*[_text(i, n) for n in names])), lambda t: t.isNotNull())


def session_turns(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """SESSION of transcripts with a JSON turn a line: `user` and `assistant` turns that are not meta; lines that are no JSON are counted."""
    lines = F.filter(F.split(text_col, "\n", -1), lambda x: C.trimmed(x) != "")
    read = files.select(id_col, F.transform(lines, F.try_parse_json).alias("all"))
    rows = read.select(id_col, F.size(F.filter("all", lambda v: v.isNull())).cast("long").alias("bad"), F.filter("all", lambda v: v.isNotNull()).alias("vals"))
    meta = lambda v: F.coalesce(F.when(_kind(_at(v, "isMeta")) == "BOOLEAN", F.try_variant_get(v, "$.isMeta", "boolean")), F.lit(False))
    kept = F.filter("vals", lambda v: ~meta(v) & F.coalesce(_text(v, "type").isin("user", "assistant"), F.lit(False)))

    def turn(v: Column) -> Column:
        items = F.coalesce(_list(v, "message.content"), F.array().cast(_NONE))
        calls, tools = _called(items, ["tool_use"], "name")
        return F.struct(_text(v, "type").alias("role"), F.coalesce(_text(v, "message.content"), _items_text(items, "text")).alias("text"), calls.alias("calls"), tools.alias("tools"))

    return _session(
        id_col,
        rows,
        F.transform(kept, turn),
        model=_first(F.transform(F.filter(kept, lambda v: _text(v, "type") == "assistant"), lambda v: _text(v, "message.model"))),
        workspace_path=_first(F.transform("vals", lambda v: _text(v, "cwd"))),
        git_branch=_first(F.transform("vals", lambda v: _text(v, "gitBranch"))),
        last_message_at=_last(F.transform(kept, lambda v: _text(v, "timestamp"))),
        malformed_lines=F.col("bad"),
    )


def session_items(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """SESSION of transcripts with a header line (session_meta) and items (response_item), each with a payload."""
    lines = F.filter(F.split(text_col, "\n", -1), lambda x: C.trimmed(x) != "")
    read = files.select(id_col, F.transform(lines, F.try_parse_json).alias("all"))
    rows = read.select(id_col, F.size(F.filter("all", lambda v: v.isNull())).cast("long").alias("bad"), F.filter("all", lambda v: v.isNotNull()).alias("vals"))
    heads = F.filter("vals", lambda v: F.coalesce(_text(v, "type") == "session_meta", F.lit(False)))
    kept = F.filter("vals", lambda v: F.coalesce((_text(v, "type") == "response_item") & _list(v, "payload.content").isNotNull(), F.lit(False)))

    def turn(v: Column) -> Column:
        items = _list(v, "payload.content")
        calls, tools = _called(items, ["function_call", "tool_call", "tool_use"], "name", "function.name")
        return F.struct(F.coalesce(_text(v, "payload.role"), F.lit("unknown")).alias("role"), _items_text(items, "text", "input_text").alias("text"), calls.alias("calls"), tools.alias("tools"))

    return _session(
        id_col,
        rows,
        F.transform(kept, turn),
        model=_first(F.transform(heads, lambda v: F.coalesce(_text(v, "payload.model"), _text(v, "payload.model_provider")))),
        workspace_path=_first(F.transform(heads, lambda v: _text(v, "payload.cwd"))),
        malformed_lines=F.col("bad"),
    )


def session_messages(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """SESSION of transcripts that are one JSON object with messages; a text that is no JSON has a fault."""
    rows = files.select(id_col, F.try_parse_json(F.col(text_col)).alias("v"))
    messages = F.coalesce(_list(F.col("v"), "messages"), F.array().cast(_NONE))
    kept = F.filter(messages, lambda m: _list(m, "content").isNotNull())
    none = F.array().cast("array<string>")
    turn = lambda m: F.struct(F.coalesce(_text(m, "type"), F.lit("unknown")).alias("role"), _items_text(_list(m, "content"), "text").alias("text"), F.lit(False).alias("calls"), none.alias("tools"))
    return _session(id_col, rows, F.transform(kept, turn), fault=F.when(F.col("v").isNull(), "no JSON"))
