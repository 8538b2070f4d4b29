"""Dumps and transcripts against values written by hand."""

import json

from pyspark.sql import functions as F

from millrace.sources import dumps as D


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_posts(spark):
    good = [{"title": "T", "permalink": "/r/1", "selftext": "s", "comments": [{"body": "b", "parent_text": "p"}, {"body": "c"}]}, {"author": "", "score": 3, "title": None}]
    got = D.reddit_posts(files(spark, json.dumps(good), "[]", "{}", "[1]", '[{"title":5}]', '[{"comments":[{"parent_text":"x"}]}]', "no", None), "id").orderBy("id", "at").collect()
    assert [(r["id"], r["at"], r["author"], r["url"], r["content"]) for r in got if not r["fault"]] == [
        (0, 0, "[deleted]", "https://www.reddit.com/r/1", "# T\n\ns\n\n---\nPost: T\n\nReplying to: p\n\nb\n\n---\nPost: T\n\nc"),
        (0, 1, "[deleted]", "https://www.reddit.com", "# Untitled"),
    ]
    assert [r["id"] for r in got if r["fault"]] == [2, 3, 4, 5, 6, 7]


def test_videos(spark):
    got = D.youtube_videos(files(spark, '{"videos":[{"video_id":"v","tags":["a",1],"view_count":-1,"title":3}]}', "{}", '{"videos":[{}]}', "[", '{"videos":[]}'), "id").orderBy("id").collect()
    assert [(r["id"], r["video_id"], r["title"], r["tags"], r["view_count"], r["fault"]) for r in got] == [(0, "v", "", ["a"], None, None), (2, None, None, None, None, "adapter.youtube.dump.video_id.missing"), (3, None, None, None, None, "adapter.youtube.dump.invalid")]


def test_packages(spark):
    base = {"registry": "npm", "package": "p"}
    texts = [json.dumps(base | {"versions": v}) for v in ([{"version": "1"}, {"version": "2", "is_latest": True}, {"version": "3", "is_latest": True}], [{"version": "1"}, {"version": "2"}], [], [{"version": " "}], [{}], [{"version": "1", "is_latest": 1}])]
    got = D.registry_versions(files(spark, *texts, json.dumps({"registry": "npm"})), "id").collect()
    assert {(r["id"], r["version"]) for r in got if r["latest"]} == {(0, "2"), (1, "2")} and len([r for r in got if not r["fault"]]) == 5
    assert {r["id"]: r["fault"].rsplit("_", 1)[1] for r in got if r["fault"]} == {2: "invalid", 3: "invalid", 4: "malformed", 5: "malformed", 6: "malformed"}


def test_safe_turns(spark):
    words = 'use "sk-abc", MY_API_KEY=1 aaaaaaaaaaaaaaaaaaaaaaaa1 (aaaaaaaaaaaaaaaaaaaaaaaaaa) ...\n x'
    assert files(spark, words).select(D.safe_turn(F.col("text")).alias("x")).first()["x"] == 'use "[redacted-secret]", [redacted-secret] [redacted-secret] (aaaaaaaaaaaaaaaaaaaaaaaaaa) ... x'


def test_sessions(spark):
    turn = lambda kind, content, **more: json.dumps({"type": kind, "message": {"content": content, "model": "m1"}} | more)
    text = "\n".join([turn("user", "hello  there", cwd="/w", timestamp="t1"), "{bad", turn("user", "meta", isMeta=True, gitBranch="b"), "", turn("assistant", [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "Read"}, {"text": "b"}], timestamp="t2"), turn("system", "no"), turn("user", " ")])
    (got,) = D.session_turns(files(spark, text), "id").collect()
    assert tuple(got)[1:] == ("\n\n### USER:\nhello there\n\n### ASSISTANT:\na b", 1, "m1", True, ["Read"], "/w", "b", "t2", 1, None)
    items = [{"type": "session_meta", "payload": {"cwd": "/c", "model_provider": "mp"}}, {"type": "response_item", "payload": {"role": "user", "content": [{"input_text": "x"}, {"type": "function_call", "function": {"name": "f"}}]}}, {"type": "response_item", "payload": {"content": [{"text": "y", "input_text": "z"}]}}, {"type": "other"}]
    (got,) = D.session_items(files(spark, "\n".join(map(json.dumps, items))), "id").collect()
    assert tuple(got)[1:] == ("\n\n### USER:\nx\n\n### UNKNOWN:\ny", 1, "mp", True, ["f"], "/c", None, None, 0, None)
    messages = {"messages": [{"type": "user", "content": [{"text": "q"}]}, {"content": "skipped"}, {"type": "gemini", "content": [{"text": "r"}, {}]}]}
    one, bad = D.session_messages(files(spark, json.dumps(messages), "no"), "id").orderBy("id").collect()
    assert (one["text"], one["turn_count"], one["fault"], bad["fault"], bad["text"]) == ("\n\n### USER:\nq\n\n### GEMINI:\nr", 1, None, "no JSON", "")
