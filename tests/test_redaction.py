"""Redaction of whole documents against a plain reading of its two passes."""

import hashlib
import math
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans import registry

DATA = "/root/testdata/sf0.01"
SHAPES = regex.compile(
    r"AIza[0-9A-Za-z_\-]{35}|ya29\.[\w\-]+|\bsk-[A-Za-z0-9][A-Za-z0-9_\-]*|\bgh[pousr]_[A-Za-z0-9]+|\batk_[A-Za-z0-9_\-]+"
    r"|(?i:authorization)[:=][\ \t]*(?:(?i:bearer|basic|token)[\ \t]+)?\S*|\S*(?i:API_KEY|TOKEN|SECRET)[:=]\S*"
)


def bits(run):
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def plain(text):
    once = SHAPES.sub("[REDACTED]", text)
    return regex.sub(r"[A-Za-z0-9_\-]{32,}", lambda m: "[REDACTED]" if bits(m[0]) >= 3 else m[0], once)


def test_every_document(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["redacted"], r["changed"]) for r in registry.queries()["secret_redaction"](spark, DATA).collect()}
    want = {i: (None, None) if t is None else (hashlib.md5(plain(t).encode()).hexdigest(), plain(t) != t) for i, t in texts.items()}
    assert got == want and any(changed for _, changed in want.values())


@pytest.mark.parametrize(
    "text",
    ["x=sk-a ghp_1 atk_- k", "Authorization:  Bearer abc.def\nnext", "MY_TOKEN=a,b c", "a" * 40 + " " + "aB3-" * 10, "0123456789abcdefghijklmnopqrstuv_x", "authorization: ", "e" * 31 + "é" + "q9" * 20, "TOKEN:x SECRET=y api_key:", ""],
)
def test_shapes(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(T.redact(F.col("t")).alias("x")).first()["x"] == plain(text)


def test_services_behind_a_switch(spark):
    text = "npm_abcdefghijklmnopqrst https://u:pw@h/x"
    one = spark.createDataFrame([(text,)], "t string").select(T.redact(F.col("t")).alias("a"), T.redact(F.col("t"), services=True).alias("b")).first()
    assert one["a"] == text and one["b"] == "[REDACTED] https://[REDACTED]@h/x"
