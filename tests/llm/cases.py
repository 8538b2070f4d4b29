"""Rows that every operator on documents must take: nulls, empty and long texts, ties, repeats, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard int, rank int"


def rows(extra=()):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = prose(70)
    texts = [None, "", " ", "\n", "a", "x\n\ny\n", "  Two  spaces \t tab nbsp\r\n end  ", "don't we'll 12 345 ÀÉ 你好 🙂🙂", "a" * 9000, prose(4000)]
    texts += [prose(rng.randint(1, 120)) + "\nLicensed LINE \n" + prose(5) for _ in range(25)]
    texts += [prose(30) + " " + shared + " " + prose(20) for _ in range(4)]
    texts += [texts[20], texts[20], shared, "<|endoftext|> is text", "\x1c\x1dodd\x85white space  x   y"]
    base = prose(200).split()
    texts += [" ".join(base), " ".join(base[:100] + ["changed"] + base[101:]), " ".join(base).upper()]
    out = [(i, t, "en", "s", 0, "k", 1, 2) for i, t in enumerate([*texts, *extra])]
    out += [out[12], out[12], (None, "no id here", None, None, None, None, None, None)]
    return out


def frame(spark, extra=()):
    return spark.createDataFrame(rows(extra), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
