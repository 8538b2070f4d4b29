"""Pieces, ranked search and spelling variants against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import lexical, piece_bpe, spelling

from . import cases

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.path(piece_bpe.PIECES))
CODER = piece_bpe.piece_encoder(P.path(piece_bpe.PIECES))
odd = st.text(st.sampled_from("ab é\n\t ▁'\x1c\x00.1st你🙂�"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(odd)
def test_pieces_are_the_librarys(text):
    ids = np.frombuffer(CODER.encode([text])[0], "<u4").tolist()
    assert ids == LIBRARY.encode(text)
    assert CODER.bpe.decode([1, *ids, 2]) == LIBRARY.decode([1, *ids, 2])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 10, 35, 130, 195, 200, 227, 229, 136, 170, 250, 259, 260, 28705, 264, 287, 31999]), max_size=9))
def test_any_ids_decode_as_the_library_does(ids):
    assert CODER.bpe.decode(ids) == LIBRARY.decode(ids)


def test_agenda_is_the_plain_definition():
    pieces = {c: (i, -float(i)) for i, c in enumerate(["a", "b", "ab", "ba", "aba", "bb", "abab", "bab"])}
    bpe = piece_bpe.PieceBPE(pieces, {}, 99, 100, 101, {100, 101})
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choices("abc", k=rng.randint(0, 14)))
        parts = list(text)
        while joined := [(-pieces[x + y][1], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in pieces]:
            i = min(joined)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge(text) == parts
        many = bpe.many([text, "abab"]) if text else [b""]
        assert many[0] is None if "c" in text else np.frombuffer(many[0], "<u4").tolist() == bpe.symbols(text)
        assert bpe._by_heap([~ord(c) if c == "c" else pieces[c][0] for c in text]) == bpe.symbols(text)
    assert bpe.ids("cab") == [99, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(odd, max_size=5))
def test_units_learned_at_once_are_the_librarys(texts):
    coder = piece_bpe.PieceEncoder(CODER.bpe)
    for _ in range(2):  # unknown at first, then from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == LIBRARY.encode(texts)


def test_units_are_checked_by_the_library(monkeypatch):
    pair = piece_bpe.Checked(P.path(piece_bpe.PIECES))
    texts = ["plain words, plain", " two  spaces \n\nline\n  indent ▁ x", "", "\nfirst", "é\x00\t你🙂", "a" * 300 + "\n" + "b" * 99]
    both = lambda: [[1, *np.frombuffer(x, "<u4").tolist(), 2] for x in pair.coder.encode(texts)]
    ids = both()
    assert pair.agree(texts, ids, [LIBRARY.decode(i) for i in ids]) == [True] * 6 and not pair.differs
    pair.coder.units.clear()
    monkeypatch.setattr(pair.coder.bpe, "many", lambda texts: [b"\x0d\0\0\0"] * len(texts))
    ids = both()
    assert pair.agree(texts, ids, [LIBRARY.decode(i) for i in ids])[0] is False and pair.differs


def test_piece_query(spark):
    out = piece_bpe.encode_pieces(cases.frame(spark), digests=True).collect()
    assert all(r["agrees"] for r in out)
    want = []
    for i, t, *_ in cases.rows():
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([tuple(r)[:4] for r in out], key=key) == sorted(want, key=key)
    assert piece_bpe.encode_pieces(cases.empty(spark)).count() == 0
    broken = spark.range(1).selectExpr("id AS doc_id", "cast(X'61FF62' AS string) AS text")
    (row,) = piece_bpe.encode_pieces(broken, check=False).collect()
    assert row["decoded"] == "a�b" and row["agrees"] is None


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    own = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t is not None]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if score > 0:
                scored.append((-score, -math.inf if i is None else i))
        out += [(item, rank + 1, None if i == -math.inf else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    data = cases.rows(["tie one", "tie one", "ONE tie!", "\x7fone_two-three ªé É"])
    items = [(1, "tie ONE"), (2, None), (3, ""), (4, "licensed line"), (4, "é ªé one"), (5, " ".join(t for _, t, *_ in data[10:14])), (6, "nowhere-to-be-found")]
    asked = spark.createDataFrame([(i, t, 7, "x") for i, t in items], "item_id long, text string, rank int, doc_id string")
    want = ranked([(i, t) for i, t, *_ in data], items, 10)
    plain = lambda df: sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)
    assert plain(lexical.search(cases.frame(spark, [t for _, t, *_ in data[-7:-3]]), asked)) != []
    assert plain(lexical.search(spark.createDataFrame(data, cases.SCHEMA).repartition(3), asked)) == want
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    monkeypatch.setattr(lexical, "MOST_IMPACTS", 3)
    assert plain(lexical.search(spark.createDataFrame(data, cases.SCHEMA).repartition(3), asked)) == want
    assert lexical.search(cases.empty(spark), asked).count() == 0
    assert lexical.search(cases.frame(spark), asked.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2**20), st.integers(0, 2**40)), max_size=60))
def test_sums_by_packed_keys(rows):
    want = Counter()
    for i, d, x in rows:
        want[i, d] += x
    columns = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
    got = list(zip(*(c.tolist() for c in lexical.summed(*columns)), strict=True))
    assert got == [(i, d, s) for (i, d), s in sorted(want.items())] if rows else got == []


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return (out | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}) - {word}


def grouped(words):
    letters = set("".join(words))
    near = {w: [x for x in edits(w, letters) if x in words] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 2 * words[w] else None for w, b in best.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = {}
    for _ in range(700):
        words["".join(rng.choices("abé", k=rng.randint(0, 9)))] = rng.choice([1, 1, 2, 3, 5, 8, 40, 100])
    want = grouped(words)
    rows = [(w, n, "x") for w, n in words.items()]
    given_ = spark.createDataFrame([(w, n - 1, x) for w, n, x in rows] + [(w, 1, "y") for w, _, _ in rows] + [(None, 4, "z")], "word string, n long, form string")
    assert plain(spelling.variants(given_)) == want
    monkeypatch.setattr(spelling, "MOST_WORDS", 4)  # blocks are subdivided to the last place
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    assert plain(spelling.variants(given_)) == want
    assert spelling.variants(given_.limit(0)).count() == 0


def test_each_pair_comes_from_one_block(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_WORDS", 3)
    words = {"a" * k: 5 * 3**k for k in range(1, 8)} | {"aabaa": 3, "aaba": 3, "abaa": 9}
    assert plain(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == grouped(words)


def test_dictionary_counts_and_deletes(spark):
    letters = re.compile("[A-Za-zÀ-ÿ]+")
    data = cases.rows(["Hello HELLO hello wörld"] * 400)
    total = Counter()
    for i, t, *_ in data:
        for run in letters.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    want = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    assert {r["word"]: r["n"] for r in spelling.dictionary(spark.createDataFrame(data, cases.SCHEMA).repartition(3)).collect()} == want
    assert {"hello", "wörld"} < set(want) and len(want) > 4
    assert spelling.dictionary(cases.empty(spark)).count() == 0
