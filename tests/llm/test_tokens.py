import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, packing, token_files, tokens

from . import cases


def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


odd = st.text(st.sampled_from("ab é\n\t ' \x1c.1st你🙂"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(odd)
def test_units_encode_as_the_library_does(text):
    assert tokens.encoder(tokens.default_path()).encode([text])[0].tolist() == library_ids(text)
    assert np.frombuffer(bpe.text_encoder(P.path("byte_bpe_50k.tiktoken")).encode(text), "<u4").tolist() == library_ids(text)


_lib = library()


def library_ids(text):
    return _lib(text)


@settings(max_examples=150, deadline=None)
@given(odd, odd, st.integers(0, 40), st.integers(0, 40))
def test_edits_and_appends(text, new, a, b):
    coder = bpe.text_encoder(P.path("byte_bpe_50k.tiktoken")).bpe
    reference = tik_encode
    edited = bpe.EditableText(coder, text)
    assert edited.tokens() == reference(text)
    edited.append(new)
    assert edited.tokens() == reference(text + new)
    a, b = min(a, b), max(a, b)
    edited.edit(a, b, new)
    assert edited.tokens() == reference((text + new)[:a] + new + (text + new)[b:])
    table = bpe.PrefixTable(coder, text.encode())
    table.edit(0, 0, b"ab")
    assert table.tokens() == coder.merge(b"ab" + text.encode())


tik_encode = tik()


def test_bpe_query_matches_tiktoken(spark):
    out = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe.encode_documents(cases.frame(spark), digests=True).collect()}
    want = set()
    for i, t, *_ in cases.rows():
        ids = tik_encode(t or "")
        want.add((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids)))
    assert out == want
    assert bpe.encode_documents(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("window", [3000, packing.WINDOW_TOKENS])
def test_packing_places_every_id_once(spark, window):
    data = cases.rows()
    pieces = packing.pack_documents(cases.frame(spark), with_ids=True, window_tokens=window).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0 and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        by_seq[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at & (at - 1) == 0  # full or a power of two: no padding
    times = defaultdict(int)
    for i, *_ in data:
        times[i] += 1
    for i, t, *_ in data:
        want = _lib(t or "") + [0]
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == times[i] * len(want)
        for p in own:
            assert p["doc_tokens"] == len(want) and p["ids"] == want[p["start"] : p["start"] + p["length"]]
    assert packing.pack_documents(cases.empty(spark)).count() == 0
    assert sum(len(r["ids"]) for r in packing.sequences(packing.pack_documents(cases.frame(spark), with_ids=True)).collect()) == sum(p["length"] for p in pieces)


def test_packing_balances_costs():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 900, 400).tolist()
    load = defaultdict(float)
    for _, _, n, seq in packing.pack(lengths):
        load[seq] += packing.cost(n)
    full = sorted(load.values())
    assert full[int(0.9 * len(full))] < 2 * full[int(0.2 * len(full))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**32 - 1), st.just(5)), max_size=300), st.integers(0, 200))
def test_words_round_trip(ids, run):
    x = np.array(ids + [9] * run + ids[:3], np.uint32)
    assert np.array_equal(token_files.decode_words(token_files.encode_words(x)), x)
    assert np.array_equal(token_files.decode_words(token_files.escape(x)), x)
    assert np.array_equal(token_files.decode_block(token_files.encode_block(x)), x)


def test_files_round_trip_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    to = f"file://{tmp_path}/t"
    token_files.write_tokens(cases.frame(spark), to, partitions=3)
    got = sorted(token_files.read_tokens(spark, to, with_ids=True).collect(), key=lambda r: r["start"])
    data = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0]))
    at = 0
    for r, (i, t, *_) in zip(got, data, strict=True):
        want = _lib(t or "") + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    token_files.write_tokens(cases.empty(spark), f"{to}0")
    assert token_files.read_tokens(spark, f"{to}0").count() == 0
