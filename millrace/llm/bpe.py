"""Byte-level BPE by dynamic programming over prefixes: each prefix of a pre-token has one valid last token."""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.shared import raw, slices, text_rows
from millrace.llm.tokens import BPE_RANKS, default_path, units

MOST_UNITS, MOST_PAIRS = 300_000, 500_000
_NONE = 1 << 60
SCHEMA = "doc_id long, ids binary, decoded binary"


class PrefixBPE:
    """Ranks of a BPE vocabulary over bytes, with the tests that the dynamic program asks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pattern = regex.compile(pattern)
        self.valid: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.places = ahocorasick.Automaton()  # finds the tokens that end at each byte, the longest first
        for data, rank in ranks.items():
            self.places.add_word(data.decode("latin-1"), (rank, len(data)))
        if ranks:
            self.places.make_automaton()

    @classmethod
    def load(cls, path: str) -> PrefixBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, data: bytes) -> list[int]:
        """The plain definition: join the neighbours of the lowest rank until none can be joined."""
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while joined and (rank := min(joined)) != _NONE:
            at = joined.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at], _NONE)
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def is_valid(self, token: int) -> bool:
        """Whether the bytes of the token are encoded as this token."""
        if (known := self.valid.get(token)) is None:
            known = self.valid[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether right is valid and the bytes of both, joined, are encoded as these two tokens."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.is_valid(right) and self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def extend(self, last: list[int], data: bytes) -> None:
        """Fill last, which ends at some prefix of data, up to all of data: last[i] is the last token of its first i bytes."""
        done = len(last) - 1
        begin = max(0, done + 1 - self.longest)
        pairs, see = self.pairs.get, self.may_follow
        for at, (token, n) in self.places.iter(data[begin:].decode("latin-1")):
            end = begin + at + 1
            if end <= done or end < n:
                continue
            if end > done + 1:
                break
            if end == n:
                fits = self.is_valid(token)
            else:
                left = last[end - n]
                if (fits := pairs(left << 32 | token)) is None:
                    fits = see(left, token)
            if fits:
                last.append(token)
                done = end
        if done < len(data):
            raise ValueError(f"byte {data[done]} is in no token")

    def split(self, last: list[int]) -> list[int]:
        """The tokens, from the last token of each prefix."""
        out, end = [], len(last) - 1
        while end:
            token = last[end]
            out.append(token)
            end -= len(self.bytes_of[token])
        return out[::-1]


class PrefixTable:
    """last[i] is the last token of the encoding of the first i bytes: appends and cuts leave the rest as it is."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.last, self.data)

    def cut(self, length: int) -> None:
        """Back to the first `length` bytes."""
        self.data, self.last = self.data[:length], self.last[: length + 1]

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]. Looks anew at what follows start, up to where as many last tokens as a token has bytes
        at most are as they were: those after them depend on nothing else."""
        reach, old, rest = self.bpe.longest, self.last, self.data[end:]
        self.cut(start)
        self.append(new)
        at = 0  # bytes of rest that are done
        while at < len(rest):
            self.append(rest[at : at + reach])
            at = min(len(rest), at + reach)
            if at >= reach and self.last[-reach:] == old[end + at + 1 - reach : end + at + 1]:
                self.data, self.last = self.data + rest[at:], self.last + old[end + at + 1 :]
                return

    def tokens(self) -> list[int]:
        return self.bpe.split(self.last)


class EditableText:
    """An encoded text that takes edits: pre-tokens that an edit leaves alone keep their tables, and are not read again."""

    #: A pre-token may depend on what follows it as far as white space goes, which makes no more than so many pre-tokens.
    BACK = 3

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe = bpe
        self.parts: list[str] = bpe.pattern.findall(text)
        self.tables = [PrefixTable(bpe, p.encode()) for p in self.parts]

    def append(self, more: str) -> None:
        n = sum(map(len, self.parts))
        self.edit(n, n, more)

    def edit(self, start: int, end: int, new: str) -> None:
        ends = list(accumulate(map(len, self.parts)))
        first = max(0, bisect_right(ends, start) - self.BACK)
        last, ahead = bisect_left(ends, end) + 1, 16
        begin = ends[first - 1] if first else 0
        while True:  # read on until a pre-token ends where one did, which then is also where the rest begins
            stop = min(len(self.parts), last + ahead)
            old = "".join(self.parts[first:stop])
            text = old[: start - begin] + new + old[end - begin :]
            shift = len(text) - len(old)
            known = {e + shift: i + 1 for i, e in enumerate(ends[:stop]) if i >= first and e >= end}
            made, at = [], begin
            for part in self.bpe.pattern.findall(text):
                made.append(part)
                at += len(part)
                if at in known and (stop == len(self.parts) or known[at] <= stop - self.BACK):
                    break
            if stop == len(self.parts) or at in known and known[at] <= stop - self.BACK:
                break
            ahead *= 4
        to = known.get(at, stop) if made else stop
        gone = self.tables[first:to]
        tables = []
        for part in made:
            data = part.encode()
            if gone and data.startswith(gone[0].data):  # an append to a pre-token
                table = gone.pop(0)
                table.append(data[len(table.data) :])
            else:
                table = PrefixTable(self.bpe, data)
            tables.append(table)
        self.parts[first:to], self.tables[first:to] = made, tables

    def tokens(self) -> list[int]:
        return [t for table in self.tables for t in table.tokens()]


class TextEncoder:
    """Ids of whole texts by PrefixBPE, meeting repeated units in a bounded memory."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.first, self.later = bpe, {}, {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if (known := self.words.get(word)) is None:
            data = word.encode()
            token = self.bpe.ranks.get(data)
            if token is not None and self.bpe.is_valid(token):
                known = token.to_bytes(4, "little")
            else:
                self.bpe.extend(last := [-1], data)
                ids = self.bpe.split(last)
                known = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= 64:
                if len(self.words) >= MOST_UNITS:
                    self.words.clear()
                self.words[word] = known
        return known

    def _unit(self, memory: dict[str, bytes], unit: str, lead: str) -> bytes:
        if (known := memory.get(unit)) is None:
            before, newline, after = unit.partition("\n")
            if newline and before and after and not before[-1].isspace() and not after[0].isspace():
                return self._unit(memory, before, lead) + self._unit(self.first, "\n", "") + self._unit(self.first, after, "")
            if unit.isalpha():  # letters alone are one pre-token
                return self._word(lead + unit)
            known = b"".join(map(self._word, self.bpe.pattern.findall(lead + unit)))
            if len(unit) <= 64:
                if len(memory) >= MOST_UNITS:
                    memory.clear()
                memory[unit] = known
        return known

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        head, *rest = units(text)
        words, later, unit = self.words, self.later, self._unit
        return unit(self.first, head, "") + b"".join([words.get(" " + u) or later.get(u) or unit(later, u, " ") for u in rest])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bpe.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(PrefixBPE.load(path))
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) for each row of docs: ids little-endian unsigned 32-bit, decoded the bytes they stand for.

    Each match of the pattern is encoded alone; no special tokens. Null or empty texts give no ids and no bytes.
    Repeated rows, null doc_ids and other columns make no difference. digests gives (doc_id, n_tokens, ids_sha256,
    decoded_sha256) of these instead of sending them on.
    """
    path = path or default_path(BPE_RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [coder.encode(t.decode()) for t in raw(part.column("text"))]
                decoded = [coder.decode(x) for x in ids]
                if digests:
                    sha = [[hashlib.sha256(x).hexdigest() for x in column] for column in (ids, decoded)]
                    columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns, names = [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA)
