"""SentencePiece encoding and decoding for merge-type vocabularies: an agenda of adjacent pairs, ordered by score."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.shared import raw, slices, text_rows
from millrace.llm.tokens import default_path

PIECES = "piece_bpe_32k.model"
#: Units that a worker keeps in memory, how many are learned at once, and how many the library sees side by side.
MOST_UNITS, TOGETHER, SIDE = 400_000, 20_000, 100
SPACE = "▁"
#: Symbols of a text whose agenda is a list; a place after all others; the half of a number that holds an id.
MOST_LISTED, _NONE, _ID, _LATE = 40, 1 << 62, (1 << 32) - 1, (1 << 31) - 1
SCHEMA = "doc_id long, ids binary, decoded string, agrees boolean"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"


class PieceBPE:
    """The pieces of a vocabulary with their scores. Text is taken as it stands (identity normalisation), each space written
    as SPACE, one SPACE put before a text that is not empty; characters in no piece become their bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_at: dict[int, int], unknown: int, begin: int, end: int, silent: set[int]):
        self.pieces, self.unknown, self.begin, self.end, self.silent = pieces, unknown, begin, end, silent
        self.byte_id = {b: i for i, b in bytes_at.items()}
        self.byte_ids = frozenset(bytes_at)
        self.data = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for i, b in bytes_at.items()} | dict.fromkeys(silent, b"")
        self.data.setdefault(unknown, " ⁇ ".encode())
        joined = [p for p in pieces if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            raise ValueError("a piece holds a space after other characters: texts cannot be cut before spaces")
        self.lines_apart = not any("\n" in p for p in joined)
        self.text_of = {i: p for p, (i, _) in pieces.items()}
        self.single = {p: i for p, (i, _) in pieces.items() if len(p) == 1}
        # each way to make a piece of two: left << 32 | right -> place of its score << 32 | piece
        place = {score: at for at, score in enumerate(sorted({pieces[p][1] for p in joined}, reverse=True))}
        self.pairs = {
            pieces[p[:k]][0] << 32 | pieces[p[k:]][0]: place[pieces[p][1]] << 32 | pieces[p][0] for p in joined for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces
        }
        # the same as arrays, for many texts at once: sorted pairs, the place of the score, the piece of a place
        order = np.array(sorted(self.pairs), np.int64)
        found = np.array([self.pairs[k] for k in order.tolist()], np.int64)
        self.sorted_pairs, self.places, self.piece_at = order, (found >> 32).astype(np.int32), np.zeros(len(place) + 1, np.int32)
        self.piece_at[self.places] = found & _ID
        self.single_at = np.full(0x110000, -1, np.int32)
        for c, i in self.single.items():
            self.single_at[ord(c)] = i
        self.opening = {p: place[pieces[p][1]] << 32 | pieces[p][0] for p in joined if len(p) == 2 and p[0] in pieces and p[1] in pieces}
        times = Counter(pieces[p][1] for p in joined)
        self.tied = {p[:2] for p in joined if times[pieces[p][1]] > 1}

    @classmethod
    def load(cls, path: str) -> PieceBPE:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        known = range(lib.get_piece_size())
        if any(lib.is_unused(i) for i in known):
            raise ValueError("vocabularies with unused pieces are not read")
        plain = {lib.id_to_piece(i): (i, lib.get_score(i)) for i in known if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        as_bytes = {i: int(lib.id_to_piece(i)[3:5], 16) for i in known if lib.is_byte(i)}
        return cls(plain, as_bytes, lib.unk_id(), lib.bos_id(), lib.eos_id(), {i for i in known if lib.is_control(i)})

    def symbols(self, text: str) -> list[int]:
        """The pieces of text, in which spaces are SPACE, by id, a character in no piece as the complement of its code point: of all adjacent pairs that make
        a piece the one of the highest score is joined, the leftmost of equal ones, until none is left.

        The agenda of a short text is a list with a pair for each symbol, of which the best is taken; that of a longer one is a heap."""
        symbols = list(map(self.single.get, text))
        if len(symbols) > MOST_LISTED or None in symbols or (self.tied and any(map(text.__contains__, self.tied))):
            return self._by_heap([~ord(c) if s is None else s for s, c in zip(symbols, text, strict=True)])
        get = self.pairs.get
        agenda = list(map(self.opening.get, map(add, text, text[1:]), repeat(_NONE)))
        agenda.append(_NONE)
        while (best := min(agenda)) != _NONE:
            at = agenda.index(best)
            symbols[at] = piece = best & _ID
            del symbols[at + 1], agenda[at]
            if at:
                agenda[at - 1] = get(symbols[at - 1] << 32 | piece, _NONE)
            if at + 1 < len(symbols):
                agenda[at] = get(piece << 32 | symbols[at + 1], _NONE)
        return symbols

    def _place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of the score of each pair, one after all others where it makes no piece."""
        if not len(self.sorted_pairs):
            return np.full(left.shape, _LATE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.sorted_pairs, keys), len(self.sorted_pairs) - 1)
        return np.where(self.sorted_pairs[at] == keys, self.places[at], _LATE).astype(np.int32)

    def many(self, texts: list[str]) -> list[bytes | None]:
        """ids() of short texts that are not empty, as bytes, all at once; null for one with characters that are no piece or with tied pieces.

        Each text has a row of symbols and a row of the places of its pairs, its agenda; in each round every row with a pair left
        joins its best one, the leftmost of equal ones, and looks up the two pairs beside it."""
        if not texts:
            return []
        sizes = np.array([len(t) for t in texts], np.int64)
        wide, every = int(sizes.max()), np.arange(len(texts))
        symbols = np.full((len(texts), wide + 1), -1, np.int32)  # the last column stands for what is beyond either end
        symbols[:, :wide][np.arange(wide) < sizes[:, None]] = self.single_at[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        plain = (symbols >= 0).sum(1) == sizes
        if self.tied and any(map("".join(texts).__contains__, self.tied)):
            plain &= ~np.array([any(map(t.__contains__, self.tied)) for t in texts])
        after = np.broadcast_to(np.minimum(np.arange(wide + 1) + 1, wide), symbols.shape).copy()
        after[every, sizes - 1] = wide
        before = np.broadcast_to(np.concatenate(([wide], np.arange(wide))), symbols.shape).copy()
        agenda = np.full(symbols.shape, _LATE, np.int32)
        agenda[:, :wide] = self._place(symbols[:, :-1], symbols[:, 1:])
        rows = every[plain]
        while len(rows):
            at = agenda[rows].argmin(1)
            best = agenda[rows, at]
            open_ = best < _LATE
            rows, at, best = rows[open_], at[open_], best[open_]
            gone = after[rows, at]
            far, near = after[rows, gone], before[rows, at]
            symbols[rows, at] = piece = self.piece_at[best]
            symbols[rows, gone] = -1
            agenda[rows, gone] = _LATE
            after[rows, at] = far
            before[rows, far] = at
            agenda[rows, at] = self._place(piece, symbols[rows, far])
            agenda[rows, near] = self._place(symbols[rows, near], piece)
            agenda[rows, wide] = _LATE
        kept = symbols >= 0
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        data = symbols[kept].astype("<u4").tobytes()
        return [data[x:y] if ok else None for x, y, ok in zip([0, *ends[:-1]], ends, plain.tolist(), strict=True)]

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """Entries are place of the score << 32 | left symbol; one whose pair has changed since has another place and is skipped."""
        get, last = self.pairs.get, len(symbols) - 1
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, last))
        agenda = [(found >> 32) << 32 | i for i in range(last) if (found := get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(agenda)
        gone = [False] * len(symbols)
        while agenda:
            entry = heappop(agenda)
            left = entry & _ID
            right = after[left]
            if gone[left] or right > last:
                continue
            found = get(symbols[left] << 32 | symbols[right])
            if found is None or found >> 32 != entry >> 32:
                continue
            symbols[left], gone[right] = found & _ID, True
            far = after[left] = after[right]
            if far <= last:
                before[far] = left
                if (found := get(symbols[left] << 32 | symbols[far])) is not None:
                    heappush(agenda, (found >> 32) << 32 | left)
            if (near := before[left]) >= 0 and (found := get(symbols[near] << 32 | symbols[left])) is not None:
                heappush(agenda, (found >> 32) << 32 | near)
        return [s for s, dead in zip(symbols, gone, strict=True) if not dead]

    def merge(self, text: str) -> list[str]:
        return [chr(~s) if s < 0 else self.text_of[s] for s in self.symbols(text)]

    def ids(self, text: str) -> list[int]:
        out = self.symbols(text)
        if min(out, default=0) >= 0:
            return out
        return [i for s in out for i in ((s,) if s >= 0 else [self.byte_id[b] for b in chr(~s).encode()] if self.byte_id else (self.unknown,))]

    def decode(self, ids: list[int]) -> str:
        """The text: control ids say nothing and end a run, the first other piece loses one SPACE before it, runs of byte ids are read as
        UTF-8, each byte that is none as U+FFFD."""
        silent = self.silent
        first, last = next((k for k, i in enumerate(ids) if i not in silent), len(ids)), len(ids)
        while last > first and ids[last - 1] in silent:
            last -= 1
        head = self.data[ids[first]] if first < last else b""
        if head[:1] == b" " and ids[first] not in self.byte_ids and ids[first] != self.unknown:
            head = head[1:]
        rest = ids[first + 1 : last]
        if not any(map(rest.count, silent)):
            try:
                return (head + b"".join(map(self.data.__getitem__, rest))).decode()
            except UnicodeDecodeError:
                pass
        return self._decode_odd(ids[first:last], head)

    def _decode_odd(self, ids: list[int], head: bytes) -> str:
        out, run = [], b""
        for k, i in enumerate(ids):
            if i in self.byte_ids:
                run += self.data[i]
            else:
                out += [_spelled(run), (head if k == 0 else self.data[i]).decode()]
                run = b""
        return "".join([*out, _spelled(run)])


def _spelled(run: bytes) -> str:
    """UTF-8 of a run of bytes, each byte that begins no character as U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class PieceEncoder:
    """Ids of whole texts, meeting repeated units in a bounded memory. No piece holds a space after another character, so a text may
    be cut before each run of spaces; no piece of the given vocabulary holds a line break with others, so lines are cut apart too."""

    _CUT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, bpe: PieceBPE):
        self.bpe = bpe
        #: What a unit stands for: a word after one space, or what follows a line break with the break before it.
        self.units: dict[str, bytes] = {}
        #: Units learned since they were last looked at.
        self.fresh: dict[str, bytes] = {}

    def _spelled(self, unit: str) -> str:
        return unit if unit[:1] == "\n" and self.bpe.lines_apart else SPACE + unit

    def _learn(self, short: list[str]) -> None:
        """Short units all at once, those of about one length together; those with characters of their own one by one."""
        short.sort(key=len)
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            # a line break is a symbol of bytes: it is put before afterwards
            breaks = [u[:1] == "\n" and self.bpe.lines_apart for u in part]
            known = iter(self.bpe.many([u[1:] if b else SPACE + u for u, b in zip(part, breaks, strict=True) if u != "\n" or not b]))
            for unit, b in zip(part, breaks, strict=True):
                if (ids := b"" if b and unit == "\n" else next(known)) is None:
                    ids = self._ids(unit)
                elif b:
                    ids = self._break + ids
                self.units[unit] = self.fresh[unit] = ids

    @cached_property
    def _break(self) -> bytes:
        return array("I", self.bpe.ids("\n")).tobytes()

    def _ids(self, unit: str) -> bytes:
        return array("I", self.bpe.ids(self._spelled(unit))).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without begin and end."""
        if len(self.units) >= MOST_UNITS:
            self.units.clear()
        words: list[str] = []
        ends, odd = [0], {}
        for k, text in enumerate(texts):
            if SPACE in text or "  " in text or text[:1] == " " or text[-1:] == " ":
                odd[k] = self._odd(text)
            elif text:
                words += (text.replace("\n", " \n") if self.bpe.lines_apart else text).split(" ")
            ends.append(len(words))
        found = list(map(self.units.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = {words[i] for i in missing}
        self._learn([u for u in new if len(u) < MOST_LISTED])
        for i in missing:
            unit = words[i]
            if (ids := self.units.get(unit)) is None:
                ids = self.fresh[unit] = self._ids(unit)  # a long one
            found[i] = ids
        return [odd[k] if k in odd else b"".join(found[ends[k] : ends[k + 1]]) for k in range(len(texts))]

    def _odd(self, text: str) -> bytes:
        """A text with runs of spaces: each run with what follows it up to the next, line by line."""
        out = []
        for unit in self._CUT.findall(SPACE + text.replace(" ", SPACE)):
            lines = unit.split("\n") if self.bpe.lines_apart else [unit]
            out.append(self._break.join([array("I", self.bpe.ids(line)).tobytes() if line else b"" for line in lines]))
        return b"".join(out)


class Checked:
    """An encoder beside the sentencepiece library. Texts are cut into units, so it is enough that the library gives the same ids for each
    unit when it is learned: those of a batch are one text for it. Once one differed, whole texts are compared; so are texts with runs of spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder, self.library = PieceEncoder(PieceBPE.load(path)), sentencepiece.SentencePieceProcessor(model_file=path)
        self.differs = False

    def _same(self, fresh: dict[str, bytes]) -> bool:
        """Words side by side as lines of text, which the library begins with a space, and the units that begin with a line break."""
        words, breaks = ([u for u in fresh if u and (u[0] == "\n") == of] for of in (False, True))
        lines = [(words[at : at + SIDE], " ", b"") for at in range(0, len(words), SIDE)]
        lines += [(breaks[at : at + SIDE], "", array("I", self.coder.bpe.ids(SPACE)).tobytes()) for at in range(0, len(breaks), SIDE)]
        theirs = self.library.encode([by.join(units) for units, by, _ in lines], num_threads=1)
        return all(array("I", x).tobytes() == first + b"".join(map(fresh.__getitem__, units)) for x, (units, _, first) in zip(theirs, lines, strict=True))

    def agree(self, texts: list[str], ids: list[list[int]], decoded: list[str]) -> list[bool]:
        """For each text whether the library gives these ids, begin and end among them, and decodes them to the same."""
        fresh, self.coder.fresh = self.coder.fresh, {}
        self.differs = self.differs or not self._same(fresh)
        whole = [k for k, t in enumerate(texts) if self.differs or "  " in t or SPACE in t or t[:1] == " " or t[-1:] == " "]
        theirs = dict(zip(whole, self.library.encode([texts[k] for k in whole], add_bos=True, add_eos=True, num_threads=1), strict=True))
        return [a == theirs.get(k, a) and self.library.decode(a) == c for k, (a, c) in enumerate(zip(ids, decoded, strict=True))]


_encoders: dict[tuple[str, bool], PieceEncoder | Checked] = {}


def piece_encoder(path: str, checked: bool = False) -> PieceEncoder | Checked:
    """One for each Python worker, which is used for many tasks."""
    if (path, checked) not in _encoders:
        _encoders[path, checked] = Checked(path) if checked else PieceEncoder(PieceBPE.load(path))
    return _encoders[path, checked]


def encode_pieces(docs: DataFrame, path: str | None = None, digests: bool = False, check: bool = True) -> DataFrame:
    """(doc_id, ids, decoded, agrees) for each row of docs: ids with begin and end id as little-endian unsigned 32-bit integers, the
    text decoded from them, and whether the sentencepiece library, asked in the same batch, gives the same ids and text (null without check).

    Null and empty texts have the begin and end id alone and decode to the empty text. Bytes that are no UTF-8 count as U+FFFD.
    Repeated rows are encoded each, null doc_ids are kept, other columns of any name make no difference, an empty table gives none.
    digests gives (doc_id, n_tokens, ids_sha256, decoded_sha256, agrees) instead of sending ids and texts on.
    """
    path = path or default_path(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = piece_encoder(path, checked=True) if check else None
        coder = checker.coder if checker else piece_encoder(path)
        begin, end = (array("I", [i]).tobytes() for i in (coder.bpe.begin, coder.bpe.end))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [t.decode("utf-8", "replace") for t in raw(part.column("text"))]
                ids = [begin + x + end for x in coder.encode(texts)]
                if not checker:
                    coder.fresh.clear()
                lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
                decoded = [coder.bpe.decode(x) for x in lists]
                agrees = checker.agree(texts, lists, decoded) if checker else [None] * len(ids)
                if digests:
                    columns = [
                        pa.array(map(len, lists), pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
                else:
                    columns, names = [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded", "agrees"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(agrees, pa.bool_())], names=names)

    return text_rows(docs).mapInArrow(run, DIGESTS if digests else SCHEMA)
