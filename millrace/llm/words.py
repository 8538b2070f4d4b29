"""Words between ASCII white space, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words up to REACH bytes are hashed by a table of one 64-bit number for each place and byte, longer ones one by one.
REACH, BLOCK = 64, 1 << 18


def _table() -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.arange(1, REACH * 256 + 1, dtype=np.uint64) * _MIX_A
        x = (x ^ (x >> np.uint64(30))) * _MIX_B
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_TABLE = _table()
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D; bytes.split() cuts at exactly these."""
    return text.split()


def hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of all texts, one after the other, and the number of words of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.append(True, blank)))
    starts, length = edges[::2], edges[1::2] - edges[::2]
    sizes = np.diff(np.searchsorted(starts, np.append(0, np.cumsum([len(t) + 1 for t in texts]))))
    inside = data[~blank]
    first = np.cumsum(length) - length
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(inside), BLOCK)), len(first)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = first[i], first[j - 1] + length[j - 1]
        place = np.arange(hi - lo) - np.repeat(first[i:j] - lo, length[i:j])
        out[i:j] = np.add.reduceat(_TABLE[(np.minimum(place, REACH - 1) << 8) | inside[lo:hi]], first[i:j] - lo)
    for i in np.flatnonzero(length > REACH):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + length[i]])
    return out, sizes


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words: of hashes[i:i+k] at i. Empty if there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * _MIX_A
        for i in range(1, k):
            out ^= out >> np.uint64(29)
            out = (out + hashes[i : n + i]) * _MIX_B
        out ^= out >> np.uint64(32)
        out *= _MIX_A
        return out ^ (out >> np.uint64(29))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles, A-Z lower-cased, as hashes. Fewer than k words: all as one."""
    hashes, sizes = hash_texts([t.lower() for t in texts])
    runs = run_hashes(hashes, k)
    out = []
    for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        if n >= k or not n:
            out.append(np.unique(runs[end - n : end - k + 1]) if n else hashes[:0])
        else:
            out.append(run_hashes(hashes[end - n : end], n) + np.uint64(1))
    return out


def shingle_set(text: bytes, k: int) -> np.ndarray:
    return shingle_sets([text], k)[0]
