"""Vectorised 64-bit hashes of words and word n-grams over UTF-8 bytes.

A word's hash is a polynomial in its bytes modulo 2**64 (each byte mapped to a
fixed random 64-bit value), read off prefix sums over the whole text, so no
Python object per word is made.  Equal words hash equally wherever they
stand.  Modulo 2**64, long words can be made to collide whatever the base is
(a Thue-Morse word of 1,024 letters and its complement), so words above
``LONG_WORD`` bytes take XXH3 of their bytes instead.  Texts are taken in
pieces cut between words, so memory stays bounded for very long texts.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: bytes of text hashed at once
PIECE = 1 << 18
#: words above so many bytes are hashed by XXH3
LONG_WORD = 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64, endpoint=False)
_BASE = int(_rng.integers(0, 2**63, dtype=U64)) * 2 + 1 & (2**64 - 1)
_STEP = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > PIECE:  # a single word longer than a piece
        return _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
    if not _tables:
        _tables["t"] = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 2**64), PIECE)
    return _tables["t"]


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table, true for the bytes between words."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: words are [^\x20\x09-\x0D]+
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
#: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NON_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (a bijection)."""
    h = (h ^ (h >> U64(33))) * _M1
    h = (h ^ (h >> U64(33))) * _M2
    return h ^ (h >> U64(33))


def _piece_hashes(buf: np.ndarray, word: np.ndarray, at: bool = False):
    """``at``: give the words' places, too."""
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    if not len(edges):
        return (np.empty(0, dtype=U64), edges) if at else np.empty(0, dtype=U64)
    powers, inverse = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTE[buf] * powers[: len(buf)], out=sums[1:])
    starts, ends = edges[::2], edges[1::2]
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes())
    return (hashes, starts) if at else hashes


def word_hashes(text: bytes, seps: np.ndarray) -> np.ndarray:
    """The hashes of the words of a text, A-Z taken as a-z, in order."""
    buf = np.frombuffer(text.lower(), dtype=np.uint8)
    word = ~seps[buf]
    if len(buf) <= PIECE:
        return _piece_hashes(buf, word)
    out, start = [], 0
    gaps = np.append(np.flatnonzero(~word), len(buf))
    while start < len(buf):
        # the last gap that still fits, or the first one after a longer word
        at = max(np.searchsorted(gaps, start + PIECE, side="right") - 1, np.searchsorted(gaps, start + 1))
        stop = int(gaps[min(at, len(gaps) - 1)])
        stop = stop if stop > start else len(buf)
        out.append(_piece_hashes(buf[start:stop], word[start:stop]))
        start = stop
    return np.concatenate(out)


def hash_texts(texts: list[bytes], seps: np.ndarray) -> list[np.ndarray]:
    """``word_hashes`` of each text; short texts are hashed many at a time."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        last, size = k, 0
        while last < len(texts) and size + len(texts[last]) < PIECE:
            size += len(texts[last]) + 1
            last += 1
        if last - k < 2:
            out.append(word_hashes(texts[k], seps))
            k += 1
            continue
        buf = np.frombuffer(b"\n".join(texts[k:last]).lower(), dtype=np.uint8)
        hashes, starts = _piece_hashes(buf, ~seps[buf], at=True)
        ends = np.cumsum([len(x) + 1 for x in texts[k:last]])
        out += np.split(hashes, np.searchsorted(starts, ends[:-1]))
        k = last
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of ``n`` words; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=U64)
    h = words[:count].copy()
    for k in range(1, n):
        h *= _STEP
        h += words[k : k + count]
    return mixed(h)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of the ``n``-word shingles; of the whole
    sequence if it is shorter; empty without words."""
    if not len(words):
        return np.empty(0, dtype=U64)
    h = np.sort(ngram_hashes(words, min(n, len(words))))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def planes(values: np.ndarray) -> bytes:
    """Byte planes of a column: high bytes that are mostly zero come together,
    where Spark's shuffle compression takes them out."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).reshape(-1)
