"""Encoding with the tokenizers library, each distinct word once per worker.

Under the normaliser and the pretokenizer of ``WORD_RULES``, pretokens never
span white space and begin anew at an ASCII punctuation mark that follows a
letter (of ASCII or U+00C0 to U+00FF), so a text's ids are those of its pieces
cut there, in order.  Pieces are found and hashed (64 bits; above ``LONG_WORD``
bytes by XXH3) many at a time; each distinct one is encoded by the library and
its ids kept (up to ``KEPT`` pieces, then the table starts anew).  The rules
compose characters (NFC) before they lower-case, so only a letter before an
ASCII byte or one of U+00C0 to U+00FF is lower-cased here: nothing composes with
it.  A piece of letters that the rules leave as they are (a-z and those of
Latin-1) is one pretoken and goes to the library's model alone.

Whole texts go through the library if they could hold an added token, and with
any tokenizer file of other rules or other added tokens.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import xxhash

from .text_hash import _BASE, _BYTE, _powers, LONG_WORD, SPACES, U64, mixed

#: pieces, and ids of pieces, kept by a worker process: 50 MB or so
KEPT, KEPT_IDS = 1_000_000, 6_000_000
#: bytes of text taken at once
CHUNK = 1 << 21
#: bytes whose hashes are summed at once, in the processor's cache
HASHED = 1 << 15

#: the rules that the cuts are right for, as the tokenizer file states them
WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: how the added tokens begin, in a file whose texts are cut
MARK = "<|"

#: kinds of bytes: white space, ASCII letters, ASCII punctuation, others
_SPACE, _LETTER, _STOP = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[SPACES] = _SPACE
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _STOP
_KINDS = _KIND.tobytes()
#: U+00C0 to U+00FF are this byte and another
_LATIN = 0xC3
#: pieces that the rules leave as they are: lower-case letters, which do not compose
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_encoders: dict[str, "Encoder"] = {}
_tables: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if n > CHUNK:  # a single word longer than a chunk
        return [_powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)]
    if not _tables:
        _tables.extend((_powers(_BASE, CHUNK), _powers(pow(_BASE, -1, 2**64), CHUNK)))
    return _tables


def cuttable(rules: dict) -> bool:
    """Whether the texts of a tokenizer file (as parsed) may be cut."""
    same = all(rules.get(k) == v for k, v in WORD_RULES.items())
    model = rules.get("model") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not rules.get("truncation") and not rules.get("padding")
    added = all(MARK in t["content"] and not t["normalized"] for t in rules.get("added_tokens") or [])
    return same and plain and added


def lowered(text: bytes) -> bytes:
    """A-Z as a-z, but before a byte that is not ASCII: a mark could follow."""
    if text.isascii():
        return text.lower()
    buf = np.frombuffer(text, dtype=np.uint8)
    upper = (buf - np.uint8(65) < 26) & np.append(buf[1:] < 128, True)
    return (buf + (upper.view(np.uint8) << np.uint8(5))).tobytes()


def latin_lowered(text: bytes) -> bytes:
    """Capitals of U+00C0 to U+00DE before ASCII or ``_LATIN``, and A-Z before
    ``_LATIN``, as small letters."""
    buf = np.frombuffer(text, dtype=np.uint8)
    latin = buf == _LATIN
    if not latin.any():
        return text
    before = np.append(latin[1:], False)
    upper = (buf - np.uint8(0x80) < 0x1F) & (buf != 0x97) & (before | np.append(buf[1:] < 128, True))
    upper &= np.append(False, latin[:-1])
    upper |= (buf - np.uint8(65) < 26) & before
    return (buf + (upper.view(np.uint8) << np.uint8(5))).tobytes()


def _pieces(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the pieces of lower-cased text."""
    buf, kind = np.frombuffer(text, dtype=np.uint8), np.frombuffer(text.translate(_KINDS), dtype=np.uint8)
    word = kind != _SPACE
    letter = kind == _LETTER
    # of the bytes behind _LATIN, all but those of two signs make letters
    letter[1:] |= (buf[:-1] == _LATIN) & (buf[1:] - np.uint8(0x80) < 0x40) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[1:-1] = (kind[1:] == _STOP) & letter[:-1]
    starts = np.flatnonzero(word & (cut[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (cut[1:] | ~np.concatenate((word[1:], [False])))) + 1
    powers, inverse = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=U64)
    for k in range(0, len(buf), HASHED):
        values = _BYTE.take(buf[k : k + HASHED], mode="clip")
        values *= powers[k : k + len(values)]
        values[:1] += sums[k : k + 1]
        np.cumsum(values, out=sums[k + 1 : k + 1 + len(values)])
    hashes = mixed((sums.take(ends) - sums.take(starts)) * inverse.take(starts))
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(text[starts[k] : ends[k]])
    return starts, ends, hashes


class Encoder:
    """ids of texts, little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the model reads bytes as the byte-level pretokenizer writes them: as
        # Latin-1, but for these of a plain piece
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        written = {c: level.pre_tokenize_str(chr(c))[0][0][1] for c in range(0xDF, 0x100)}
        self.written = [(chr(c - 0x40), x) for c, x in written.items() if chr(c - 0x40) != x]
        self.cuts = cuttable(json.loads(self.tokenizer.to_str()))
        self._forget()

    def _forget(self):
        # of each kept piece: hash, where its ids are, how many
        self.hashes, self.at, self.n = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, dtype="<u4")
        # the number of a piece, from 1, at its hash's low bits or the next free place
        self.table = np.zeros(1 << 16, dtype=np.int32)

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Keep the ids of pieces, each of them new."""
        plain, rest = [], []
        for k, x in enumerate(pieces):
            (plain if x.isalpha() and x.islower() or _PLAIN.fullmatch(x) else rest).append(k)
        written = b"\n".join([pieces[k] for k in plain]).decode("latin-1")
        for byte, x in self.written:
            written = written.replace(byte, x)
        tokenize, ids, n = self.model.tokenize, [], []
        for x in written.split("\n") if plain else ():
            tokens = tokenize(x)
            n.append(len(tokens))
            ids += [t.id for t in tokens]
        for x in self._library([pieces[k] for k in rest]) if rest else ():
            n.append(len(x))
            ids += x
        n, ids = np.array(n, dtype=np.int64), np.array(ids, dtype="<u4")
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])
        self._name(hashes[plain + rest])

    def _name(self, hashes: np.ndarray) -> None:
        """Enter pieces into the table, which stays half empty at least."""
        known = len(self.hashes)
        self.hashes = np.concatenate([self.hashes, hashes])
        if 2 * len(self.hashes) > len(self.table):
            self.table = np.zeros(1 << (2 * len(self.hashes)).bit_length(), dtype=np.int32)
            hashes, known = self.hashes, 0
        numbers = np.arange(known + 1, len(self.hashes) + 1, dtype=np.int32)
        last = len(self.table) - 1
        slots = (hashes & U64(last)).astype(np.intp)
        while len(slots):
            free = self.table[slots] == 0
            self.table[slots[free]] = numbers[free]
            later = self.table[slots] != numbers
            slots, numbers = (slots[later] + 1) & last, numbers[later]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of pieces among those kept, -1 if they are not."""
        last = len(self.table) - 1
        slots = (hashes & U64(last)).astype(np.intp)
        place = self.table.take(slots, mode="clip").astype(np.intp) - 1
        if not len(self.hashes):
            return place
        # another piece may be there: go on until the piece or a free place
        open_ = np.flatnonzero((place >= 0) & (self.hashes.take(place, mode="clip") != hashes))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & last
            place[open_] = self.table[slots[open_]].astype(np.intp) - 1
            here = place[open_]
            open_ = open_.take(np.flatnonzero((here >= 0) & (self.hashes.take(here, mode="clip") != hashes[open_])))
        return place

    def _encode_chunk(self, texts: list[bytes]) -> list[bytes]:
        joined = latin_lowered(lowered(b"\n".join(texts)))
        starts, ends, hashes = _pieces(joined)
        place = self._find(hashes)
        missing = np.flatnonzero(place < 0)
        new, first = np.unique(hashes[missing], return_index=True)
        if len(self.hashes) + len(new) > KEPT or len(self.ids) > KEPT_IDS:
            self._forget()
            missing = np.arange(len(hashes))
            new, first = np.unique(hashes, return_index=True)
        if len(new):
            first = missing[first]
            self._learn(new, [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            place[missing] = self._find(hashes[missing])
        n, at = self.n.take(place), self.at.take(place)
        upto = np.cumsum(n)
        places = np.repeat(at - (upto - n), n)
        places += np.arange(len(places))
        ids = self.ids.take(places)
        stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        stops = np.concatenate(([0], upto))[stops]
        return [x.tobytes() for x in np.split(ids, stops[:-1])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            for (i, _), ids in zip(waiting, self._encode_chunk([t for _, t in waiting]) if waiting else ()):
                out[i].append(ids)
            waiting.clear()

        for i, text in enumerate(texts):
            if not self.cuts or MARK.encode() in text:
                out[i].append(np.array(self._library([text])[0], dtype="<u4").tobytes())
                continue
            for part in _parts(text):
                if size + len(part) >= CHUNK:
                    flush()
                    size = 0
                waiting.append((i, part))
                size += len(part) + 1
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def _parts(text: bytes) -> list[bytes]:
    """A text in parts below ``CHUNK`` bytes, cut at spaces and line breaks."""
    out, start = [], 0
    while len(text) - start >= CHUNK:
        at = max(text.rfind(c, start + 1, start + CHUNK) for c in (b" ", b"\n"))
        if at < 0:
            at = min((p for c in (b" ", b"\n") if (p := text.find(c, start + CHUNK - 1)) >= 0), default=len(text))
        out.append(text[start:at])
        start = at
    return out + [text[start:]]


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        # a task has one core; the library's threads cost more than they give
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]
