"""Ids of whole texts equal the library's, whatever the text and the file."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from adlift.llm import tokens
from adlift.llm.common import WORD_BPE
from adlift.llm.tokens import Encoder, latin_lowered, lowered

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MARKS = [chr(c) for c in (*range(0x300, 0x370), 0x1DC0, 0x20D0, 0x3099, 0x5B0, 0x64B, 0x200D, 0xFE0F)]
LETTERS = [*"ABCHJTWZabchjtwz.,'!?0123 \t\n\x0b\x0c\r\x1c\x1f\x00-_<|>sSdDtTlLmMrRvVeE", *"ÀÉåßŒΣσςİıКЯ한글각中文だ;`½²😀क", "K", "Å", "\x85", "\xa0", " ", "　", "​"]
ADDED = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice(LETTERS))
            if rng.random() < 0.3:
                out.append(rng.choice(MARKS))
            if rng.random() < 0.002:
                out.append(rng.choice(ADDED))
        yield "".join(out)


def same(path, some):
    found = Encoder(path).encode([t.encode() for t in some])
    wanted = Tokenizer.from_file(path).encode_batch_fast(some, add_special_tokens=False)
    for t, x, y in zip(some, found, wanted):
        assert np.frombuffer(x, "<u4").tolist() == y.ids, repr(t)


@pytest.mark.parametrize("path, cuts, n", [(WORD_BPE, True, 100_000), (BYTE_BPE, False, 5_000)])
def test_ids_are_the_librarys(path, cuts, n):
    assert Encoder(path).cuts is cuts
    same(path, ["H̱ J̌ T̈ W̊", "Hello World, again.", "", " ", "İI.İ,ǅ'S", *texts(n, 11)])


def test_long_pieces_that_a_polynomial_confuses():
    pairs = []
    for n in (16, 64, 1024, 2048):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        pairs += [one, one.translate({97: "b", 98: "a"}), one + " " + one.translate({97: "b", 98: "a"})]
    same(WORD_BPE, pairs)


def test_lowered():
    assert lowered(b"AZ@[az") == b"az@[az"
    assert lowered("ABÀĆD".encode()) == "aBÀĆd".encode()


def test_plain_pieces_go_to_the_model():
    """Words of lower-case letters skip the library's other steps, and marks
    behind a word make no other word of it; the ids stay the library's."""
    letters = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xDF, 0x100)), *"ªµ×ÄÉ"]
    marks = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "̸", "'s", "'t", "###", "4"]
    rng = random.Random(3)
    some = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice([*marks, "", ""]) + rng.choice([*letters, *marks, ""]) for _ in range(20_000)]
    same(WORD_BPE, some + [a + b + c for a in "aé" for b in marks for c in (*marks, "a", "é")])
    own, through = Encoder(WORD_BPE), []
    library = own._library
    own._library = lambda texts: through.extend(texts) or library(texts)
    own.encode([w.encode() for w in ("where", "straße où", "where; where! where", "where### there")])
    assert sorted(through) == [b"!", b"###", b";"]


def test_latin_words_go_to_the_model():
    """Small letters are made of Latin-1 capitals, and marks behind any letter
    of Latin-1 make no other word of it; the ids stay the library's."""
    assert latin_lowered("ÀÉß×ÞÉ̸É中É é".encode()) == "àéß×þÉ̸É中é é".encode()
    letters = [*map(chr, range(0xA0, 0x100)), *"ĀćaZ中"]
    marks = [*"!'.=<>`~^", "'s", "'T", "̸", "́", "̧", "\xa0", " ", "4", ""]
    rng = random.Random(6)
    same(WORD_BPE, ["".join(rng.choice(letters) + rng.choice(marks) for _ in range(rng.randint(1, 6))) for _ in range(30_000)])
    same(WORD_BPE, [a + b + c for a in letters for b in marks for c in (*letters, *marks)])
    own, through = Encoder(WORD_BPE), []
    library = own._library
    own._library = lambda texts: through.extend(texts) or library(texts)
    own.encode([w.encode() for w in ("École où, OÙ! été. ÉTÉ### ÀÉ", "é. ×. ÷,")])
    assert sorted(through) == sorted(x.encode() for x in (",", "!", ".", "###", "×.", "÷,"))


def test_cuts_of_bytes_that_are_not_utf8():
    """A byte that begins a letter and is followed by none makes no letter."""
    rng = random.Random(8)
    some = [b"\xc3\xc3.", b"\xc3.", b"\xc3\x89\xc3", *(bytes(rng.choices(b"\xc3\xc2\xe2\x89\xa9\x97\xb7Aa. \xff\x80\xcc\xf0", k=rng.randint(0, 8))) for _ in range(20_000))]
    wanted = Tokenizer.from_file(WORD_BPE).encode_batch_fast([t.decode("utf-8", "replace") for t in some], add_special_tokens=False)
    for t, x, y in zip(some, Encoder(WORD_BPE).encode(some), wanted):
        assert np.frombuffer(x, "<u4").tolist() == y.ids, t


def test_pieces_beyond_those_kept(monkeypatch):
    """The table of pieces grows, starts anew when it is full, and keeps
    pieces apart whose hashes share a place."""
    monkeypatch.setattr(tokens, "KEPT", 5_000)
    rng = random.Random(9)
    own, library = Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    sizes = []
    for _ in range(8):
        some = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 7))) for _ in range(300)) for _ in range(10)]
        for t, x in zip(some, own.encode([t.encode() for t in some])):
            assert np.frombuffer(x, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        sizes.append(len(own.hashes))
    assert max(sizes) <= 5_000 and sorted(sizes) != sizes
    hashes = np.arange(1, 40_001, dtype=np.uint64) << np.uint64(40)  # all of one place
    own._forget()
    for part in np.split(hashes[:400], 4):
        own._name(part)
    assert own._find(hashes[:402]).tolist() == [*range(400), -1, -1]
    own._name(np.arange(1, 70_001, dtype=np.uint64))
    assert len(own.table) >= 2 * 70_400 and (own._find(own.hashes) == np.arange(70_400)).all()
