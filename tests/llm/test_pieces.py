"""Pieces of units, cut from arrays of code points."""

import re

import numpy as np
import public_tokenizers

from apexframe.llm import tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LETTER, MARK = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ſ", r'!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~'
PLAIN = re.compile(rf"(?:\n| )?[{LETTER}0-9{MARK}]+")
PIECES = re.compile(rf"\n| ?[{LETTER}]+| ?[0-9]+| ?[{MARK}]+")
UNITS = ["", " ", "\n", " word", "\nWord,", " x12y", "...", " naïve!?", " \xd7", "ſ", "ƀ", "it's", " a b", "\n\n", " \n", "\0", "日本", " <b", "œuvre-9", "12", " 7.5%", "\t"]


def test_pieces_are_runs_of_one_kind():
    plain, pieces, counts = tokens.pieces_of(UNITS)
    assert plain.tolist() == [bool(PLAIN.fullmatch(u)) for u in UNITS]
    expected = [PIECES.findall(u) for u, p in zip(UNITS, plain) if p]
    assert counts.tolist() == [len(x) for x in expected]
    assert pieces.to_pylist() == ["".join(tokens.LETTERS[b] for b in piece.encode()) for x in expected for piece in x]
    assert [len(x) for x in tokens.pieces_of([])] == [0, 0, 0]


def test_ids_are_the_librarys_when_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES_KEPT", 20)
    monkeypatch.setitem(tokens._pieces, BYTE, tokens.Pieces(tokens._tokenizer(BYTE).model))
    for i in range(12):
        units = [*UNITS[i:], *(f" w{n * i},x" for n in range(i))]
        ids, start, size = tokens.coded(BYTE, units)
        assert [ids[a : a + n].tolist() for a, n in zip(start, size)] == [np.array(x).tolist() for x in tokens.encode_units(BYTE, units)]
