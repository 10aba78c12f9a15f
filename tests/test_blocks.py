"""Matching blocks of many pairs at once against difflib, pair by pair."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from slateflow.functions import blocks, text


def pairs(r, alphabet, n=6):
    draw = lambda: "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 5, 30, 150, 199, 200, 420])))
    wanted = [draw() for _ in range(n)]
    said = [*(draw() for _ in range(n)), wanted[0], wanted[1] + "x" + wanted[2], wanted[3][5:] + "zz" + wanted[4][:40] + wanted[5]]
    return said, wanted, np.repeat(np.arange(len(said)), n), np.tile(np.arange(n), len(said))


def counted(a, b):
    return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


@pytest.mark.parametrize("entries", [blocks.ENTRIES, 300])
def test_blocks_are_those_of_difflib(monkeypatch, entries):
    """Frequent characters (of texts of 200 and more) extend blocks and begin none; few entries at once change nothing, and no pair goes through difflib."""
    r = random.Random(1)
    monkeypatch.setattr(blocks, "ENTRIES", entries)
    monkeypatch.setattr(blocks, "SequenceMatcher", None)
    for alphabet in ["ab", "abc", "abcdefgh", "etaoinshrdlu ", "가나ab\U0001d11e"] * 3:
        said, wanted, at, to = pairs(r, alphabet)
        assert blocks.matched(said, wanted, at, to).tolist() == [counted(said[a], wanted[b]) for a, b in zip(at, to)]


def test_large_pairs_and_ratios(monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(blocks, "CELLS", 1000)
    said, wanted, at, to = pairs(r, "abcdef ")
    a, b = pd.Series([said[i] for i in at]), pd.Series([wanted[i] for i in to])
    assert text._ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert text._ratios(a[:0], b[:0]).tolist() == []


@pytest.mark.parametrize("grams", [blocks.GRAMS, (2, 1)])
def test_runs_behind_unknown_and_frequent_characters(monkeypatch, grams):
    """A run begins where a character that no wanted text has stands before it, and in the wanted text one too frequent to begin a block."""
    r = random.Random(5)
    monkeypatch.setattr(blocks, "GRAMS", grams)
    letters = [chr(0x4E00 + k) for k in range(110)]
    wanted = ["".join(r.choice(["e", r.choice(letters)]) for _ in range(230)) for _ in range(6)]
    said = ["".join(r.choice(["X", "e", r.choice(letters), r.choice(letters)]) for _ in range(120)) for _ in range(6)]
    at, to = np.repeat(np.arange(6), 6), np.tile(np.arange(6), 6)
    assert blocks.matched(said, wanted, at, to).tolist() == [counted(said[a], wanted[b]) for a, b in zip(at, to)]


@pytest.mark.parametrize("table", [blocks.TABLE, 0])
def test_pairs_in_any_order(monkeypatch, table):
    """All pairs of texts, some of them, and pairs that come twice, with tables of grams or one pair at a time."""
    r = random.Random(3)
    monkeypatch.setattr(blocks, "TABLE", table)
    said, wanted, at, to = pairs(r, "abcdefgh ")
    for some in (r.sample(range(len(at)), len(at)), r.sample(range(len(at)), 4), [3, 9, 3, 9, 3], range(1, len(at))):
        a, b = at[list(some)], to[list(some)]
        assert blocks.matched(said, wanted, a, b).tolist() == [counted(said[x], wanted[y]) for x, y in zip(a, b)]


def test_grams_are_looked_up_once_for_all_texts(monkeypatch):
    """Where every text meets every other one, no pair's texts are read through for that pair alone."""
    said, wanted, at, to = pairs(random.Random(4), "abcdefgh ")
    monkeypatch.setattr(blocks, "_met", None)
    assert blocks.matched(said, wanted, at, to).tolist() == [counted(said[a], wanted[b]) for a, b in zip(at, to)]
