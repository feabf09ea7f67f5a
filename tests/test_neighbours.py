"""The deletion index against all pairs: short words, long ones, hot forms, and reading in blocks."""

import math
import random

import pytest

from narae.operators import neighbours
from narae.operators.candidates import PER_WORD, near_words


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def apart(a, b):
    if all("가" <= c <= "힣" for c in (a, b)):
        x, y = ord(a) - 0xAC00, ord(b) - 0xAC00
        return (x // 588 != y // 588) + (x // 28 % 21 != y // 28 % 21) + (x % 28 != y % 28)
    return int(a != b)


def all_pairs(words, lexicon):
    out = {}
    for w in words:
        if len(w) < 2 or w in lexicon:
            continue
        near = []
        for e, f in lexicon.items():
            if abs(len(w) - len(e)) <= 1 and (d := edits(w, e)) <= 2:
                sounds = sum(map(apart, w, e))
                near.append((-(1 / (1 + d) + 0.35 / (1 + sounds) + min(math.log(f + 1), 16.0) / 64), e, d, sounds))
        if near:
            out[w] = [(e, d, s) for _, e, d, s in sorted((round(n[0], 12), *n[1:]) for n in near)[:PER_WORD]]
    return out


@pytest.mark.parametrize("block", [48, 1024])
def test_near_words_equal_all_pairs(spark, monkeypatch, block):
    """Words of 1 to 6 characters of few and of many syllables, words with one ending, and long ones; ties by frequency."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = random.Random(block)
    pick = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    make = lambda: rng.choice([lambda: pick("가각나다라", 1, 6), lambda: pick("값읽닭뷁a1é", 2, 3), lambda: pick("가나다", 1, 3) + "하다", lambda: pick("가나다라마바", 10, 14)])()
    lexicon = {make(): rng.choice([1, 2, 5, 1000, 10**8]) for _ in range(400)}
    base = pick("가나다라마바", 13, 13)
    lexicon |= {base: 3, base[:5] + "하" + base[5:]: 4}
    words = {make() for _ in range(250)} | {base[:3] + base[4:], base[:12] + "거", base + "가"}
    table = spark.createDataFrame([(w, "n", f) for w, f in lexicon.items()], "surface string, pos string, freq long")
    rows = near_words(spark.createDataFrame([(w,) for w in words], "surface string"), table).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (-round(r.score, 12), r.replacement)):
        found.setdefault(r.word, []).append((r.replacement, r.edits, r.sounds))
    assert found == all_pairs(words, lexicon)


def test_no_key_is_shared_by_all(spark):
    """Forms of one character are kept for words of two only, with one edit; a stored index serves several word tables."""
    entries = [f"{a}{b}" for a in "가나다라마" for b in "바사아자차"] + ["카"]
    index = neighbours.deletion_index(spark.createDataFrame([(w, 1) for w in entries], "surface string, freq long"))
    assert index.groupBy("key").count().agg({"count": "max"}).first()[0] == 25  # by length
    for w in ("가하", "하"):
        near = neighbours.nearest(spark.createDataFrame([(w,)], "word string"), index, 5).collect()
        assert all(r.word == w and r.edits in (1, 2) for r in near)
    assert neighbours.nearest(spark.createDataFrame([], "word string"), index, 5).count() == 0
