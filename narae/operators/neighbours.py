"""Nearest lexicon entries of words: a stored index of deletion forms, read in blocks by frequency.

Two words within two edits whose lengths differ by one at most have a form in common: what is left of either
without two characters at most. The index lists for each form the entries that have it. Two edits can leave words of two or
three characters without a common form of two characters; these meet short entries by length instead. Long words would have
too many forms: entries from twelve characters on are listed by three segments, of which two edits leave one as it is.

The postings of a key are numbered in blocks, the most frequent entries first. All words read the first block of their
keys; a word reads on only where an entry of the next block could still be among its best, which its
frequency bounds. So a form that a third of all entries share costs each word a block or two, not the product of the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narae.functions.hangul import word_distance
from narae.session import materialise

MOST_EDITS = 2
#: Entries from this length on are listed by segments; up to this one they are also listed by length.
BY_SEGMENTS, SHORT = 12, 3
#: Entries of a block.
BLOCK = 1024


def gain(freq: Column) -> Column:
    """What frequency adds to a score."""
    return F.least(F.log(freq + 1), F.lit(16.0)) / 64


def score(edits: Column, sounds: Column, freq: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + edits) + 0.35 / (1 + sounds) + gain(freq)))


#: What an entry that only such a key lists can score beside its frequency. By one deletion on both sides it differs in a
#: character, and by two edits in a character of those at equal places as well. Keys: deletions of the word, of the entry.
_BOUNDS = {(0, 1): 1 / 2 + 0.35, (1, 0): 1 / 2 + 0.35, (1, 1): 1 / 2 + 0.35 / 2, (1, 2): 1 / 3 + 0.35 / 2, (2, 1): 1 / 3 + 0.35 / 2, (2, 2): 1 / 3 + 0.35 / 2}
_BY_LENGTH, _BY_SEGMENT = 1 / 3 + 0.35 / 2, 1 / 2 + 0.35


def _without_one(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.lit(2**30)))))


def with_forms(rows: DataFrame, word: str) -> DataFrame:
    """``rows`` with _n, the length of a word, and _0, _1 and _2: its distinct forms without so many characters (none of long words)."""
    few = (F.col("_n") > 0) & (F.col("_n") <= BY_SEGMENTS)
    one = rows.withColumn("_n", F.char_length(word)).withColumn("_0", F.when(few, F.array(word))).withColumn("_1", F.when(few, _without_one(F.col(word))))
    return one.withColumn("_2", F.array_distinct(F.flatten(F.transform("_1", _without_one))))


def _segment(size: Column, k: Column) -> tuple[Column, Column]:
    """Begin and size of a segment of an entry."""
    at = lambda j: F.floor(size * j / (MOST_EDITS + 1)).cast("int")
    return at(k), at(k + 1) - at(k)


def _segment_key(chars: Column, size: Column, k: Column) -> Column:
    return F.xxhash64(F.lit("segment"), chars, size, k)


def _length_key(size: Column) -> Column:
    return F.xxhash64(F.lit("length"), size)


def _form_key(size: Column, cut: int) -> Callable[[Column], Column]:
    """The key of a form of entries of a length without so many characters. (A function of one argument: Spark counts them.)"""
    return lambda form: F.xxhash64(form, size, F.lit(cut))


def _bounded(bound: float) -> Callable[[Column], Column]:
    return lambda key: F.struct(key.alias("key"), F.lit(bound).alias("bound"))


def deletion_index(lexicon: DataFrame) -> DataFrame:
    """(key, replacement, freq, block) of a lexicon (surface, freq, ...), written once.

    Blocks are numbered per key by frequency; an entry of n characters has some n * n / 2 keys.
    """
    n = F.col("_n")
    # Without two characters, two are left at least; without one, one (for words of two).
    listed = [F.when((n < BY_SEGMENTS) & (n >= b + max(b, 1)), F.transform(f"_{b}", _form_key(n, b))) for b in range(MOST_EDITS + 1)]
    listed.append(F.when(n <= SHORT, F.array(_length_key(n))))

    def cut(k: Column) -> Column:
        begin, wide = _segment(n, k)
        return _segment_key(F.substring("surface", begin + 1, wide), n, k)

    listed.append(F.when(n >= BY_SEGMENTS, F.transform(F.sequence(F.lit(0), F.lit(MOST_EDITS)), cut)))
    rows = with_forms(lexicon.select("surface", "freq"), "surface").where("_n > 0")
    keys = F.array_distinct(F.flatten(F.array_compact(F.array(*listed))))
    rows = rows.select(F.col("surface").alias("replacement"), "freq", F.explode(keys).alias("key"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("freq"), "replacement"))
    return materialise(rows.withColumn("block", F.floor((place - 1) / BLOCK).cast("int")), "deletions")


def word_keys(words: DataFrame) -> DataFrame:
    """(word, key, bound): the keys under which a word's neighbours can be listed, and what those score beside their frequency."""
    m = F.col("_n")
    asked = []
    for (a, b), bound in _BOUNDS.items():
        n = m - a + b
        asked.append(F.when((n < BY_SEGMENTS) & (m >= a + max(a, b)), F.transform(F.transform(f"_{a}", _form_key(n, b)), _bounded(bound))))
    lengths = F.filter(F.sequence(m - 1, m + 1), lambda n: n <= SHORT)
    asked.append(F.when(m <= SHORT, F.transform(F.transform(lengths, _length_key), _bounded(_BY_LENGTH))))

    def cut(at: Column) -> Column:
        """One of 45: by length of the entry, segment, and how far it is off in the word."""
        k, n, off = F.floor(at / 3).cast("int") % 3, m + at % 3 - 1, F.floor(at / 9).cast("int") - MOST_EDITS
        begin, wide = _segment(n, k)
        inside = (n >= BY_SEGMENTS) & (begin + off >= 0) & (begin + off + wide <= m)
        return F.when(inside, _segment_key(F.substring("word", begin + off + 1, wide), n, k))

    cuts = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(44)), cut))
    asked.append(F.when(m >= BY_SEGMENTS - 1, F.transform(cuts, _bounded(_BY_SEGMENT))))
    keys = F.flatten(F.array_compact(F.array(*asked)))
    return with_forms(words.select("word"), "word").select("word", F.inline(keys)).groupBy("word", "key").agg(F.max("bound").alias("bound"))


def nearest(words: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """(word, replacement, edits, sounds, freq, score): the ``most`` best entries of each of the distinct words."""
    keys = materialise(word_keys(words), "word-keys")
    tops = index.where("block > 0").groupBy("key", "block").agg(F.max(gain(F.col("freq"))).alias("top"))
    best = W.partitionBy("word").orderBy(F.desc("score"), "replacement")
    found, asked, block = None, keys, 0
    while True:
        met = asked.join(index.where(F.col("block") == block), "key").select("word", "replacement", "freq").distinct()
        close = (F.char_length("word") - F.char_length("replacement")).between(-1, 1)
        met = met.where(close).withColumn("edits", F.levenshtein("word", "replacement", MOST_EDITS)).where("edits >= 0")
        met = met.withColumn("sounds", word_distance(F.col("word"), F.col("replacement")))
        met = met.withColumn("score", score(F.col("edits"), F.col("sounds"), F.col("freq")))
        met = met if found is None else found.drop("place").unionByName(met).dropDuplicates(["word", "replacement"])
        found = materialise(met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most), "nearest")
        block += 1
        # Who could still find better: words with fewer than ``most``, or whose last one is no better than the next block may be.
        last = found.where(F.col("place") == most).select("word", F.col("score").alias("last"))
        more = asked.join(tops.where(F.col("block") == block), "key").join(last, "word", "left")
        asked = materialise(more.where(F.col("last").isNull() | (F.col("last") <= F.col("bound") + F.col("top"))).select("word", "key", "bound"), "word-keys")
        if not asked.limit(1).count():
            return found.drop("place")
