"""Column functions over Hangul syllables, characters and offsets. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first syllable and the counts of a syllable's parts.
FIRST, LAST, MEDIALS, FINALS = 0xAC00, 0xD7A3, 21, 28
#: Numbers of the finals that rules ask for.
NIEUN, RIEUL, BIEUP = 4, 8, 17


def is_syllable(c: Column) -> Column:
    return F.ascii(c).between(FIRST, LAST)


def final(c: Column) -> Column:
    """Number of a syllable's final, 0 for none; null for other characters."""
    return F.when(is_syllable(c), (F.ascii(c) - FIRST) % FINALS)


def parts(c: Column) -> Column:
    """(initial, medial, final) numbers of a syllable; null for other characters."""
    n = F.ascii(c) - FIRST
    return F.when(
        is_syllable(c),
        F.struct(F.floor(n / (MEDIALS * FINALS)).cast("int").alias("initial"), (F.floor(n / FINALS) % MEDIALS).cast("int").alias("medial"), (n % FINALS).cast("int").alias("final")),
    )


def character(code: Column) -> Column:
    """The character of a code point from U+0800 to U+FFFF, by its three bytes."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    code = code.cast("int")
    head = F.shiftright(code, 12).bitwiseOR(0xE0)
    middle = F.shiftright(code, 6).bitwiseAND(0x3F).bitwiseOR(0x80)
    return F.decode(F.concat(byte(head), byte(middle), byte(code.bitwiseAND(0x3F).bitwiseOR(0x80))), "UTF-8")


def compose(initial: Column, medial: Column, last: Column) -> Column:
    return character(F.lit(FIRST) + (initial * MEDIALS + medial) * FINALS + last)


def with_final(c: Column, number: int) -> Column:
    """The syllable with another final."""
    return character(F.ascii(c) - (F.ascii(c) - FIRST) % FINALS + number)


def distance(a: Column, b: Column) -> Column:
    """In how many of three parts two syllables differ; of other characters 0 or 1."""
    x, y = parts(a), parts(b)
    apart = sum(((x[k] != y[k]).cast("int") for k in ("initial", "medial", "final")), F.lit(0))
    return F.when(is_syllable(a) & is_syllable(b), apart).otherwise((a != b).cast("int"))


def word_distance(a: Column, b: Column) -> Column:
    """Sum of distances of the characters that stand at the same place."""
    n = F.least(F.char_length(a), F.char_length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda s, k: s + distance(F.substring(a, k, F.lit(1)), F.substring(b, k, F.lit(1))))


def collapsed(text: Column) -> Column:
    """Trimmed, runs of Unicode white space as one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    """collapsed() and lower case. Compatibility forms are left to normal_form()."""
    return F.lower(collapsed(text))


def grams(text: Column, n: int) -> Column:
    """The set of character n-grams; a shorter text is its own only one."""
    size = F.char_length(text)
    # The letters are bound as a variable: within the inner function they would be split off anew for each place.
    several = F.get(F.transform(F.array(F.split(text, "")), lambda x: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(x, i, n), ""))), F.lit(0))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(F.array_distinct(several))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def line_of(text: Column, start: Column) -> Column:
    """1-based line of a code point offset."""
    before = F.substring(text, F.lit(1), start)
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """1-based code point column of a code point offset."""
    return F.char_length(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)) + 1


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def byte_offset(text: Column, start: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), start))


def changed_span(before: Column, after: Column) -> Column:
    """(start, end, before, after) of what is left without the common begin and end, in code points."""
    n, m = F.char_length(before), F.char_length(after)
    letters = F.array(F.struct(F.split(before, "").alias("a"), F.split(after, "").alias("b")))
    places = lambda limit: F.when(limit > 0, F.sequence(F.lit(1), limit)).otherwise(F.array().cast("array<int>"))

    def equal(limit: Column, same) -> Column:
        """How many places from the first on are the same."""
        count = lambda x: F.aggregate(places(limit), F.lit(0), lambda s, k: F.when((s == k - 1) & same(x, k), k).otherwise(s))
        return F.get(F.transform(letters, count), F.lit(0))

    head = equal(F.least(n, m), lambda x, k: F.get(x["a"], k - 1) == F.get(x["b"], k - 1))
    tail = equal(F.least(n, m) - head, lambda x, k: F.get(x["a"], n - k) == F.get(x["b"], m - k))
    cut = lambda text, size: F.substring(text, head + 1, size - head - tail)
    return F.struct(head.alias("start"), (n - tail).alias("end"), cut(before, n).alias("before"), cut(after, m).alias("after"))
