"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source documents are ordered by that key; as keys
are uniform, the ranges of the sort are fixed prefixes of the key, and no sampling pass is needed. A
prefix sum over (source, range) totals plus a running sum inside each range gives every document's
position in its source, and the source is cut at its exact budget. Budgets beyond one epoch repeat
the source whole, then cut the last epoch.

Only DataFrame operations. Texts are scanned once: what is shuffled are (id, source, size, key) rows.
A hot source spreads over all ranges; no group is larger than one range of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narae.llm.shared import materialise, word_count

#: Weights by source rank, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its size.
MOST_EPOCHS = 3
#: Hex digits of the key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3
SEED = "mix"


def hash_key(identity: Column, seed: str = SEED) -> Column:
    """Hash-random key of a row, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(identity.cast("string"), F.lit("null"))))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size) rows.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A
    target stops at ``most`` times its source's size and the excess goes to the others by weight:
    with sources by rising (cap / weight) the first that stays below its cap sets the level for all
    that follow. Sources without words get 0. One row a source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("place", F.row_number().over(by_level))
        .withColumn("total", F.sum("source_size").over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("below", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    )
    free = (F.col("total") - F.col("below")) * F.col("weight") <= F.col("cap") * F.col("left_weight")
    level = F.min(F.when(free, F.struct("place", "below", "left_weight"))).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("level", level)
    share = ((F.col("total") - F.col("level.below")) * F.col("weight")).cast("double") / F.col("level.left_weight")
    target = F.when(F.col("place") < F.col("level.place"), F.col("cap").cast("double")).otherwise(share)
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    range_digits: int = RANGE_DIGITS,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of each row of ``docs``.

    ``taken`` are the words that the mix takes, repeats counted: whole epochs, then the words up to
    the exact cut, so that a source gives ``floor(target)`` words. Null texts have size 0 and take
    nothing; a null source is a source; repeated rows are mixed one by one, and equal keys are told
    apart by id and size, so which of two equal rows the cut meets makes no difference. Other
    columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    key = hash_key(F.col("doc_id"), seed)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = sized.withColumn("range", F.substring("key", 1, range_digits))
    # A key without nulls, so that all joins and exchanges see the null source as any other.
    sized = materialise(sized.withColumn("place", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix-sizes")
    ranges = sized.groupBy("place", "range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))
    upto = W.partitionBy("place").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select("place", "range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("offset"))
    totals = ranges.groupBy("place").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, most)
    targets = targets.withColumn("place", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")

    inside = W.partitionBy("place", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = sized.withColumn("inside", before).join(offsets, ["place", "range"]).join(targets, "place")
    budget = F.floor("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / size).cast("long")
    epochs = F.when(epochs * size > budget, epochs - 1).otherwise(epochs)  # the quotient is a double
    left = budget - epochs * size
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("offset") - F.col("inside")))
    return rows.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + last).alias("taken"), "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as taken whole, then cut.

    A document that is taken k times and a part has k rows with its whole text and one row with the
    first words of it, up to the cut. Documents of which nothing is taken are absent, and so are
    those without words. ``n_chars`` follows the text. Rows with the same id, size and source share what
    the mix takes of them, in order of their texts; rows may repeat.
    """
    def identity(size: str) -> Column:
        return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(size), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    taken = mix_sources(docs, **options).groupBy(identity("size").alias("_key")).agg(F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    rows = docs.withColumn("_words", word_count(F.col("text"))).withColumn("_key", identity("_words"))
    rows = rows.join(taken.where("_taken > 0"), "_key")
    # Repeated rows share what the mix takes of their id: each has the even part, the first ones one more.
    turn = F.row_number().over(W.partitionBy("_key").orderBy("text"))
    even = F.floor(F.col("_taken") / F.col("_rows")).cast("long")
    rows = rows.withColumn("_own", even + F.when(turn <= F.col("_taken") - even * F.col("_rows"), 1).otherwise(0))
    whole, part = F.floor(F.col("_own") / F.col("_words")).cast("int"), (F.col("_own") % F.col("_words")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_cut", F.explode(copies))
    cut = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.greatest(F.col("_cut"), F.lit(1)))
    text = F.when(F.col("_cut") < 0, F.col("text")).otherwise(F.concat(cut, F.array_join(words, "")))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
