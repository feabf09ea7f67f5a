"""Groups of similar records: one row a record, whatever the size of its group.

Equal texts are one class from the start, so copies meet nothing; classes are linked by similarity, and linked
classes joined into groups by stars: each round ties what a node is tied to to the least of these, larger and smaller nodes
in turn, until nothing changes. Rounds are written to the shared folder, and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narae.functions.hangul import normalised
from narae.operators.curate import LEAK_GRAM, LEAK_SIMILARITY, similar_pairs
from narae.session import materialise

MOST_ROUNDS = 64
#: Links up to which one task settles them all; more are joined round by round.
FEW_LINKS = 100_000


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least) of some links (a, b): sets joined at their least members."""
    above: dict = {}

    def least(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((least(a), least(b)))
            above[high] = low
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([least(x) for x in above], kind)], names=["node", "least"])


def connected(links: DataFrame) -> DataFrame:
    """(node, least): the least node that each node of the links (a, b) is connected with."""
    both = lambda rows: rows.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(rows.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def starred(rows: DataFrame, larger: bool) -> DataFrame:
        """Each node's neighbours (larger ones, or the others and itself) tied to the least neighbour of the node."""
        near = both(rows) if larger else rows.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = near.join(least, "u")
        tied = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if larger else tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return tied.where("a != b").distinct()

    now = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    if now.count() <= FEW_LINKS:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_settled, f"node {kind}, least {kind}")
    digest = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    for _ in range(MOST_ROUNDS):
        after = now.agg(digest).first()[0]
        if after == before:
            break
        before = after
        now = materialise(starred(materialise(starred(now, True), "links"), False), "links")
    else:
        raise RuntimeError("links are still changing")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("least"))
    return stars.unionByName(stars.select(F.col("least").alias("node"), "least").distinct())


def similar_groups(records: DataFrame, n: int = LEAK_GRAM, least: float = LEAK_SIMILARITY, across_splits: bool = True, text: Column | None = None) -> DataFrame:
    """(id, split, group_id, links, members, splits) of records (id, split, text).

    Records link if their n-gram sets are similar (and, with ``across_splits``, their splits differ). links: how many
    records each is linked with; group_id: the least id that it is connected with, its own if with none; members and
    splits: how many records its group has, and from which splits. Records of empty texts link with nothing.
    """
    shown = records.select("id", "split", (text if text is not None else normalised(F.col("text"))).alias("_text"))
    shown = shown.withColumn("class", F.when(F.col("_text") != "", F.sha2("_text", 256)))
    # One record stands for all of its text, which is stored with it alone; how many of each split a class has is kept as rows.
    classes = shown.where("class is not null").groupBy("class").agg(F.min("id").alias("id"), F.first("_text").alias("text"), F.min("split").alias("low"), F.max("split").alias("high"))
    classes = materialise(classes, "classes")
    records = materialise(shown.select("id", "split", "class"), "records")
    pairs = similar_pairs(classes.select("id", F.lit(0).alias("split"), "text"), n, least, across_splits=False, text=F.col("text"))
    names = classes.select("id", "class", "low", "high")
    side = lambda k: names.select(*[F.col(c).alias(f"{k}_{c}") for c in names.columns])
    pairs = pairs.select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id")
    if across_splits:  # classes of one and the same split have no link
        pairs = pairs.where("left_low != left_high or right_low != right_high or left_low != right_low")
    pairs = materialise(pairs.select(F.col("left_class").alias("a"), F.col("right_class").alias("b")), "pairs")
    counts = materialise(records.where("class is not null").groupBy("class", "split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), "counts")
    # Links of a record: all records of its class and of those that its class is linked with, without its own (split).
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(classes.select(F.col("class").alias("a"), F.col("class").alias("b")))
    met = ways.join(counts.select(F.col("class").alias("b"), "split", "n"), "b")
    total = met.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("total"))
    same = met.groupBy(F.col("a").alias("class"), "split").agg(F.sum("n").alias("own"))
    linked = counts.join(total, "class").join(same, ["class", "split"])
    linked = linked.withColumn("links", F.col("total") - (F.col("own") if across_splits else 1))
    group = connected(pairs)
    kept = linked.join(group.select(F.col("node").alias("class"), "least"), "class", "left").withColumn("least", F.coalesce("least", "class"))
    kept = materialise(kept.where("links > 0").select("class", "split", "n", "first", "links", "least"), "linked")
    groups = kept.groupBy("least").agg(F.min("first").alias("group_id"), F.sum("n").alias("members"), F.array_sort(F.collect_set("split")).alias("splits"))
    rows = kept.join(groups, "least").select("class", "split", "group_id", "links", "members", "splits")
    placed = records.join(rows, ["class", "split"], "left")
    return placed.select("id", "split", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("splits", F.array("split")).alias("splits"))
