"""Corrections: applying findings to texts, once or to a fixpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from narae.functions.catalogue import Config
from narae.operators.detect import lint
from narae.session import materialise, small_batches, tidy

MOST_PASSES = 32
#: Characters of a document after which its findings may be dealt to another task.
SEGMENT = 1 << 16


def standing(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings whose ``original`` still stands at their range in the texts."""
    texts = docs.select("doc_id", F.col("text").alias("_text"))
    there = F.substring(F.col("_text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return findings.join(texts, "doc_id").where(there == F.col("original")).drop("_text")


def in_segments(findings: DataFrame) -> DataFrame:
    """``findings`` with ``_segment``: parts of a document between which no finding spans the border.

    Borders stand at multiples of SEGMENT characters. A border within a finding is none; the segments on its both
    sides are one, named by the first. Such borders are few: only findings that have one inside are looked at.
    """
    own = F.floor(F.col("start") / SEGMENT)
    spanned = findings.where((F.col("end") - 1) >= (own + 1) * SEGMENT).select("doc_id", F.explode(F.sequence(own + 1, F.floor((F.col("end") - 1) / SEGMENT))).alias("_own")).distinct()
    # Of neighbouring borders that are none, all belong to the segment before the first.
    run = F.col("_own") - F.row_number().over(W.partitionBy("doc_id").orderBy("_own"))
    merged = spanned.withColumn("_run", run).withColumn("_into", F.min("_own").over(W.partitionBy("doc_id", "_run")) - 1).select("doc_id", "_own", "_into")
    placed = findings.withColumn("_own", own).join(merged, ["doc_id", "_own"], "left")
    return placed.withColumn("_segment", F.coalesce("_into", "_own")).drop("_own", "_into")


def selected(findings: DataFrame, review: bool = False, ties: str = "rule_id") -> DataFrame:
    """The findings that a pass applies: in order, each that does not overlap the last one taken.

    Only safe ones unless ``review``; findings left out do not stand in the way of others. Equal ranges go by
    ``ties``: a column, or "safe" for safe ones first, then by rule. Spark sorts the findings of each segment of a
    document (and spills); they stream through with one end carried along, so time and memory don't hang on how
    many there are, and a long document is shared by several tasks.
    """
    rows = findings if review else findings.where("safe")
    tie = F.when(F.col("safe"), F.concat(F.lit("0"), F.col("rule_id"))).otherwise(F.concat(F.lit("1"), F.col("rule_id"))) if ties == "safe" else F.col(ties)
    columns = ["doc_id", "start", "end", "turn", "original", "suggestion", "rule_id"]
    dealt = in_segments(rows.select(*columns, tie.cast("string").alias("_tie"))).repartition("doc_id", "_segment")
    ordered = dealt.sortWithinPartitions("doc_id", "_segment", "start", "end", "_tie", "turn", "original", "suggestion", "rule_id")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = segment = None
        stop = 0
        for batch in batches:
            keep = []
            for doc, part, start, end in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_segment", "start", "end"))):
                if doc != ident or part != segment:
                    ident, segment, stop = doc, part, 0
                keep.append(start >= stop)
                stop = end if start >= stop else stop
            yield batch.filter(pa.array(keep, pa.bool_())).select(columns)

    return ordered.mapInArrow(tidy(kept), ordered.select(*columns).schema)


def accepted(findings: DataFrame, review: bool = False, ties: str = "rule_id") -> DataFrame:
    """(doc_id, edits): the selected findings of each document, in order."""
    edit = F.struct("start", "end", "turn", "original", "suggestion", "rule_id")
    return selected(findings, review, ties).groupBy("doc_id").agg(F.array_sort(F.collect_list(edit)).alias("edits"))


@F.pandas_udf(StringType())
def _edited(text: pd.Series, starts: pd.Series, ends: pd.Series, originals: pd.Series, suggestions: pd.Series) -> pd.Series:
    """Texts after edits that do not overlap, in order; an edit whose original no longer stands there is left out."""

    def one(text, starts, ends, originals, suggestions) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, b, old, new in zip(starts, ends, originals, suggestions):
            if new is not None and text[a:b] == old:
                out += (text[at:a], new)
                at = b
        return "".join([*out, text[at:]])

    return pd.Series([one(*row) for row in zip(text, starts, ends, originals, suggestions)], dtype=object)


def applied(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with ``fixed``: the text with the edits made, each only where its original stands. Documents without
    edits keep theirs, which then doesn't leave the JVM."""
    small_batches(docs.sparkSession)
    joined = docs.join(edits.withColumnRenamed("edits", "_edits"), "doc_id", "left")
    some = F.col("_edits").isNotNull()
    part = lambda name: F.col(f"_edits.{name}")
    made = _edited(F.when(some, F.col("text")), part("start"), part("end"), part("original"), part("suggestion"))
    return joined.withColumn("fixed", F.when(some, made).otherwise(F.col("text"))).select(*docs.columns, "fixed")


def fix_once(docs: DataFrame, findings: DataFrame, review: bool = False) -> DataFrame:
    return applied(docs, accepted(findings, review))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fix(docs: DataFrame, config: Config = Config(), review: bool = False, rules=None) -> DataFrame:
    """``docs`` with ``fixed``: corrected until nothing changes.

    Only documents that the last pass changed are linted again. A text that comes back to an earlier
    state, or still changes after 32 passes, keeps its original. ``rules``: packs beside the bundled rules.
    """
    columns = docs.columns
    current = docs.withColumn("_original", F.col("text")).withColumn("_seen", F.array(F.sha2("text", 256)))
    done = []
    for turn in range(MOST_PASSES):
        step = materialise(fix_once(current, lint(current, config, rules), review), "fixed")
        hashed = F.sha2("fixed", 256)
        same = F.col("fixed").eqNullSafe(F.col("text"))
        back = ~same & F.array_contains("_seen", hashed)
        done.append(step.where(same | back).withColumn("fixed", F.when(back, F.col("_original")).otherwise(F.col("fixed"))))
        current = step.where(~same & ~back).withColumn("text", F.col("fixed")).withColumn("_seen", F.concat("_seen", F.array(hashed))).drop("fixed")
        if not current.limit(1).count():
            break
    else:
        done.append(current.withColumn("fixed", F.col("_original")))
    return _union(done).withColumn("text", F.col("_original")).select(*columns, "fixed")


def lint_with_fixes(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """``docs`` with findings of the first pass, ``fixed_text`` and ``review_fixed_text``."""
    findings = lint(docs, config)
    lists = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rule_id", "turn", "original", "suggestion", "severity", "safe"))).alias("diagnostics"))
    safe = fix(docs, config).select("doc_id", F.col("fixed").alias("fixed_text"))
    review = fix(docs, config, review=True).select("doc_id", F.col("fixed").alias("review_fixed_text"))
    return docs.join(lists, "doc_id", "left").join(safe, "doc_id").join(review, "doc_id")


def preview(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One pass of all suggestions; equal ranges go by the replacement."""
    return applied(docs, accepted(findings, True, ties="suggestion"))
