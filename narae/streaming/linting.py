"""Streaming surfaces: files that arrive, and documents that are edited."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from narae.functions.catalogue import Config
from narae.operators.detect import lint
from narae.sources.files import source_kind

EDITS = "uri string, version long, start_line int, start_character int, end_line int, end_character int, text string"


def watch(spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame, int], None], config: Config = Config(), checkpoint: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Lints document tables (Parquet) that arrive in a folder; ``sink`` gets the findings of each batch.

    Without an interval everything there is processed and the query ends.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(lambda batch, number: sink(lint(batch, config), number))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], config: Config = Config(), checkpoint: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Lints supported text files that arrive below a folder or are written anew; ``sink`` gets the findings
    with their paths. Files that are not UTF-8 are left out."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        texts = rows.where(F.expr("is_valid_utf8(cast(content as string))")).withColumn("source_kind", source_kind(F.col("path"))).where("source_kind is not null")
        docs = texts.select(F.xxhash64("path").alias("doc_id"), "path", F.decode("content", "UTF-8").alias("text"), "source_kind")
        sink(lint(docs, config).join(docs.select("doc_id", "path"), "doc_id"), number)

    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def watch_configurations(spark: SparkSession, folder: str, docs: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Lints all documents again whenever configurations (JSON files) arrive in a folder: by the latest of them."""
    from narae.api import config_of

    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.json").load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        latest = rows.orderBy(F.desc("modificationTime"), F.desc("path")).select("content").first()
        if latest:
            sink(lint(docs(), config_of(json.loads(bytes(latest.content).decode()))), number)

    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def offset_of(text: str, line: int, character: int) -> int:
    """Code point offset of a 0-based line and UTF-16 position; beyond the end of a line, its end."""
    lines = text.splitlines(keepends=True) or [""]
    if line >= len(lines):
        return len(text)
    row = lines[line].rstrip("\r\n")
    at = units = 0
    while at < len(row) and units < character:
        units += 2 if ord(row[at]) > 0xFFFF else 1
        at += 1
    return sum(map(len, lines[:line])) + at


def edited(text: str, changes: pd.DataFrame) -> str:
    """A text after changes in order; a change without a range replaces all."""
    for c in changes.sort_values("version", kind="stable").itertuples():
        if pd.isna(c.start_line):
            text = c.text
        else:
            a, b = offset_of(text, int(c.start_line), int(c.start_character)), offset_of(text, int(c.end_line), int(c.end_character))
            if a > b:
                raise ValueError("an edit ends before it starts")
            text = text[:a] + c.text + text[b:]
    return text


def byte_edit(text: str, start: int, end: int, new: str) -> str:
    """A text after an edit by UTF-8 bytes; ranges must lie within it, at character borders."""
    data = text.encode()
    if not 0 <= start <= end <= len(data):
        raise ValueError("an edit goes beyond the text")
    try:
        data[:start].decode(), data[start:end].decode()
    except UnicodeDecodeError:
        raise ValueError("an edit cuts a character") from None
    return (data[:start] + new.encode() + data[end:]).decode()


def documents(edits: DataFrame) -> DataFrame:
    """(uri, version, text): the state of each document after each batch of its edits, kept by uri."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text = state.get[0] if state.exists else ""
        version = 0
        for frame in frames:
            text = edited(text, frame)
            version = int(frame["version"].max())
        state.update((text,))
        yield pd.DataFrame([(key[0], version, text)], columns=["uri", "version", "text"])

    return edits.groupBy("uri").applyInPandasWithState(update, "uri string, version long, text string", "text string", "update", "NoTimeout")
