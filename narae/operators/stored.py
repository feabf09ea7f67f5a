"""Stored results: a lint reads findings of texts that an earlier one has seen, and lints the others only.

A store is a folder. Each commit adds a Parquet table of (key, findings), a row a distinct text, and then a
version file, which lists the tables that count. A version file is written once: of two writers that end at
the same time, the second finds the number taken, waits for that version and adds its table to the next one. A reader keeps
to the version it began with; a writer that dies leaves a table that no version lists. One that takes longer than PATIENCE
to write its version counts as dead: what it found is right, but later runs may have to lint its texts again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narae.functions.catalogue import RULES, Config
from narae.operators.detect import COLUMNS, lint
from narae.session import discard, materialise
from narae.sources.files import cache_key

_PLACE = [c for c in COLUMNS if c != "doc_id"]
#: Changes with what a lint finds, beside rules and configuration.
CODE = "1"
#: Seconds that a writer waits for one that took a number.
PATIENCE = 10.0


def fingerprint(config: Config) -> str:
    """Digest of all that findings hang on beside the text: configuration and rules."""
    own = [CODE, config.profile, sorted(config.disabled), sorted(config.dictionary), sorted(config.overlay.items()), [repr(RULES[r]) for r in sorted(RULES)]]
    return hashlib.sha256(json.dumps(own).encode()).hexdigest()


@dataclass(frozen=True)
class Version:
    number: int
    tables: tuple[tuple[str, str], ...]  # (fingerprint, name of the folder)

    def of(self, mark: str) -> list[str]:
        return [name for own, name in self.tables if own == mark]


class Store:
    """The versions of a folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, suffix: str) -> list[str]:
        if not self.files.exists(self._path("")):
            return []
        return [n for n in (e.getPath().getName() for e in self.files.listStatus(self._path(""))) if n.endswith(suffix) and n[0] not in "._"]

    def current(self) -> Version:
        numbers = [int(n.split(".")[0]) for n in self._names(".version")]
        if not numbers:
            return Version(0, ())
        stream = self.files.open(self._path(f"{max(numbers):012d}.version"))
        try:
            data = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return Version(max(numbers), tuple((a, b) for a, b in json.loads(data)))

    def _put(self, version: Version) -> bool:
        """Writes a version; False if its number is taken. It is whole before it has its name."""
        beside = self._path(f".{uuid.uuid4().hex}.version")
        stream = self.files.create(beside)
        stream.write(bytearray(json.dumps(version.tables).encode()))
        stream.close()
        target = self._path(f"{version.number:012d}.version")
        lock = self._path(f"{version.number:012d}.taken")
        if self.files.exists(target) or not self.files.createNewFile(lock):
            self.files.delete(beside, False)
            return False
        return bool(self.files.rename(beside, target))

    def change(self, tables) -> Version:
        """Makes ``tables(current tables)`` the next version, again for a newer one if another writer was first."""
        number = 0
        while True:
            now = self.current()
            number = max(number, now.number) + 1
            wanted = Version(number, tuple(tables(now.tables)))
            if self._put(wanted):
                return wanted
            end = time.monotonic() + PATIENCE
            while not self.files.exists(self._path(f"{number:012d}.version")) and time.monotonic() < end:
                time.sleep(0.1)

    def read(self, version: Version, mark: str) -> DataFrame | None:
        """(key, findings), a row a key: of tables that hold the same key, any one's row."""
        names = version.of(mark)
        if not names:
            return None
        rows = self.spark.read.parquet(*[self._path(n).toString() for n in names])
        return rows if len(names) == 1 else rows.dropDuplicates(["key"])

    def add(self, rows: DataFrame, mark: str) -> Version:
        name = f"{uuid.uuid4().hex}.table"
        rows.write.option("compression", "zstd").parquet(self._path(name).toString())
        return self.change(lambda tables: [*tables, (mark, name)])

    def keep(self, mark: str) -> list[str]:
        """Merges a configuration's tables to one and drops all others, then deletes what the version before still
        listed. Readers of an older version must have ended. Returns the deleted tables."""
        before = self.current()
        rows = self.read(before, mark)
        merged = before.of(mark)
        if len(merged) > 1:
            name = f"{uuid.uuid4().hex}.table"
            rows.write.option("compression", "zstd").parquet(self._path(name).toString())
        elif merged:
            name = merged[0]
        gone = {n for _, n in before.tables} - ({name} if merged else set())
        self.change(lambda tables: [*([(mark, name)] if merged else []), *(t for t in tables if t[1] not in gone and (not merged or t[1] != name))])
        for n in sorted(gone):
            self.files.delete(self._path(n), True)
        return sorted(gone)


def _key(docs: DataFrame, mark: str) -> Column:
    kind = F.col("source_kind") if "source_kind" in docs.columns else F.lit("plain_text")
    return cache_key(F.concat(F.coalesce(kind, F.lit("plain_text")), F.lit("\n"), F.col("text")), mark)


def lint_stored(docs: DataFrame, folder: str, config: Config = Config()) -> DataFrame:
    """The findings of ``lint``, of which those of texts that the store knows are read and the others added to it.

    A text that several documents share is linted once. Null texts have no findings. Keys and ids are
    shuffled; a text only if it is new.
    """
    store, mark = Store(docs.sparkSession, folder), fingerprint(config)
    keep = ["doc_id", "text", *(["source_kind"] if "source_kind" in docs.columns else [])]
    keyed = docs.where("text is not null").select(*keep, _key(docs, mark).alias("key"))
    version = store.current()
    known = store.read(version, mark)
    new = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
    new = materialise(new.dropDuplicates(["key"]), "new-texts")
    if new.limit(1).count():
        found = lint(new.drop("key"), config).groupBy("doc_id").agg(F.collect_list(F.struct(*_PLACE)).alias("findings"))
        version = store.add(new.select("doc_id", "key").join(found, "doc_id", "left").select("key", "findings"), mark)
    discard(new)
    rows = store.read(version, mark)
    if rows is None:
        return lint(docs.limit(0), config)
    return keyed.select("doc_id", "key").join(rows, "key").select("doc_id", F.inline("findings"))
