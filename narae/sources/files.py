"""Files in, reports out: directory scans, corpora, manifests, reports, SARIF and the result cache."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narae.functions.hangul import column_of, line_of

# Directories never scanned, and the kinds of file name extensions.
SKIPPED = (".git", ".next", ".turbo", ".worktrees", "coverage", "dist", "node_modules", "target")
#: Files of patterns that leave out what lies below their folder.
IGNORE_FILES = (".gitignore", ".ignore", ".naraeignore")
EXTENSIONS = {
    "md": "markdown", "markdown": "markdown", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "mts": "typescript", "cts": "typescript", "py": "python", "rs": "rust", "txt": "plain_text", "text": "plain_text",
}

CASE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("genre", T.StringType()), T.StructField("sourceKind", T.StringType()), T.StructField("profile", T.StringType()),
    T.StructField("caseType", T.StringType()), T.StructField("provenanceId", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("documentId", T.StringType()), T.StructField("authorId", T.StringType()), T.StructField("errorFamilies", T.ArrayType(T.StringType())), T.StructField("expectedRuleIds", T.ArrayType(T.StringType())),
    T.StructField("expectedDiagnostics", T.ArrayType(T.StructType([
        T.StructField("ruleId", T.StringType()), T.StructField("original", T.StringType()), T.StructField("range", T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), T.StructField("suggestions", T.ArrayType(T.StringType())),
    ]))), T.StructField("expectedFixedText", T.StringType()),
])


def source_kind(path: Column) -> Column:
    """Kind by extension; null for files that are not linted."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, kind in EXTENSIONS.items():
        out = F.when(extension == name, kind).otherwise(out)
    return out


def _expression(name: str) -> re.Pattern:
    """An ignore pattern as an expression over a path relative to its folder, and any part of it below."""
    anchored = "/" in name.rstrip("/")[:-1] or name.startswith("/")
    out = ""
    for piece in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]*\]|\\.|.", name.strip("/"), re.DOTALL):
        special = {"**/": "(?:.*/)?", "/**": "/.+", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece)
        if special is None:
            special = ("[^" + piece[2:] if piece.startswith("[!") else piece) if piece[0] == "[" and len(piece) > 2 else re.escape(piece[-1])
        out += special
    return re.compile(("" if anchored else "(?:.*/)?") + out)


def ignored(path: str, patterns: list[str], folder: bool = False) -> bool:
    """Whether ignore patterns leave out a path relative to their folder; the last that fits decides.

    What lies below a folder that is left out is left out as well. A pattern with a slash at its end fits folders.
    """
    parts = path.split("/")
    if any(p in SKIPPED for p in (parts if folder else parts[:-1])):
        return True
    for depth in range(1, len(parts) + 1):
        out = False
        for line in patterns:
            line = line.rstrip("\r\n")
            line = line if line.endswith("\\ ") else line.rstrip(" ")
            keep, name = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            if line and line[0] != "#" and (depth < len(parts) or folder or not name.endswith("/")) and _expression(name).fullmatch("/".join(parts[:depth])):
                out = not keep
        if out:
            return True
    return False


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The supported files below a folder in order: hidden ones too, links not followed, and without what the
    ignore files of their folders leave out. Folders that are left out are not entered."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(conf)
    if not store.exists(root):
        raise FileNotFoundError(folder)
    out: list[str] = []

    def text_of(path) -> str:
        stream = store.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
        finally:
            stream.close()

    def walk(place, name: str, rules: list[tuple[str, list[str]]]) -> None:
        entries = sorted(((e.getPath().getName(), e) for e in store.listStatus(place)), key=lambda e: e[0])
        own = [line for n, e in entries if n in IGNORE_FILES and e.isFile() for line in text_of(e.getPath()).splitlines()]
        rules = [*rules, (name, own)] if own else rules
        for n, e in entries:
            path = f"{name}/{n}" if name else n
            folder = e.isDirectory()
            if e.isSymlink() or (not folder and n.rpartition(".")[2].lower() not in EXTENSIONS) or (folder and n in SKIPPED):
                continue
            verdict = False  # ignore files of inner folders come last
            for at, patterns in rules:
                below = path[len(at) + 1 :] if at else path
                if ignored(below, patterns, folder):
                    verdict = True
                elif any(ignored(below, [line.removeprefix("!")], folder) for line in patterns if line.startswith("!")):
                    verdict = False
            if verdict:
                continue
            if folder:
                walk(e.getPath(), path, rules)
            else:
                out.append(e.getPath().toString())

    walk(root, "", [])
    return out


def scan(spark: SparkSession, folder: str, patterns: list[str] | None = None) -> DataFrame:
    """(doc_id, path, text, source_kind) of the supported files below a folder, without ignored ones
    and without those that are not UTF-8. ``patterns`` come beside those of ignore files."""
    at = folder.rstrip("/") + "/"
    paths = [p for p in listed(spark, folder) if not ignored(p.split(at, 1)[-1], patterns or [])]
    return texts_of(spark, paths)


def texts_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, path, text, source_kind) of those of the files that are UTF-8."""
    return _documents(_contents(spark, paths).where(F.expr("is_valid_utf8(cast(content as string))")))


def named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same of files that were named: one that is missing or not UTF-8 raises, any other kind is plain text."""
    rows = _contents(spark, sorted(set(paths)))
    bad = rows.where(~F.expr("is_valid_utf8(cast(content as string))")).select("path").first()
    if bad:
        raise ValueError(f"{bad.path} is not UTF-8")
    return _documents(rows)


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _documents(rows: DataFrame) -> DataFrame:
    kind = F.coalesce(source_kind(F.col("path")), F.lit("plain_text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", F.decode("content", "UTF-8").alias("text"), kind.alias("source_kind"))


def write_atomic(path: str, data: bytes) -> None:
    """Replaces a file at once: written beside it, made durable, given its permissions, then renamed."""
    descriptor, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".narae-")
    try:
        with os.fdopen(descriptor, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            shutil.copymode(path, beside)
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def write_back(rows: DataFrame) -> int:
    """Writes ``fixed`` to the ``path`` of each row where it differs from ``text``, and counts those files.

    Paths must be on a file system that all executors mount. A task that runs again writes the same bytes.
    """
    changed = rows.where(~F.col("fixed").eqNullSafe(F.col("text"))).select("path", "fixed")

    def write(batches):
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                write_atomic(unquote(path.removeprefix("file://").removeprefix("file:")), text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return changed.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def changed_files(worktree: DataFrame, index: DataFrame, untracked: DataFrame) -> DataFrame:
    """Distinct supported paths of three lists of (path)."""
    return worktree.union(index).union(untracked).distinct().where(source_kind(F.col("path")).isNotNull())


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus cases of JSON lines; blank lines are skipped, malformed ones raise ValueError with file and line."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", T.StructType([*CASE, T.StructField("_broken", T.StringType())]), options))
    if parsed.where("r._broken is not null").limit(1).count():
        # Lines are numbered only to say where: by their places in the file.
        numbered = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
        broken = numbered.where(F.trim("value") != "").withColumn("r", F.from_json("value", T.StructType([*CASE, T.StructField("_broken", T.StringType())]), options))
        first = broken.where("r._broken is not null").orderBy("file", "n").select("file", "n").first()
        raise ValueError(f"{first.file}:{first.n + 1}: not a corpus case")
    return parsed.select(*[F.col(f"r.{f.name}") for f in CASE])


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The content of a file, after its digest was compared with a manifest's."""
    content = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
    if content.where(F.col("sha256") != sha256).limit(1).count():
        raise ValueError(f"{path} is not what its manifest describes")
    return content


def with_lines(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings with 1-based line and column (code points)."""
    joined = findings.join(docs.select("doc_id", "text"), "doc_id")
    start = F.col("start").cast("int")
    return joined.withColumn("line", line_of(F.col("text"), start)).withColumn("column", column_of(F.col("text"), start)).drop("text")


def report_lines(findings: DataFrame) -> DataFrame:
    """Human-readable lines of (path, line, column, severity, rule_id, message, suggestion)."""
    arrow = F.when(F.col("suggestion").isNotNull(), F.concat(F.lit(" → "), F.col("suggestion"))).otherwise("")
    return findings.select(F.concat(F.format_string("%s:%s:%s: %s [%s] %s", "path", F.col("line").cast("string"), F.col("column").cast("string"), "severity", "rule_id", "message"), arrow).alias("value"))


def artifact_uri(path: Column) -> Column:
    """A path percent-encoded, its slashes kept; absolute ones (also of drives and shares) as file addresses."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    encoded = plain
    for a, b in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(F.url_encode(plain) if encoded is plain else encoded, F.lit(a), F.lit(b))
    drive = plain.rlike("^[A-Za-z]:/")
    return (
        F.when(drive, F.concat(F.lit("file:///"), F.replace(encoded, F.lit("%3A"), F.lit(":"))))
        .when(plain.startswith("//"), F.concat(F.lit("file:"), encoded)).when(plain.startswith("/"), F.concat(F.lit("file://"), encoded)).otherwise(encoded)
    )


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "info", "note").otherwise(severity)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, line, column, rule_id, value): each finding as a SARIF result."""
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(artifact_uri(F.col("path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("path", "line", "column", "rule_id", F.to_json(result).alias("value"))


def sarif(findings: DataFrame, rules: list | None = None) -> Iterator[str]:
    """One SARIF 2.1.0 log of findings (path, line, column, severity, rule_id, message), in lines.

    Results come partition by partition, so the driver holds one at a time, whatever their number.
    """
    driver = {"name": "narae", "rules": [{"id": r.id, "name": r.title, "shortDescription": {"text": r.message}} for r in rules or []]}
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "columnKind": "unicodeCodePoints", "results": []}]}, ensure_ascii=False)
    yield head.removesuffix("]}]}")
    before = ""
    for row in sarif_results(findings).orderBy("path", "line", "column", "rule_id", "value").toLocalIterator():
        yield before + row.value
        before = ","
    yield "]}]}"


def line_diff(before: Column, after: Column) -> Column:
    """Lines that differ, number by number (no alignment)."""
    pairs = F.arrays_zip(F.split(before, "\n").alias("before"), F.split(after, "\n").alias("after"))
    numbered = F.transform(pairs, lambda p, k: F.struct((k + 1).alias("line"), p["before"].alias("before"), p["after"].alias("after")))
    return F.filter(numbered, lambda p: ~p["before"].eqNullSafe(p["after"]))


FEEDBACK = ("ruleId", "original", "suggestion", "accepted", "comment", "version")


def feedback(lines: DataFrame) -> DataFrame:
    """Feedback records of JSON lines (value): broken ones and those without ruleId dropped, six keys kept."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in FEEDBACK])
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("ruleId is not null")


def cache_key(text: Column, fingerprint: str) -> Column:
    """Digest of a text under a configuration; another configuration or rule table gives other keys."""
    return F.sha2(F.concat(F.lit(fingerprint), F.lit("\n"), text), 256)


def cache_split(docs: DataFrame, cache: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): documents whose findings a cache (path, key, ...) has, and the others."""
    keyed = docs.withColumn("key", cache_key(F.col("text"), fingerprint))
    return keyed.join(cache, ["path", "key"]), keyed.join(cache, ["path", "key"], "left_anti")


def fails(findings: DataFrame, level: str = "warning") -> bool:
    """Whether any finding is at least that severe."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return findings.where(rank >= {"error": 2, "warning": 1, "info": 0}[level]).limit(1).count() > 0
