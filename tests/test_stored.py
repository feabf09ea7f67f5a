"""Stored results: only new texts are linted, versions are whole, writers don't overwrite each other."""

from narae.functions.catalogue import Config
from narae.operators import stored
from narae.operators.detect import COLUMNS, lint

TEXTS = ["몇일 동안 메세지를 기다렸다", "되서 좋다 ,그리고", "plain words", "몇일 동안 메세지를 기다렸다", None, ""]


def _rows(found):
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def test_only_new_texts_are_linted(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    seen = []

    def counted(rows, config):
        seen.append(rows.count())
        return lint(rows, config)

    monkeypatch.setattr(stored, "lint", counted)
    config, folder = Config("strict"), str(tmp_path / "store")
    first = docs.where("doc_id < 2")
    assert _rows(stored.lint_stored(first, folder, config)) == _rows(lint(first, config)) != []
    assert _rows(stored.lint_stored(docs, folder, config)) == _rows(lint(docs, config))
    assert _rows(stored.lint_stored(docs, folder, config)) == _rows(lint(docs, config))
    assert seen == [2, 2]  # the second time only "plain words" and the empty text are new
    other = Config("strict", frozenset({"spelling.lexical.myeochil"}))
    assert stored.fingerprint(other) != stored.fingerprint(config)


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "store")
    a, b = stored.Store(spark, folder), stored.Store(spark, folder)
    rows = lambda *keys: spark.createDataFrame([(k, []) for k in keys], "key string, findings array<struct<start:int>>")
    start = a.add(rows("x"), "m")
    a.add(rows("x", "y"), "m")
    b.add(rows("z"), "old")
    assert {r.key for r in a.read(start, "m").collect()} == {"x"}  # a reader's version stays as it was
    assert sorted(r.key for r in a.read(b.current(), "m").collect()) == ["x", "y"]

    # Another writer is first: the change is made anew on what it left.
    put, calls = a._put, []

    def late(version):
        if not calls:
            calls.append(b.add(rows("w"), "m"))
        return put(version)

    a._put = late
    a.add(rows("v"), "m")
    a._put = put
    assert sorted(r.key for r in a.read(a.current(), "m").collect()) == ["v", "w", "x", "y"]
    gone = a.keep("m")
    assert len(gone) == 5 and len(a.current().tables) == 1 and a.read(a.current(), "old") is None
    assert sorted(r.key for r in a.read(a.current(), "m").collect()) == ["v", "w", "x", "y"]
    assert b.add(rows("u"), "m").number == a.current().number


def test_a_number_that_a_dead_writer_took(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "PATIENCE", 0.3)
    store = stored.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("x", [])], "key string, findings array<struct<start:int>>")
    store.add(rows, "m")
    store.files.createNewFile(store._path(f"{2:012d}.taken"))
    assert store.add(rows, "m").number == 3 and len(store.current().tables) == 2
