"""The pipeline stage by stage against plain Python, and its guard."""

import os
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from narae.llm.quality import quality_scores
from test_operators import brute_components, brute_leaks

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns, held = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append(docs.collect())
        assert name == "token_ids" or docs.columns == columns
    start, kept, single, clean, mixed, ids = held
    good = {r.doc_id for r in quality_scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).where("predicted = 1").collect()}
    assert sorted(map(tuple, kept)) == sorted(tuple(r) for r in start if r.doc_id in good)
    near = brute_components([(r.doc_id, r.text, r.source) for r in kept], 5, 80, 100)
    assert sorted(r.doc_id for r in single) == sorted(i for i, (_, least) in near.items() if i == least)
    cleaned = {r.doc_id: r.text for r in clean}
    for r in single:
        n, hit, _, _, _ = brute_leaks(r.text, items, 10)
        assert (r.doc_id in cleaned) == (hit <= 0.5 * n)
        if r.doc_id in cleaned:
            assert (cleaned[r.doc_id] == r.text) == (hit == 0)
            assert len(brute_leaks(cleaned[r.doc_id], [], 10)) and brute_leaks(cleaned[r.doc_id], items, 10)[0] == n - hit
    for r in mixed:
        assert cleaned[r.doc_id].startswith(r.text)
    assert len(ids) == len(mixed) and sum(r.n_tokens for r in ids) == max(r.start + r.n_tokens for r in ids)


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_the_library_works_without_these_operators(tmp_path):
    """Without both folders and the pipeline: the entry imports, and tests of the library pass."""
    import shutil
    import subprocess

    root = os.path.dirname(corpus_pipeline.__file__)
    for name in ("__spark_entry__.py", "narae", "tests"):
        target = tmp_path / name
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", target)
    shutil.rmtree(tmp_path / "narae" / "llm")
    shutil.rmtree(tmp_path / "tests" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lint_counts' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    settings = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=settings)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_rules.py", "tests/test_sources.py"], cwd=tmp_path, check=True, env=settings, timeout=600)


def test_a_broken_operator_is_not_taken_for_an_absent_one(tmp_path):
    import shutil
    import subprocess

    root = os.path.dirname(corpus_pipeline.__file__)
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "narae"):
        target = tmp_path / name
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", target)
    (tmp_path / "narae" / "llm" / "queries.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_module" in done.stderr
