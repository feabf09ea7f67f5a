"""Pairs of similar texts: grams numbered without loss, tiles and the grid of blocks against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from narae.operators import curate, similar


def _sets(texts, n):
    return [{t[k : k + n] for k in range(len(t) - n + 1)} if len(t) >= n else {t} for t in texts]


def _brute(texts, n, least):
    sets = _sets(texts, n)
    score = lambda a, b: len(a & b) / len(a | b)
    return {(i, j, score(sets[i], sets[j])) for j in range(len(sets)) for i in range(j) if score(sets[i], sets[j]) >= least}


def _texts(letters, seed=3):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 4, 10, 30, 60]))) for _ in range(90)]
    return texts + [t[:-1] + "z" for t in texts[:40]] + texts[:5]


def test_tiles_equal_brute_force(monkeypatch):
    for common, at_once, cells in ((4096, 1 << 22, 1 << 24), (64, 50, 1 << 24), (64, 50, 4)):
        for name, value in (("COMMON", common), ("AT_ONCE", at_once), ("MOST_CELLS", cells)):
            monkeypatch.setattr(similar, name, value)
        for letters, n, least in (("abc", 3, 0.5), ("ab한글\U0001f600", 5, 0.5), ("abcdefgh", 5, 0.85)):
            texts = _texts(letters)
            before = np.arange(len(texts))[:, None] < np.arange(len(texts))[None]
            found = similar.Cell(texts, n, least).tile(0, len(texts), 0, len(texts), before)
            wanted = _brute(texts, n, least)
            assert set(zip(*(x.tolist() for x in found))) == wanted and wanted


def test_pairs_of_many_blocks_equal_brute_force_and_grams_stay_in_their_task(spark, monkeypatch):
    monkeypatch.setattr(similar, "MOST_TEXTS", 30)
    monkeypatch.setattr(similar, "ROWS", 16)
    monkeypatch.setattr(similar, "COLUMNS", 16)
    texts = _texts("abc")
    rows = spark.createDataFrame([(k, k % 3, t) for k, t in enumerate(texts)] + [(None, 0, "abc"), (-1, 1, None), (-2, 2, "")], "id long, split int, text string")
    for across in (False, True):
        found = curate.similar_pairs(rows, 3, 0.5, across, F.col("text"))
        wanted = {p for p in _brute(texts, 3, 0.5) if not across or p[0] % 3 != p[1] % 3}
        out = found.collect()
        assert {(r.left_id, r.right_id, r.score) for r in out} == wanted and len(out) == len(wanted)
        assert all((r.left_split, r.right_split) == (r.left_id % 3, r.right_id % 3) for r in out)
        # Candidates met by joins on grams before: as many rows as all pairs that share a gram.
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_bounded():
    assert similar.blocks_of(10, 1000, 8) == 1
    assert similar.blocks_of(40_000, 20_000_000, 8) == 7
    assert similar.blocks_of(400_000, 200_000_000, 8) == 40


def test_rounds_copy_the_texts_a_bounded_number_of_times():
    for blocks, cores in ((1, 4), (9, 6), (21, 6), (42, 12), (420, 12)):
        rounds = similar.rounds_of(blocks, cores)
        assert [k for a, b in rounds for k in range(a, b)] == list(range(blocks * (blocks + 1) // 2))
        assert all(b - a <= max(blocks, similar.CELLS_OF_A_CORE * cores) for a, b in rounds)
    # All cells at once copied each text once for each block before.
    assert max(2 * (b - a) / 420 for a, b in similar.rounds_of(420, 12)) <= 2


def test_pairs_met_in_several_rounds_equal_brute_force(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(similar, "MOST_TEXTS", 20)
    monkeypatch.setattr(similar, "CELLS_OF_A_CORE", 0, raising=False)
    monkeypatch.setattr(similar, "materialise", lambda df, name, *a, f=similar.materialise: stored.append((name, df.columns)) or f(df, name, *a))
    texts = _texts("abc")
    rows = spark.createDataFrame([(f"r{k:03}", None if k == 7 else k % 3, t) for k, t in enumerate(texts)], "id string, split int, text string")
    for across in (False, True):
        out = curate.similar_pairs(rows, 3, 0.5, across, F.col("text")).collect()
        wanted = {p for p in _brute(texts, 3, 0.5) if not across or p[0] % 3 != p[1] % 3 and 7 not in p[:2]}
        assert {(int(r.left_id[1:]), int(r.right_id[1:]), r.score) for r in out} == wanted and len(out) == len(wanted)
    # Seven blocks are 28 cells, in four rounds; texts are packed.
    assert [name for name, _ in stored] == (["texts"] + ["met"] * 4) * 2
    assert stored[0][1] == ["own", "pack"]


def test_cells_read_blocks_where_they_are_stored(spark, monkeypatch):
    plans, owns = [], []
    monkeypatch.setattr(similar, "MOST_TEXTS", 20)

    def stored(df, name, *a, f=similar.materialise):
        if name == "met":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = f(df, name, *a)
        if name == "texts":
            owns.extend(r.own for r in out.select("own").collect())
        return out

    monkeypatch.setattr(similar, "materialise", stored)
    files = spark.conf.get("spark.sql.files.minPartitionNum", None)
    rows = spark.createDataFrame([(k, k % 3, t) for k, t in enumerate(_texts("abc"))], "id int, split int, text string").repartition(5)
    one = curate.similar_pairs(rows, 3, 0.5, True, F.col("text"))
    plans.append(one._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(similar, "CELLS_OF_A_CORE", 0)
    several = curate.similar_pairs(rows, 3, 0.5, True, F.col("text"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, several.collect()))
    # Each round shuffled a copy of both blocks of a cell before, and a block was as many rows as its texts came from tasks.
    assert len(plans) == 5 and not any("Exchange" in p for p in plans)
    assert sorted(owns) == sorted([*range(7)] * 2)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) == files
    assert curate.similar_pairs(rows.where("id < 0"), 3, 0.5, True, F.col("text")).collect() == []


def test_packs_give_back_their_rows(monkeypatch):
    rows = [(k % 4, k, None if k % 5 == 0 else f"s{k % 2}", "text " * (k % 7)) for k in range(60)]
    names = ["own", "id", "split", "text"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + 25]], pa.schema([("own", pa.int32()), ("id", pa.int64()), ("split", pa.string()), ("text", pa.string())])) for k in range(0, 60, 25)]
    for most in (1, 1 << 20):
        monkeypatch.setattr(similar, "PACKED", most)
        packs = list(similar._packed(iter(batches)))
        assert len(packs) == (3 if most == 1 else 1) and all(len(set(p["own"].to_pylist())) == p.num_rows for p in packs)
        back = similar._unpacked(iter(p.rename_columns(["side", "pack"]) for p in packs))
        assert sorted(back.select(["side", *names[1:]]).to_pylist(), key=lambda r: r["id"]) == [dict(zip(["side", *names[1:]], r)) for r in rows]
    assert similar._unpacked(iter([])) is None


def _of_blocks(parts, n, least, across=False):
    names = pa.schema([("side", pa.int32()), ("id", pa.int64()), ("split", pa.int32()), ("text", pa.string())])
    packs, at = [], 0
    for texts in parts:
        rows = pa.table([[0] * len(texts), [*range(at, at + len(texts))], [k % 3 for k in range(at, at + len(texts))], texts], schema=names)
        packs.append(similar._block(rows, n))
        at += len(texts)
    return pa.RecordBatch.from_arrays([pa.array([0]), pa.array([len(parts) - 1]), pa.array(packs[:1], pa.binary()), pa.array(packs[-1:], pa.binary())], names=["low", "high", "first", "second"])


def test_cells_read_numbered_grams_and_look_at_no_text(monkeypatch):
    texts = _texts("ab한글\U0001f600") + _texts("abcdef", 5)
    half = len(texts) // 2
    for parts in ([texts], [texts[:half], texts[half:]], [texts[:half], ["q" * 40, "xyz"]]):
        for n in (1, 3, 5):
            every = sum(parts, [])
            wanted = {p for p in _brute(every, n, 0.5) if len(parts) == 1 or p[0] < len(parts[0]) <= p[1]}
            batch = _of_blocks(parts, n, 0.5)
            with monkeypatch.context() as here:
                # Each cell numbered the grams of all its texts anew before, so that this work grew with the square of the texts.
                here.setattr(similar, "gram_sets", None)
                here.setattr(similar, "_grams", None)
                found = [tuple(r.values()) for out in similar._met(n, 0.5, False)(iter([batch])) for r in out.select(["left_id", "right_id", "score"]).to_pylist()]
            assert set(found) == wanted and len(found) == len(wanted)


def test_bounds_leave_out_no_similar_pair(monkeypatch):
    texts = _texts("abcdef") + _texts("uvwxyz", 7)
    before = np.arange(len(texts))[:, None] < np.arange(len(texts))[None]
    wanted = {least: _brute(texts, 3, least) for least in (0.3, 0.5, 0.9)}
    # From columns that tell nothing to one for each gram; pairs looked at one by one, or never.
    for wide, most, at_a_time, alone in ((0.1, 1 << 15, 4096, 0), (0.5, 1 << 15, 7, 50_000), (1.4, 64, 4096, 1e9), (1.4, 1 << 15, 50, 1e9), (3, 1 << 15, 4096, 1)):
        for name, value in (("WIDE", wide), ("MOST_WIDE", most), ("AT_A_TIME", at_a_time), ("ONE_BY_ONE", alone)):
            monkeypatch.setattr(similar, name, value)
        for least, pairs in wanted.items():
            found = similar.Cell(texts, 3, least).tile(0, len(texts), 0, len(texts), before)
            assert set(zip(*(x.tolist() for x in found))) == pairs and pairs


def test_unlike_texts_are_settled_by_one_product():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(300)) for _ in range(60)] + ["".join(rng.choice("tuvwxyz") for _ in range(300)) for _ in range(60)]
    cell = similar.Cell(texts, 5, 0.5)
    counted = []
    cell._counted = lambda gram, row, rows, columns, width, kind: counted.append((rows, width)) or similar.Cell._counted(cell, gram, row, rows, columns, width, kind)
    x, y, _ = cell.near(0, 60, 60, 120)
    assert not len(x) and not counted  # no gram in common
    x, y, _ = cell.near(0, 60, 0, 60)
    assert set(zip(x.tolist(), y.tolist())) == {(k, k) for k in range(60)}
    assert len(counted) == 1 and counted[0][1] < 2 * 300
    kinds = similar._kinds(texts)
    assert len(set(kinds[:60].tolist()) & set(kinds[60:].tolist())) == 0


def test_tiles_of_many_similar_pairs_are_counted_by_columns_and_lists(monkeypatch):
    for name, value in (("ONE_BY_ONE", 1e9), ("A_HIT", 0), ("STRIP", 8)):
        monkeypatch.setattr(similar, name, value)
    texts = _texts("abc") + _texts("abcdef", 9)
    before = np.arange(len(texts))[:, None] < np.arange(len(texts))[None]
    wanted = _brute(texts, 3, 0.5)
    for often, at_once, at_a_time in ((0.3, 50, 4096), (0.02, 1 << 22, 5), (1, 1 << 22, 4096)):
        for name, value in (("OFTEN", often), ("AT_ONCE", at_once), ("AT_A_TIME", at_a_time)):
            monkeypatch.setattr(similar, name, value)
        cell = similar.Cell(texts, 3, 0.5)
        exact = []
        cell._exactly = lambda gram, row, rows, columns, kind, cell=cell, exact=exact: exact.append(columns.listed()[1] < columns.grams) or similar.Cell._exactly(cell, gram, row, rows, columns, kind)
        found = cell.tile(0, len(texts), 0, len(texts), before)
        assert set(zip(*(x.tolist() for x in found))) == wanted and exact == [True]
