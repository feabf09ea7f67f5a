"""Toxicity, conversation repair and the Merkle manifest against brute force, and in odd cases."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narae.llm import conversations, merkle, toxicity
from test_operators import docs, odd_rows

FOLDER = "/root/testdata/sf0.01"


# --- op 11 -----------------------------------------------------------------------------------


def brute_kernel(a, b):
    total = 0.0
    places = lambda s: list(itertools.combinations(range(len(s)), toxicity.ORDER))
    for p in places(a):
        for q in places(b):
            if [a[i] for i in p] == [b[j] for j in q]:
                total += float(toxicity.DECAY) ** (p[-1] - p[0] + 1 + q[-1] - q[0] + 1)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=4, max_size=8), min_size=1, max_size=4), st.lists(st.text("abcd", min_size=4, max_size=7), min_size=1, max_size=3))
def test_kernel_equals_all_subsequences(asked, pieces):
    found = toxicity.Landmarks(pieces).likeness(asked)
    for k, a in enumerate(asked):
        for j, b in enumerate(pieces):
            alike = brute_kernel(a, b) / (brute_kernel(a, a) * brute_kernel(b, b)) ** 0.5
            assert abs(found[k, j] - alike**2) < 1e-3


def test_pieces():
    assert toxicity.spelled("a i d i o t. is x y".split()) == [(0, "aidiot")]
    assert toxicity.plain("i.d-i_o*t!!") == "idiot"
    long = "".join(chr(97 + k % 26) for k in range(100))
    assert toxicity.windows(long)[0] == long[:32] and set(long) <= set("".join(toxicity.windows(long))) and long.endswith(toxicity.windows(long)[-1][-1])
    assert toxicity.borders(np.array([False, True, False] + [False] * 60)).tolist() == [0, 2, 26, 50]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")
def test_toxic_documents_are_told(spark):
    """English labels of training and held-out rows, and insults with gaps and inserted characters, in clean texts of any length."""
    table, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = toxicity.toxicity_scores(table, labels).join(labels, "doc_id").join(table.select("doc_id", "lang"), "doc_id").where("lang = 'en'").collect()
    right = Counter((r.toxic, r.predicted) for r in scored)
    assert right[1, 1] >= 0.8 * (right[1, 0] + right[1, 1]) and right[0, 1] <= 0.01 * right[0, 0]
    machine = toxicity.fit(table, labels)
    clean = "Onesnt theaeati onanshat the and thing ereon the.\nAnother thst erth. "
    for words in ("idiot clown scum", "i.d.i.o.t c-l-o-w-n s*c*u*m", "i d i o t and c l o w n and s c u m", "iddiot clowwn scumm"):
        for more in (0, 300):
            assert machine.scores([clean * more + f"The {words} ereon. " + clean * more])[0] > 0.5, words
    assert max(machine.scores([clean, clean * 300, "", "x" * 100_000])) < 0.5


def test_toxicity_of_odd_rows(spark):
    rows = odd_rows()
    frame = docs(spark, rows)
    marked = frame.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    out = toxicity.toxicity_scores(frame, marked.unionByName(marked)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    for value, score in ((1, 1.0), (0, 0.0), (None, 0.5)):
        alone = toxicity.toxicity_scores(frame, frame.select("doc_id", F.lit(value).cast("int").alias("toxic"))).collect()
        assert {r.score for r in alone} == {score}
    assert toxicity.toxicity_scores(docs(spark, []), marked.limit(0)).count() == 0


# --- op 12 -----------------------------------------------------------------------------------


def plain_repair(turns):
    """All audits as they are: the best of each state, turn by turn."""
    inserts = lambda s: [(s, "", [])] + [(conversations._inserted(s, k)[0], "I" * k, list(conversations._inserted(s, k)[1])) for k in (1, 2)]
    best = {0: (0, "", [])}
    for role, text, must, cut in turns:
        found = {}
        for state, (cost, audit, out) in best.items():
            for at, code, more in inserts(state):
                lines = out + [(conversations.ROLES[r], "") for r in more]
                options = [(at, 2, "D", [])]
                if not must:
                    options += [(conversations.NEXT[at, r], 5 * cut + (0 if letter == "K" else 1), letter, [(role if letter == "K" else conversations.ROLES[r], text)]) for letter, r in [("K", role[:1]), ("R", "u"), ("R", "a")] if (at, r) in conversations.NEXT]
                for end, more_cost, letter, line in options:
                    new = (cost + 5 * len(code) + more_cost, audit + code + letter, lines + line)
                    if end not in found or new[:2] < found[end][:2]:
                        found[end] = new
        best = found
    ends = [(cost + 5 * len(code), audit + code, out + [(conversations.ROLES[r], "") for r in more]) for state, (cost, audit, out) in best.items() for at, code, more in inserts(state) if at in (0, 3)]
    return min(ends, key=lambda e: e[:2])


ROLE = st.sampled_from(["user", "user", "assistant", "assistant", "system", "tool", " ", "User"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, st.sampled_from(["x", "y."]), st.booleans(), st.booleans()), max_size=12))
def test_repair_equals_plain_audits(turns):
    repair, edits = conversations.Repair(), []
    for turn in turns:
        edits += repair.push(*turn)
    cost, rest = repair.finish()
    edits += rest
    assert (cost, "".join(e[0] for e in edits), [e[1:] for e in edits if e[0] != "D"]) == plain_repair(turns)


def test_long_conversations_settle():
    rng = random.Random(3)
    turns = [(rng.choice(["user", "assistant", "assistant", "system", "tool"]), str(k), rng.random() < 0.2, rng.random() < 0.1) for k in range(3000)]
    repair, edits, most = conversations.Repair(), [], 0
    for turn in turns:
        edits += repair.push(*turn)
        most = max(most, len(repair.turns))
    cost, rest = repair.finish()
    edits += rest
    assert most < 200
    assert (cost, "".join(e[0] for e in edits), [e[1:] for e in edits if e[0] != "D"]) == plain_repair(turns)


def test_odd_conversations(spark):
    form = "conv_id long, turn long, role string, text string, dropped boolean, fault int, _mark int"
    rows = [(1, 0, "user", "a.", False, 0, 0), (1, 0, "user", "a.", False, 0, 0), (1, 5, "assistant", None, False, 0, 0), (None, None, None, "b.", False, 0, 0), (2, None, "system", "x" * 100_000 + "!", False, 0, 0), (2, 7, "assistant", "", False, 0, 0), (3, 1, "user", "y", True, 0, 0)]
    rows += [(9, k, ["user", "assistant"][k % 2], f"t{k}.", False, 0, 0) for k in range(10_000)]
    frame = spark.createDataFrame(rows, form)
    out = {r.conv_id: r for r in conversations.repair_digest(frame).collect()}
    assert set(out) == {1, 2, 3, 9, None}
    # The repeated turn goes; so does the one without text (a null is a blank), and the answer is inserted.
    assert (out[1].gaps, out[1].blank, out[1].duplicate, out[1].illegal, out[1].audit, out[1].cost) == (4, 1, 1, 1, "DDD", 6)
    assert out[2].audit == "DD" and out[None].audit == "D" and out[None].gaps == 0
    assert (out[3].audit, out[3].cost, out[3].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    whole = "\n".join(f"{['user', 'assistant'][k % 2]}:t{k}." for k in range(10_000))
    assert (out[9].audit, out[9].cost, out[9].repaired_sha256) == ("K" * 10_000, 0, hashlib.sha256(whole.encode()).hexdigest())
    lines = [r for r in conversations.repaired(frame).orderBy("conv_id", "place").collect() if r.conv_id == 9]
    assert [(r.place, r.edit, r.text) for r in lines] == [(k, "K", f"t{k}.") for k in range(10_000)]
    assert conversations.repair_digest(frame.limit(0)).count() == 0
    hurt = conversations.damaged(frame.drop("dropped"))
    assert {r.conv_id for r in conversations.repair_digest(hurt).collect()} == set(out)


# --- op 13 -----------------------------------------------------------------------------------


def brute_tree(leaves):
    """The root, and the siblings of each leaf by level as (left, right)."""
    paths, where, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, at in enumerate(where):
            first = at - at % 8
            paths[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        where = [at // 8 for at in where]
        nodes = [hashlib.sha256("".join(nodes[k : k + 8]).encode()).hexdigest() for k in range(0, len(nodes), 8)]
    return nodes[0], paths


@pytest.mark.parametrize("size", [1, 2, 8, 9, 63, 64, 65, 512, 700, 4096])
def test_traversal_equals_whole_trees(size):
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(size)]
    root, paths = brute_tree(leaves)
    walk = merkle.Traversal(lambda k: leaves[k].encode(), size, merkle.levels_of(size))
    kept = 0
    for path, wanted in zip(walk, paths):
        assert [(a.decode(), b.decode()) for a, b in path] == wanted
        kept = max(kept, sum(len(run) for tree in (*walk.existing, *walk.desired) for run in (*tree.kept, *tree.open)))
    assert kept <= 2 * 2 * (8 + 64 + 4 * 8)
    assert merkle.root_of([x.encode() for x in leaves], merkle.levels_of(size)).decode() == root


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: hashlib.sha256("".join(map(part, r)).encode()).hexdigest()
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for lang in order:
        own = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = brute_tree([leaf(r) for r in own])
        made.append((own, root, paths))
    top, tails = brute_tree([m[1] for m in made])
    out = []
    for (own, root, paths), tail in zip(made, tails):
        for r, path in zip(own, paths):
            lower = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if lower else r[4]
            now = leaf((*r[:4], text))
            for a, b in path + tail:
                now = hashlib.sha256((a + now + b).encode()).hexdigest()
            out.append((r[0], leaf(r), root, top, hashlib.sha256("".join(a + b for a, b in path + tail).encode()).hexdigest(), now, now == top))
    return out


def test_manifest_equals_brute_force(spark):
    """One language of two blocks, one of a single row, null and odd rows, and columns with the operator's own names."""
    rows = [(k, "s", "en", k % 7, f"Text {k}") for k in range(4200)] + [(7000 + k, None, "de", None, "Ä" * k) for k in range(70)]
    rows += [(1, None, None, 3, None), (None, "s", None, 1, "B"), (None, "s", None, 1, "A"), (5, "s", "zz", 0, ""), (8000, "s", "de", 1, "X" * 200_000), (7000, None, "de", None, ""), (9001, "s", "", 2, "E"), (9002, "s", "é", 2, "E")]
    form = "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, leaf int, root int, block int"
    out = merkle.manifest(spark.createDataFrame([(*r, "t", 1, 2, 3, 4) for r in rows], form)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, brute_manifest(rows)))
    assert not all(r.verified for r in out) and sum(r.verified for r in out) > len(out) / 2


def test_manifest_of_few_rows(spark):
    form = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], form)).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(4, "s", "en", 2, "ab")], form)).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256(b"").hexdigest() and one.verified
