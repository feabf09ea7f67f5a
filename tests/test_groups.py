"""Groups of similar records, and exact quantiles, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from narae.operators import evaluate, groups, similar


@pytest.mark.parametrize("few", [0, 100_000])
def test_connected_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(groups, "FEW_LINKS", few)
    rng = random.Random(few)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"p{k}", f"p{k + 1}") for k in range(20)]
    least = {x: x for pair in links for x in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    found = {r.node: r.least for r in groups.connected(spark.createDataFrame(links, "a string, b string")).collect()}
    apart = {x for pair in links for x in pair if pair[0] != pair[1]}
    assert found == {x: least[x] for x in apart}


def grams(t, n):
    t = " ".join(t.split()).lower()
    return {t[k : k + n] for k in range(len(t) - n + 1)} if len(t) >= n else {t} if t else set()


@pytest.mark.parametrize("across", [True, False])
def test_groups_equal_brute_force(spark, across):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef ") for _ in range(40)) for _ in range(12)]
    texts = [rng.choice(base) for _ in range(40)] + [b[:-2] + "zz" for b in base[:6]] + ["", "  ", "ab", "AB", None]
    rows = [(f"r{k:02}", t, rng.choice(["x", "y"])) for k, t in enumerate(texts)]
    sets = {i: grams(t or "", 5) for i, t, _ in rows}
    split = {i: s for i, _, s in rows}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and (not across or split[i] != split[j]) and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])} for i in sets}
    least = {i: i for i in sets}
    for _ in sets:
        for i, near in links.items():
            for j in near:
                least[i] = least[j] = min(least[i], least[j])
    out = groups.similar_groups(spark.createDataFrame(rows, "id string, text string, split string"), 5, 0.6, across).collect()
    assert {r.id: (r.group_id, r.links) for r in out} == {i: (least[i], len(links[i])) for i in sets}
    for r in out:
        own = [i for i in sets if least[i] == least[r.id]]
        assert r.members == len(own) and r.splits == sorted({split[i] for i in own})


def test_copies_stay_single_rows(spark):
    copies = spark.range(10_000).select(F.format_string("c%05d", "id").alias("id"), F.lit("the same text").alias("text"), (F.col("id") % 2).cast("string").alias("split"))
    out = groups.similar_groups(copies)
    assert out.count() == 10_000
    assert [tuple(r) for r in out.select("group_id", "links", "members", F.size("splits")).distinct().collect()] == [("c00000", 5000, 10_000, 2)]


def test_texts_are_stored_once_and_packed(spark, monkeypatch):
    stored = []
    for module in (groups, similar):
        monkeypatch.setattr(module, "materialise", lambda df, name, *a, f=module.materialise: stored.append((name, df.columns)) or f(df, name, *a))
    rows = [("a", "the same text", "x"), ("b", "The  same text", "y"), ("c", "the same texts", "y"), ("d", "", "x"), ("e", None, "y"), ("f", "another", None)]
    out = groups.similar_groups(spark.createDataFrame(rows, "id string, text string, split string"), 5, 0.5).collect()
    assert {r.id: (r.group_id, r.links, r.members) for r in out} == {"a": ("a", 2, 3), "b": ("a", 1, 3), "c": ("a", 1, 3), "d": ("d", 0, 1), "e": ("e", 0, 1), "f": ("f", 0, 1)}
    # Records, classes and the texts to be met all held the text before.
    assert [name for name, columns in stored if "text" in columns or "_text" in columns] == ["classes"]
    assert [columns for name, columns in stored if name == "texts"] == [["own", "pack"]]


def test_quantiles(spark, monkeypatch):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 5.0, rng.random() * 1e6, -3.0]) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "ms double")
    ordered = sorted(values)
    for tolerance in (10, 10_000):
        found = evaluate.quantile_values(table, "ms", [0.0, 0.3, 0.5, 0.95, 1.0], tolerance)
        for share, x in zip([0.0, 0.3, 0.5, 0.95, 1.0], found):
            at = share * (len(values) - 1)
            a, b = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
            assert abs(x - (a + (b - a) * (at - int(at)))) < 1e-9
    assert evaluate.quantile_values(table.limit(0), "ms", [0.5]) == [None]
    assert evaluate.quantile_values(spark.createDataFrame([(2.0,)] * 50, "ms double"), "ms", [0.5], 10) == [2.0]
