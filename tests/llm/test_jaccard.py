"""The Jaccard join against all pairs by brute force, with every path of large regions and components forced."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessera.llm import common, components, jaccard, shingles
from tessera.llm.common import table


def brute(rows, n, t):
    """Sorted (id, size of the set, component) of (id, text) rows."""

    def shingle_set(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j < i}:
            both = len(s & sets[j])
            if t[1] * both >= t[0] * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, groups=30):
    """Prose with exact copies, near copies around the threshold, shared passages, short and empty texts."""
    draw = random.Random(seed)
    word = lambda: "w%d" % draw.randrange(3000)
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n", "One", "one", "one two", "ONE  two", "one two three", "x " * 4000]
    for _ in range(groups):
        base = [word() for _ in range(draw.choice([3, 8, 25, 80, 300]))]
        texts.append(" ".join(base))
        for _ in range(draw.choice([0, 1, 2, 25])):
            edited = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 5])):
                edited[draw.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
        if draw.random() < 0.4:
            texts.append(passage + " " + " ".join(word() for _ in range(draw.choice([5, 30, 200]))))
    draw.shuffle(texts)
    return [(3 * i + 7, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "t", "region", "size"), [(3, (90, 100), jaccard.REGION, jaccard.COMPONENT_BYTES), (5, (80, 100), 6, 2000), (3, (90, 100), 3, 500), (1, (50, 100), 5, 4000)])
def test_all_pairs(spark, n, t, region, size):
    rows = corpus(n + region, 30 if n > 1 else 10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = jaccard.jaccard_classes(df, words=n, threshold=t, region=region, component_bytes=size)
    assert sorted(map(tuple, made.collect())) == brute(rows, n, t)


@pytest.mark.parametrize(("region", "size"), [(40, 1 << 20), (jaccard.REGION, 4000), (40, 4000)])
def test_many_near_copies(spark, region, size):
    """Two crowds of near copies and texts at their rims: by representatives, in regions and in components."""
    draw = random.Random(8)
    rows = []
    for crowd in range(2):
        base = [f"c{crowd}w{draw.randrange(400)}" for _ in range(60)]
        for i in range(220):
            edited = list(base)
            for _ in range(draw.choice([0, 1, 2] if i % 9 else [4, 6, 9, 12])):
                edited[draw.randrange(60)] = f"e{draw.randrange(30)}"
            rows.append((len(rows), " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = jaccard.jaccard_classes(df, words=2, threshold=(80, 100), region=region, component_bytes=size)
    assert sorted(map(tuple, made.collect())) == brute(rows, 2, (80, 100))


def test_exact_links_connect_what_is_linked():
    draw = random.Random(4)
    for t in ((1, 2), (4, 5)):
        for size in (1, 2, 3, 40):
            sets = [np.array(sorted(draw.sample(range(14), draw.randint(1, 12))), np.uint64) for _ in range(size)]
            for left in (None, np.array([draw.random() < 0.5 for _ in sets])):
                want = {(i, j) for i in range(size) for j in range(i) if (left is None or left[i] != left[j]) and jaccard.linked(sets[i], sets[j], t)}
                got = {(max(x), min(x)) for x in jaccard.exact_links(sets, t, left)}
                assert got <= want and len(got) == len({frozenset(x) for x in got})
                assert groups(size, got) == groups(size, want)


def groups(size, edges):
    of = list(range(size))
    for a, b in edges:
        x, y = of[a], of[b]
        of = [y if z == x else z for z in of]
    return {tuple(i for i in range(size) if of[i] == k) for k in of}


def test_small_table(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, jaccard.jaccard_classes(documents, words=3, threshold=(90, 100)).collect())) == brute(rows, 3, (90, 100))


def test_join_instead_of_broadcast(spark):
    rows = corpus(5, 12)
    df = spark.createDataFrame([*rows, (None, rows[3][1])], "doc_id long, text string")
    signed = jaccard.signatures(df, np.zeros(16, np.uint8), "doc_id", "text", 3, (90, 100)).filter("sig IS NOT NULL")
    wanted = signed.groupBy("sig").agg({"doc_id": "min", "n": "max"}).selectExpr("sig", "`min(doc_id)` AS doc", "`max(n)` AS n", "xxhash64(sig) AS cid", "xxhash64(sig) AS root", "1 AS blocks")
    size = {r.cid: r.n for r in wanted.collect()}
    for bound in (0, 10_000):
        got = jaccard.sets_of(df, wanted, "doc_id", "text", 3, broadcast=bound).collect()
        assert {r.cid for r in got} == set(size) and all(len(r.shingles) == 8 * size[r.cid] for r in got)


def test_edges(documents, none):
    made = sorted(map(tuple, jaccard.jaccard_classes(documents).collect()))
    assert [x[0] for x in made] == sorted(r.doc_id for r in documents.collect())
    same = {r[2] for r in made if r[0] == 0 and r[1] > 0} | {r[2] for r in made if r[0] == 3 and r[1] > 0}
    assert 0 in same  # row 8 has the id 0 and the text of row 3
    assert jaccard.jaccard_classes(none).count() == 0


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c d", "", None, "a", " b  C\td", "é ü a b c", "x" * 70000 + " b"]
    whole, size, where = shingles.shingled(pa.array(texts), 3)
    for i, t in enumerate(texts):
        one, own, _ = shingles.shingled(pa.array([t], pa.string()), 3)
        assert whole[where[i] : where[i + 1]].tolist() == one.tolist() and size[where[i] : where[i + 1]].tolist() == own.tolist()
    sliced, _, _ = shingles.shingled(pa.array(texts)[3:5], 3)
    assert sliced.tolist() == whole[where[3] : where[5]].tolist()
    assert shingles.shingled(pa.array(["B c D"]), 3)[0].tolist() == shingles.shingled(pa.array(["b C d"]), 3)[0].tolist()


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 2000 + i) for i in range(80)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    made = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in made.collect()} == {x: find(x) for x in parent} and made.count() == len(parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("least", [0, 100_000])
def test_join_hot(spark, monkeypatch, least):
    monkeypatch.setattr(common, "HOT", 10)
    left = spark.range(1000).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id AS a")
    right = left.groupBy("k").count().withColumnRenamed("count", "rows").withColumn("b", F.col("k") + 1)
    made = common.join_hot(left, right, "k", 1000, least)
    assert made.columns == ["k", "a", "b"]
    assert sorted(map(tuple, made.collect())) == sorted((7 if i % 3 == 0 else i, i, 8 if i % 3 == 0 else i + 1) for i in range(1000))


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    monkeypatch.setattr(common, "HOT", 10)
    edges = [(5000, i) for i in range(300)] + [(6000 + i, 6001 + i) for i in range(20)] + [(6010, 299)]
    made = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.root for r in made} == {0} and len(made) == 322
