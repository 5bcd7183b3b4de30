"""Quality rules against a brute-force version and DuckDB."""

import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality, sql


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab \n\t\x0b#é 中", max_size=150), min_size=1, max_size=30))
def test_counts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS lang", "null AS source")
    made = {r.doc_id: counts(r) for r in quality.features(df).collect()}
    assert made == {i: brute(t) for i, t in enumerate(texts)}


def test_edges(documents, none):
    rows = quality.quality_rules(documents).collect()
    assert sorted((r.doc_id, *counts(r)) for r in rows) == sorted((r.doc_id, *brute(r.text)) for r in documents.collect())
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality_rules(none).count() == 0


def test_bins_hold_their_values(spark):
    rows = spark.range(0, 100_000, 7).withColumnRenamed("id", "v").selectExpr("v", f"{quality.BIN} AS b").selectExpr("v", "b", f"{quality.BIN_LOW} AS low", f"{quality.BIN_HIGH} AS high").collect()
    assert all(r.low <= r.v <= r.high and r.high - r.low <= r.v / 32 for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_junk_goes_and_prose_stays_as_in_sql(spark):
    prose = lambda i: " ".join(f"word{(i * 31 + k * k * 7) % 997}" for k in range(60 + i % 40))
    rows = [(i, prose(i), ["en", "de", None][i % 3], f"s{i % 2}") for i in range(900)]
    rows += [(1000 + i, prose(i).replace(" ", " ### | "), "en", "s0") for i in range(20)]
    rows += [(2000 + i, "line of words here\n" * 4 + prose(i), "de", "s9") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    made = quality.quality_rules(df)
    kept = {r.doc_id: r.kept for r in made.collect()}
    assert all(kept[i] for i in range(900)) and not any(kept[1000 + i] for i in range(20))
    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(sql.OP1).fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_sketches_merge(spark):
    df = spark.createDataFrame([(i, f"w{i} " * (30 + i)) for i in range(50)], "doc_id long, text string").selectExpr("*", "'x' AS lang", "'y' AS source")
    df = df.selectExpr("doc_id", "concat_ws(' ', transform(sequence(1, 30 + doc_id), i -> concat('w', i))) AS text", "lang", "source")
    whole = quality.sketches(quality.features(df))
    halves = quality.sketches(quality.features(df.filter("doc_id % 2 = 0"))).unionByName(quality.sketches(quality.features(df.filter("doc_id % 2 = 1"))))
    merged = halves.groupBy("lang", "source", "measure", "b").agg({"n": "sum"})
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_fences_follow_the_source(spark):
    """The same texts stay where such symbols are usual and go where they are not."""
    words = lambda i: [f"word{(i * 31 + k * k * 7) % 997}" for k in range(60 + i % 40)]
    rows = []
    for i in range(600):
        plain, marked = words(i), words(i)
        marked[:: 9 + i % 5] = [w + "#" for w in marked[:: 9 + i % 5]]
        rows += [(i, " ".join(plain), "en", "plain"), (1000 + i, " ".join(marked), "en", "marked")]
    rows += [(5000 + i, " ".join(w + "#" * (k % 10 == 0) for k, w in enumerate(words(i))), "en", source) for i, source in enumerate(["plain", "marked"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    made = quality.features(df)
    fence = {r.source: r for r in quality.fences(quality.sketches(made)).collect()}
    assert fence["marked"].high_symbols > 5 * fence["plain"].high_symbols
    kept = {r.doc_id: r.kept for r in quality.quality_rules(df).collect()}
    assert all(kept[i] for i in kept if i < 5000)
    assert [kept[5000 + i] for i in range(10)] == [False, True] * 5


def test_no_constant_decides(spark):
    """Twice the symbols in every document of a group: the same documents are outside."""
    rows = []
    for times in (1, 4):
        for i in range(400):
            words = [f"w{(i * 31 + k * k * 7) % 997}" for k in range(400)]
            marks = (3 + i % 7 if i % 40 else 60) * times
            words[:marks] = [w + "#" for w in words[:marks]]
            rows.append((1000 * times + i, " ".join(words), "en", f"s{times}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id for r in quality.quality_rules(df).collect() if not r.kept}
    assert {i - 1000 for i in out if i < 2000} == {i - 4000 for i in out if i >= 4000} == set(range(0, 400, 40))
