"""The pipeline stage by stage against brute-force versions."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tessera.llm import language
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_quality import brute as brute_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for _, f in pipeline.STAGES:
        made.append(f(spark, made[-1], SF).cache())
    return made


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]
    assert all(x.columns == pipeline.COLUMNS for x in stages[1:4])


def test_language_stage(stages):
    rows = [r for r in stages[0].collect()]
    model = language.train(stages[0])
    lang, score = model.predict([r.text for r in rows])
    want = sorted((r.doc_id, x) for r, x, s in zip(rows, lang, score) if x != "und" and s >= pipeline.LEAST_SCORE)
    assert sorted((r.doc_id, r.lang) for r in stages[1].collect()) == want


def test_quality_stage(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[1:3])
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    assert not any(brute_counts(r.text)[5] for r in after.values())
    clean = [i for i, r in before.items() if not brute_counts(r.text)[5] and brute_counts(r.text)[2:5] == (0, 0, 0)]
    assert len([i for i in clean if i in after]) >= 0.98 * len(clean)


def test_near_duplicate_stage(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = sorted({c for _, _, c in brute_groups(before, 5, (80, 100))})
    assert sorted(r.doc_id for r in stages[3].collect()) == want


def test_packing_stage(stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = stages[4].toPandas()
    assert set(rows["doc_id"]) == set(texts)
    for doc_id, pieces in rows.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(pieces["start"], pieces["length"], pieces["ids_crc32"]))
        assert pieces["length"].sum() == len(ids) == pieces["doc_tokens"].iloc[0]
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024


def test_repeated_rows_and_nulls(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (2, text), (None, text), (3, "other words are in this text, and no others"), (3, "a third text with this same id stands here"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, None, "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, sig string")
    made = Counter((r.doc_id, r.text) for r in pipeline.remove_near_duplicates(spark, docs, SF).collect())
    assert made == Counter([rows[0], *rows[4:]])
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert Counter(r.text for r in pipeline.remove_near_duplicates(spark, nameless, SF).collect()) == Counter([text, *(t for _, t in rows[4:])])
    for _, f in pipeline.STAGES[:-1]:
        assert f(spark, docs.limit(0), SF).count() == 0
    assert pipeline.filter_quality(spark, docs, SF).count() == 0
    assert pipeline.identify_language(spark, docs, SF).count() == 0
    assert pipeline.pack_sequences(spark, docs, SF).count() == 8


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[4].collect()))
